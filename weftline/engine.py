"""Entry point: wraps a SparkSession and creates datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from weftline.operators.dataset import Dataset
from weftline.sources import collections as _collections
from weftline.sources import files as _files

DEFAULT_SLICES = 8


class Engine:
    """Creates datasets from collections, ranges, text and columnar files, and runs partition jobs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def parallelize(self, values: Sequence[Any], num_slices: int = DEFAULT_SLICES, schema: Any = None) -> Dataset:
        """A driver-local collection cut into slices (see ``operators.partitioning`` for the layout)."""
        return _collections.from_values(self.spark, values, num_slices, schema)

    def range(self, n: int, num_slices: int = DEFAULT_SLICES) -> Dataset:
        """0..n-1, generated on the executors, with the same slice layout as ``parallelize``."""
        return _collections.from_range(self.spark, n, num_slices)

    def slices(self, df: DataFrame, position: Column, size: int, num_slices: int, value: Column) -> Dataset:
        """A dataset over rows whose dense positions 0..size-1 are already a column."""
        return _collections.from_positions(df, position, size, num_slices, value)

    def read_parquet(self, path: str, value: Column | str | None = None) -> Dataset:
        return _files.parquet(self.spark, path, value)

    def read_lines(self, path: str) -> Dataset:
        """Lines of text files, cut at a line feed only; a carriage return stays."""
        return _files.lines(self.spark, path)

    def read_json_field(self, path: str, field: str) -> Dataset:
        """One string field of JSON lines; a missing field is the empty string."""
        return _files.json_field(self.spark, path, field)

    def of(self, df: DataFrame, value: Column | str) -> Dataset:
        """Any DataFrame column as a dataset."""
        return Dataset.over(df, value)

    def run_job(self, dataset: Dataset, func: Callable[[Iterator[Any]], Any], partitions: Sequence[int] | None = None) -> list[Any]:
        """``func`` over each slice (or the chosen ones, in the order asked for), one result each."""
        return dataset.run_job(func, partitions)
