"""Datasets from driver collections, ranges and positioned rows, all with a slice layout."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.dataset import POS, SLICE, Dataset
from weftline.operators.partitioning import check_slices, slice_id


def from_positions(df: DataFrame, position: Column, size: int, num_slices: int, value: Column) -> Dataset:
    check_slices(num_slices)
    cols = [value.alias("value"), slice_id(position, size, num_slices).alias(SLICE), position.alias(POS)]
    return Dataset(df.select(*cols), size, num_slices)


def from_range(spark: SparkSession, n: int, num_slices: int) -> Dataset:
    return from_positions(spark.range(0, n, 1, check_slices(num_slices)), F.col("id"), n, num_slices, F.col("id"))


def from_values(spark: SparkSession, values: Sequence[Any], num_slices: int, schema: Any = None) -> Dataset:
    """Positions are dealt on the driver; the layout is computed where the rows are."""
    check_slices(num_slices)
    values = list(values)
    if schema is None and not values:
        schema = T.LongType()
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None:
        schema = spark.createDataFrame([(values[0],)], ["value"]).schema["value"].dataType
    rows = spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(POS, T.LongType(), False), T.StructField("v", schema)]))
    return from_positions(rows, F.col(POS), len(values), num_slices, F.col("v"))
