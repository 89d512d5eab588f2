"""Datasets from files, and text output."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.dataset import Dataset


def parquet(spark: SparkSession, path: str, value: Column | str | None = None) -> Dataset:
    df = spark.read.parquet(path)
    return Dataset.over(df, F.struct(*df.columns) if value is None else value)


def lines(spark: SparkSession, path: str) -> Dataset:
    return Dataset(spark.read.text(path, lineSep="\n").select("value"))


def json_field(spark: SparkSession, path: str, field: str) -> Dataset:
    df = spark.read.schema(T.StructType([T.StructField(field, T.StringType())])).json(path)
    return Dataset(df.select(F.coalesce(F.col(field), F.lit("")).alias("value")))


def write_text(dataset: Dataset, path: str, files: int | None = None) -> None:
    """One value a line, in ``files`` files if that is given."""
    df = dataset.df.select(F.col("value").cast("string"))
    (df if files is None else df.repartition(files)).write.mode("overwrite").text(path, lineSep="\n")


def json_to_text(spark: SparkSession, source: str, field: str, target: str, files: int = 80) -> None:
    """One field of (compressed) JSON lines as that many text files: the preparation of word-count inputs.

    Line feeds inside a value make lines of their own when the files are read.
    """
    write_text(json_field(spark, source, field), target, files)
