"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again before the next stage, so no stage recomputes another and a lost executor costs
only the stage at hand. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, decontam, linededup, packing, simhash, toxicity
from weftline.llm.queries import vocabulary


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders of the tables that the last stage's result reads; a stage begins when that is written.
_read_by_last: list[str] = []


def _stage(f):
    """Once a stage begins, what the stage before kept besides its result goes; no other tables do.
    Batches to Python stay small next to an executor's memory (``run`` restores the setting)."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(spark, _read_by_last)
        spark.conf.set(_BATCH, str(common.BATCH_BYTES))
        with common.collected() as made:
            out = f(spark, docs, sf_dir)
        _read_by_last.extend(made)
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of this data."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat or nearly repeat, the first stays; documents left without lines go."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates by SimHash one document stays."""
    return simhash.one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL can't express the trained, hashed and tokenized stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.
    Results of earlier stages go as soon as the next one is written."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    root, batch = f"{common.shared_dir(spark)}/pipeline-{common.unique()}", spark.conf.get(_BATCH)
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, out, sf_dir).write.parquet(path := f"{root}/{k}-{name}")
            if before:
                common.delete(spark, before)
            out, before = spark.read.parquet(path), path
    finally:
        spark.conf.set(_BATCH, batch)
        common.sweep(spark, _read_by_last)
    return out
