"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import chat, decontam, egojoin, langid, linededup, packing, quality, simhash, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """A public tokenizer file, by name; the package is installed wherever executors run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


@_query
def op1_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return egojoin.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


SQL["op1_embedding_near_dedup"] = egojoin.SQL


@_query
def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(_documents(spark, d))


@_query
def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(_documents(spark, d), _labels(spark, d))


@_query
def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.line_classes(_documents(spark, d))


@_query
def op5_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_probe(spark.read.parquet(f"{d}/conversations.parquet"))))


SQL["op5_chat_formatting"] = chat.SQL


@_query
def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, d), _labels(spark, d))


@_query
def op7_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, d), vocabulary("word_bpe_49k.json"))


@_query
def op8_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.simhash_components(_documents(spark, d))
    return out.select("doc_id", simhash.hex16(out["fp"]).alias("fingerprint"), "component_id")


@_query
def op9_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.leaks(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


SQL["op9_benchmark_decontamination"] = decontam.SQL


@_query
def op10_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenfile.round_trip(_documents(spark, d), vocabulary("byte_bpe_50k.json"))
