"""The classic workloads as dataset pipelines."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.engine import Engine
from weftline.functions import lcg, text
from weftline.operators.dataset import Dataset
from weftline.operators.pairs import PairDataset


def word_count(texts: Dataset, split=None, num_partitions: int | None = None, cache: bool = False) -> PairDataset:
    """Lines, then tokens, then (token, 1) summed by token. Without ``split`` tokens are cut at single
    spaces, and lines and tokens in one pass; ``cache`` keeps the texts, not the many tokens."""
    if cache:
        texts = texts.cache()
    words = texts.flat_map(text.line_tokens) if split is None else texts.flat_map(text.lines).flat_map(split)
    return words.map_pair(lambda w: w, lambda _: F.lit(1).cast("bigint")).reduce_by_key("sum", num_partitions)


def basics(engine: Engine, values: Sequence[int] = tuple(range(1, 8)), num_slices: int = 3) -> Dataset:
    """+1, -1, key by parity, group, and the sum of each group."""
    data = engine.parallelize(list(values), num_slices, "bigint").map(lambda v: v + 1).map(lambda v: v - 1)
    groups = data.map_pair(lambda v: v % 2).group_by_key(2)
    return groups.map(lambda _, vs: F.aggregate(vs, F.lit(0).cast("bigint"), lambda a, v: a + v))


def nested_flat_map(data: Dataset) -> PairDataset:
    """v to [v, v+1], each to [v, 2v], summed by parity."""
    twice = data.flat_map(lambda v: F.array(v, v + 1)).flat_map(lambda v: F.array(v, v * 2))
    return twice.map_pair(lambda v: v % 2).reduce_by_key("sum", 2)


def monte_carlo_hits(spark: SparkSession, chunks: int, draws: int, num_slices: int = 4, jump: bool = True) -> DataFrame:
    """Hits among ``chunks`` x ``draws`` points. The recurrence depends on a seed only modulo
    ``lcg.MODULUS``, so seeds are counted by residue, and hits looked up by residue: walked by
    doubled jumps over all states, or (``jump=False``) draw by draw from each residue that occurs."""
    seeds = spark.range(0, chunks, 1, num_slices).groupBy((F.col("id") % lcg.MODULUS).alias("seed")).agg(F.count(F.lit(1)).alias("times"))
    if not jump:
        return seeds.agg(F.sum(lcg.hits(F.col("seed"), draws) * F.col("times")).cast("bigint").alias("hits"))
    table = pa.table({"seed": pa.array(range(lcg.MODULUS), pa.int64()), "h": lcg.hits_by_state(draws)})
    hits = F.broadcast(spark.createDataFrame(table))  # 134,456 rows, whatever the data
    return seeds.join(hits, "seed").agg(F.sum(F.col("h") * F.col("times")).cast("bigint").alias("hits"))


def monte_carlo_pi(spark: SparkSession, chunks: int, draws: int, num_slices: int = 4) -> DataFrame:
    return monte_carlo_hits(spark, chunks, draws, num_slices).select("hits", (F.lit(4.0) * F.col("hits") / F.lit(chunks * draws)).alias("pi"))


def monte_carlo_pi_random(spark: SparkSession, points: int, num_slices: int = 8, seed: int = 42) -> DataFrame:
    """The same estimate from Spark's own generator; statistical only."""
    pts = spark.range(0, points, 1, num_slices).select((F.rand(seed) * 2 - 1).alias("x"), (F.rand(seed + 1) * 2 - 1).alias("y"))
    inside = F.sum(F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") < 1, 1).otherwise(0))
    return pts.agg((4.0 * inside / points).alias("pi"))


def barrier_ring(spark: SparkSession, tasks: int) -> list[tuple[int, str]]:
    """Message passing among the tasks of one stage: each sends its number, each gets its neighbour's."""
    from pyspark import BarrierTaskContext

    def talk(_):
        ctx = BarrierTaskContext.get()
        said = ctx.allGather(str(ctx.partitionId()))
        yield ctx.partitionId(), said[(ctx.partitionId() + 1) % len(said)]

    return sorted(spark.sparkContext.parallelize(range(tasks), tasks).barrier().mapPartitions(talk).collect())
