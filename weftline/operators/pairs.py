"""A lazy dataset of (key, value) rows and its by-key operators.

NULL keys form one group of their own, as in Spark's ``groupBy``. Output order of
by-key operators is unspecified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import aggregators, opaque
from weftline.operators.dataset import Dataset
from weftline.operators.partitioning import Partitioner, check_slices


#: Groups in which a key's combiners meet before they meet in one.
SALTS = 64


def _deal(df: DataFrame, partitions: int | Partitioner | None) -> DataFrame:
    """AQE sizes the exchange unless the caller fixes the number of reduce partitions, or says with a
    ``Partitioner`` which partition a key goes to."""
    if partitions is None:
        return df
    if isinstance(partitions, Partitioner):
        return df.repartitionById(partitions.num_partitions, partitions.partition_of(F.col("key")))
    return df.repartition(check_slices(partitions), "key")


class PairDataset:
    def __init__(self, df: DataFrame):
        self.df = df.select("key", "value")

    def _dealt(self, partitions: int | Partitioner | None) -> DataFrame:
        return _deal(self.df, partitions)

    # -- narrow

    def map_values(self, f: Callable[[Column], Column]) -> PairDataset:
        return PairDataset(self.df.select("key", f(F.col("value")).alias("value")))

    def filter(self, f: Callable[[Column, Column], Column]) -> PairDataset:
        return PairDataset(self.df.where(f(F.col("key"), F.col("value"))))

    def map(self, f: Callable[[Column, Column], Column]) -> Dataset:
        return Dataset(self.df.select(f(F.col("key"), F.col("value")).alias("value")))

    def flat_map(self, f: Callable[[Column, Column], Column]) -> Dataset:
        return Dataset(self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("value")))

    def map_pair(self, key: Callable[[Column, Column], Column], value: Callable[[Column, Column], Column]) -> PairDataset:
        k, v = F.col("key"), F.col("value")
        return PairDataset(self.df.select(key(k, v).alias("key"), value(k, v).alias("value")))

    def keys(self) -> Dataset:
        return Dataset(self.df.select(F.col("key").alias("value")))

    def values(self) -> Dataset:
        return Dataset(self.df.select("value"))

    def union(self, other: PairDataset) -> PairDataset:
        return PairDataset(self.df.unionByName(other.df))

    # -- wide

    def partition_by(self, partitions: int | Partitioner) -> PairDataset:
        """Deal rows by the hash of their key (by-key operators that follow don't shuffle again), or as a
        partitioner says."""
        return PairDataset(self._dealt(partitions))

    def reduce_by_key(self, f: aggregators.Algebraic | str | Callable[[Column, Column], Column], num_partitions: int | Partitioner | None = None) -> PairDataset:
        """``f``: a named combiner (native partial aggregation), or an associative and commutative
        Column function, which folds each key's values by way of salted partial folds."""
        if isinstance(f, str):
            f = aggregators.BY_NAME[f]
        if isinstance(f, aggregators.Algebraic):
            return self.aggregate_by_key(f.aggregate(F.col("value")), num_partitions)
        return self.combine_by_key(aggregators.Aggregator(lambda v: v, f, f), num_partitions)

    def aggregate_by_key(self, agg: Column, num_partitions: int | Partitioner | None = None) -> PairDataset:
        """Any Spark aggregate over ``value``; partial before the exchange, final after it."""
        if num_partitions is None:
            return PairDataset(self.df.groupBy("key").agg(agg.alias("value")))
        # an explicit number of reduce partitions: combine first, so that only combiners are dealt
        return PairDataset(_deal(self.df.groupBy("key").agg(agg.alias("value")), num_partitions))

    def combine_by_key(self, agg: aggregators.Aggregator, num_partitions: int | Partitioner | None = None) -> PairDataset:
        """The general triple over Columns. Each partition folds its values by key before the shuffle
        (``agg.run`` rows at a time), as many combiners of a key meet in groups, then the groups'."""
        gathered = opaque.gather_by_key(self.df, agg.run)
        folded = gathered.select("key", aggregators.fold_list(F.col("values"), agg.create, agg.merge_value).alias("c"))
        merge = lambda c: aggregators.fold_list(F.col(c), lambda x: x, agg.merge_combiners)
        # the salt keeps the order of one array from growing with a hot key
        salted = folded.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        mid = salted.groupBy("key", "_salt").agg(F.collect_list("c").alias("cs")).select("key", merge("cs").alias("c"))
        out = _deal(mid, num_partitions).groupBy("key").agg(F.collect_list("c").alias("cs")).select("key", merge("cs").alias("value"))
        return PairDataset(out if not isinstance(num_partitions, Partitioner) else _deal(out, num_partitions))

    def combine_by_key_py(self, create: Callable[[Any], Any], merge_value: Callable[[Any, Any], Any], merge_combiners: Callable[[Any, Any], Any], returns: str, num_partitions: int | Partitioner | None = None) -> PairDataset:
        """The triple over opaque Python, combined on the map side."""
        return PairDataset(opaque.combine_by_key(self.df, create, merge_value, merge_combiners, returns, lambda df: _deal(df, num_partitions) if num_partitions is not None else df.repartition("key")))

    def group_by_key(self, num_partitions: int | Partitioner | None = None) -> PairDataset:
        """All values of a key in one array, in no particular order."""
        return PairDataset(self._dealt(num_partitions).groupBy("key").agg(F.collect_list("value").alias("value")))

    def count_by_key(self) -> PairDataset:
        return PairDataset(self.df.groupBy("key").agg(F.count(F.lit(1)).alias("value")))

    # -- extras beyond the core: joins by key

    def join(self, other: PairDataset, how: str = "inner") -> DataFrame:
        return self.df.withColumnRenamed("value", "left").join(other.df.withColumnRenamed("value", "right"), "key", how)

    # -- persistence and actions

    def as_dataset(self) -> Dataset:
        """Pairs as single values: structs of key and value."""
        return Dataset(self.df.select(F.struct("key", "value").alias("value")))

    def cache(self) -> PairDataset:
        self.df = self.df.cache()
        return self

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PairDataset:
        self.df = self.df.persist(level)
        return self

    def unpersist(self) -> PairDataset:
        self.df = self.df.unpersist()
        return self

    def cache_status(self) -> dict[str, Any]:
        return Dataset.cache_status(self)  # type: ignore[arg-type]

    def cache_locations(self) -> list[list[str]]:
        return Dataset.cache_locations(self)  # type: ignore[arg-type]

    def distinct(self) -> PairDataset:
        return PairDataset(self.df.distinct())

    def get_num_slices(self) -> int:
        return self.df.rdd.getNumPartitions()

    def collect(self) -> list[tuple[Any, Any]]:
        return [(r[0], r[1]) for r in self.df.collect()]

    def iterate(self) -> Iterator[tuple[Any, Any]]:
        return ((r[0], r[1]) for r in self.df.toLocalIterator())

    def reduce(self, f: aggregators.Algebraic | str | Callable[[Any, Any], Any], zero: Any = None) -> tuple[Any, Any]:
        """The fold of ``Dataset.reduce`` over (key, value) pairs, from the defaults of both."""
        return tuple(self.as_dataset().reduce(f, zero))

    def reduce_strict(self, f: aggregators.Algebraic | str | Callable[[Any, Any], Any]) -> tuple[Any, Any]:
        return tuple(self.as_dataset().reduce_strict(f))

    def run_job(self, func: Callable[[Iterator[tuple[Any, Any]]], Any], partitions: Sequence[int] | None = None) -> list[Any]:
        """``func`` over each partition's pairs, or those of chosen partitions in that order."""
        return self.as_dataset().run_job(lambda it: func((v[0], v[1]) for v in it), partitions)

    def count(self) -> int:
        return self.df.count()
