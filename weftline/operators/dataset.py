"""A lazy dataset of single values: one DataFrame with a ``value`` column.

Callables receive and return Columns, so chains collapse into one projection
and filters reach the scan. Opaque Python has to be asked for (``*_py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import aggregators, opaque
from weftline.operators.partitioning import slice_positions

if TYPE_CHECKING:
    from weftline.operators.pairs import PairDataset

SLICE, POS = "_slice", "_pos"
ZEROS = {T.StringType: "", T.BooleanType: False, T.DoubleType: 0.0, T.FloatType: 0.0, T.DecimalType: Decimal(0), T.BinaryType: b"", T.ArrayType: [], T.MapType: {}}
EPOCH = datetime(1970, 1, 1)


def zero_of(kind: T.DataType) -> Any:
    """The default of a value type, from which ``reduce`` starts; of a struct, field by field."""
    if isinstance(kind, T.StructType):
        return Row(*kind.names)(*[zero_of(f.dataType) for f in kind]) if kind.names else Row()
    if isinstance(kind, T.DateType):
        return EPOCH.date()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return EPOCH
    return ZEROS.get(type(kind), 0)


def zero_column(kind: T.DataType) -> Column:
    """``zero_of`` as a column of that type."""
    if isinstance(kind, T.StructType):
        return F.struct(*[zero_column(f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    return F.lit(zero_of(kind)).cast(kind)


def _seq(s: Any) -> list[str]:
    return [s.apply(i) for i in range(s.size())]


def cached_by_host(spark: SparkSession) -> dict[str, dict[str, int]]:
    """Storage memory of each block manager (host:port): capacity and used, in bytes."""
    it, out = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator(), {}
    while it.hasNext():
        e = it.next()
        out[e._1()] = {"capacity": e._2()._1(), "used": e._2()._1() - e._2()._2()}
    return out


class Dataset:
    """Rows in ``value``; ``_slice`` and ``_pos`` travel along where the source has a slice layout."""

    def __init__(self, df: DataFrame, size: int | None = None, num_slices: int | None = None):
        self.df, self.size, self.num_slices = df, size, num_slices

    @classmethod
    def over(cls, df: DataFrame, value: Column | str) -> Dataset:
        return cls(df.select((F.col(value) if isinstance(value, str) else value).alias("value")))

    # -- narrow transformations

    @property
    def _layout(self) -> list[str]:
        return [c for c in (SLICE, POS) if c in self.df.columns]

    def _with(self, df: DataFrame) -> Dataset:
        return type(self)(df, None, self.num_slices)

    def map(self, f: Callable[[Column], Column]) -> Dataset:
        return Dataset(self.df.select(f(F.col("value")).alias("value"), *self._layout), self.size, self.num_slices)

    def flat_map(self, f: Callable[[Column], Column]) -> Dataset:
        """``f`` gives an array; rows that expand to nothing vanish."""
        return Dataset(self.df.select(F.explode(f(F.col("value"))).alias("value"), *self._layout), None, self.num_slices)

    def filter(self, f: Callable[[Column], Column]) -> Dataset:
        return self._with(self.df.where(f(F.col("value"))))

    def map_pair(self, key: Callable[[Column], Column], value: Callable[[Column], Column] = lambda v: v) -> PairDataset:
        from weftline.operators.pairs import PairDataset

        v = F.col("value")
        return PairDataset(self.df.select(key(v).alias("key"), value(v).alias("value")))

    def map_py(self, f: Callable[[Any], Any], returns: str) -> Dataset:
        """Opaque Python per row, moved in Arrow batches."""
        return Dataset(self.df.select(opaque.scalar(f, returns)(F.col("value")).alias("value"), *self._layout), self.size, self.num_slices)

    def flat_map_py(self, f: Callable[[Any], Sequence[Any]], returns: str) -> Dataset:
        expanded = opaque.scalar(lambda x: list(f(x)), f"array<{returns}>")
        return Dataset(self.df.select(F.explode(expanded(F.col("value"))).alias("value"), *self._layout), None, self.num_slices)

    def filter_py(self, f: Callable[[Any], bool]) -> Dataset:
        return self._with(self.df.where(opaque.scalar(lambda x: bool(f(x)), "boolean")(F.col("value"))))

    def distinct(self) -> Dataset:
        return Dataset(self.df.select("value").distinct())

    def union(self, other: Dataset) -> Dataset:
        """Both datasets' values, repeats included; partitions are taken over as they are, without a shuffle."""
        return Dataset(self.df.select("value").unionByName(other.df.select("value")))

    # -- persistence

    def cache(self) -> Dataset:
        self.df = self.df.cache()
        return self

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Dataset:
        self.df = self.df.persist(level)
        return self

    def unpersist(self) -> Dataset:
        self.df = self.df.unpersist()
        return self

    def cache_status(self) -> dict[str, Any]:
        """How this dataset is kept; and of all that is cached, the memory of each host: capacity and used bytes."""
        level = self.df.storageLevel
        return {"cached": level.useMemory or level.useDisk, "memory": level.useMemory, "disk": level.useDisk, "replicas": level.replication, "hosts": cached_by_host(self.df.sparkSession)}

    def cache_locations(self) -> list[list[str]]:
        """Hosts that hold each partition, as the scheduler prefers them; empty lists where none is kept."""
        jrdd = self.df._jdf.queryExecution().toRdd()
        return [list(_seq(jrdd.preferredLocations(p))) for p in jrdd.partitions()]

    # -- actions

    def ordered(self) -> DataFrame:
        """Values in slice order, then in order within the slice, where the source has a layout."""
        return (self.df.orderBy(SLICE, POS) if self._layout else self.df).select("value")

    def collect(self) -> list[Any]:
        return [r[0] for r in self.ordered().collect()]

    def iterate(self) -> Iterator[Any]:
        """Values one partition at a time, for results larger than the driver."""
        return (r[0] for r in self.ordered().toLocalIterator())

    def count(self) -> int:
        return self.df.count()

    def count_df(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def reduce_expr(self, combiner: aggregators.Algebraic | str, zero: Any = None) -> Column:
        """The fold from ``zero`` (default: the type's default) as one aggregate column."""
        c = aggregators.BY_NAME[combiner] if isinstance(combiner, str) else combiner
        start = zero_column(self.df.schema["value"].dataType) if zero is None else F.lit(zero)
        return c.merge(start, F.coalesce(c.aggregate("value"), start))

    def reduce(self, f: aggregators.Algebraic | str | Callable[[Any, Any], Any], zero: Any = None) -> Any:
        """A fold that starts from ``zero`` in every partition and again at the end.

        So a product is 0, the minimum of positive values is 0, and an empty dataset
        gives ``zero``. Named combiners run as native aggregates, any other callable
        as a Python fold of each partition. ``reduce_strict`` has no zero.
        """
        if callable(f) and not isinstance(f, aggregators.Algebraic):
            start = zero_of(self.df.schema["value"].dataType) if zero is None else zero
            return self.df.select("value").rdd.map(lambda r: r[0]).fold(start, f)
        return self.df.agg(self.reduce_expr(f, zero).alias("r")).first()[0]

    def reduce_strict(self, f: aggregators.Algebraic | str | Callable[[Any, Any], Any]) -> Any:
        """A reduction without zero; raises ValueError when there are no values."""
        if callable(f) and not isinstance(f, aggregators.Algebraic):
            return self.df.select("value").rdd.map(lambda r: r[0]).reduce(f)
        c = aggregators.BY_NAME[f] if isinstance(f, str) else f
        n, r = self.df.agg(F.count("value"), c.aggregate("value")).first()
        if not n:
            raise ValueError("reduce_strict of an empty dataset")
        return r

    def count_by_slice(self) -> DataFrame:
        """``slice`` and ``n``: rows of each slice, or of each partition where there is no layout; those
        without rows don't appear."""
        own = F.col(SLICE) if SLICE in self.df.columns else F.spark_partition_id()
        return self.df.groupBy(own.alias("slice")).agg(F.count(F.lit(1)).alias("n"))

    def run_job(self, func: Callable[[Iterator[Any]], Any], partitions: Sequence[int] | None = None) -> list[Any]:
        """``func`` over each slice's values; results in the order of ``partitions``.

        With a slice layout only the rows of chosen slices are shuffled, and slices
        that hold no rows are called with an empty iterator. Otherwise partitions are
        those of the DataFrame.
        """
        if SLICE in self.df.columns and self.num_slices is not None:
            wanted = list(range(self.num_slices) if partitions is None else partitions)
            return opaque.per_slice(self.df, SLICE, POS, wanted, func)
        values = self.df.select("value").rdd.map(lambda r: r[0])
        return self.df.sparkSession.sparkContext.runJob(values, lambda it: [func(it)], None if partitions is None else list(partitions))

    def slices(self) -> DataFrame:
        """``slice`` and its values in order, empty slices included."""
        spark = self.df.sparkSession
        ids = spark.range(self.num_slices).select(F.col("id").cast("int").alias(SLICE))
        lists = self.df.groupBy(SLICE).agg(F.sort_array(F.collect_list(F.struct(POS, "value"))).alias("v"))
        return ids.join(lists, SLICE, "left").select(F.col(SLICE).alias("slice"), F.coalesce(F.col("v.value"), F.array()).alias("values"))

    def get_num_slices(self) -> int:
        return self.num_slices if self.num_slices is not None else self.df.rdd.getNumPartitions()

    def positions(self, i: int) -> list[int]:
        if self.size is None or self.num_slices is None:
            raise ValueError("only a source with a known size has slice positions")
        return slice_positions(i, self.size, self.num_slices)
