"""Shared pieces: the shared folder, written intermediate tables, and distributed components."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SHARED = "file:///tmp/checkpoints/weftline"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without it a local folder
    serves where all is one machine; on a cluster that's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


_open: list[list[str]] = []


def unique() -> str:
    return uuid.uuid4().hex


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of the tables that operators called inside make; other results' tables aren't in it.
    They may go (``sweep``) once the operators' results are written elsewhere."""
    roots: list[str] = []
    _open.append(roots)
    try:
        yield roots
    finally:
        _open.remove(roots)


def sweep(spark: SparkSession, roots: list[str]) -> None:
    """Delete folders that ``collected`` gathered."""
    while roots:
        delete(spark, roots.pop())


#: Bytes of texts that one Arrow batch to or from Python holds, more or less.
BATCH_BYTES = 4 << 20


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back: Spark keeps Python workers for the next tasks, of whatever operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A mapInArrow function whose memory is given back when its task ends, and whose results leave in
    batches of about ``BATCH_BYTES``."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in run(batches):
                n = max(1, b.num_rows * BATCH_BYTES // max(BATCH_BYTES, b.nbytes))
                for i in range(0, max(1, b.num_rows), n):
                    yield b.slice(i, n)
        finally:
            b = None
            release()

    return own


class Tables:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors.

    A table is read back from files, so a lost executor costs nothing that was written.
    ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{unique()}", 0
        for roots in _open:
            roots.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_weft_path", None):
                delete(self.spark, path)


#: Rows of a table that is broadcast, and that the driver so holds: some MB.
BROADCAST_ROWS = 1 << 14


def counted(table: DataFrame) -> DataFrame:
    """A written table as the right side of a join: broadcast if it is counted as small, else sorted and
    merged. Spark's own choice goes by the bytes of files, in which columns that repeat take hardly any."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def one_of_equal(docs: DataFrame, tables: Tables, where: Column | None = None) -> DataFrame:
    """Of rows that are equal in doc_id and text (and fulfil ``where``) one stays, so that id and text
    name a row. Only rows that do repeat are regrouped, with partial aggregation."""
    keys = docs if where is None else docs.where(where)
    keys = keys.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("th")).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"))
    twice = tables.write(keys.where("n > 1").select("id", "th"), "repeats")
    if twice.isEmpty():
        return docs
    d, t = docs.alias("d"), counted(twice).alias("t")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("t.id")) & (text_hash(F.col("d.text")) == F.col("t.th"))
    some = d.join(t, on, "left_semi")
    first = some.groupBy(some["doc_id"].alias("_id"), text_hash(some["text"]).alias("_th")).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("_row"))
    return d.join(t, on, "left_anti").unionByName(first.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges at hand: each node but a root once, with its root (the smallest)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    parent = np.arange(len(nodes))
    while True:  # hooking to the smaller root and pointer jumping, vectorised
        rx, ry = parent[x], parent[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        live = lo != hi
        if not live.any():
            break
        np.minimum.at(parent, hi[live], lo[live])
        while (jumped := parent[parent]).tolist() != parent.tolist() if len(parent) < 8 else not np.array_equal(jumped := parent[parent], parent):
            parent = jumped
    own = parent != np.arange(len(nodes))
    return nodes[own], nodes[parent[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by a spanning forest, a bounded number of edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        a, b = spanning_forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= 1 << 20:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of the edges, which all come to this task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = spanning_forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        top = np.unique(roots)
        cols = [np.concatenate([nodes, top]), np.concatenate([roots, top])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "root"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the ``m`` that ``least`` (a, m) has for a."""
    flip = F.bitwise_not("a").alias("_na")
    return edges.select("a", "b", flip).join(least.select(flip, "m"), "_na").select("a", "b", "m")


#: Edges (16 bytes each) that one task makes components of; of more the rounds take care.
FEW_EDGES = 1 << 19


def components(edges: DataFrame, tables: Tables, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs): (node, root), root the smallest node.

    Distributed union-find: partitions first replace their edges by a spanning forest,
    then large-star and small-star rounds (each node's neighbours are re-hung under the
    smallest one) run until nothing changes. Every round writes its edges to the shared
    folder. Joins are on a node's minimum, so a node with many neighbours is never
    gathered in one row; and they are on the complement of its number, which no aggregate
    is dealt by, so both sides are dealt for the join alone and adaptive execution may split
    such a node between tasks. Only nodes that have an edge are returned.

    A round has some ten exchanges, for each of which the driver starts a thread that it keeps for a
    minute, and the status of each of their tasks: a forest counted as at most ``few`` edges is
    settled by one task instead, which reads it without any.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    cur = tables.write(e.mapInArrow(tidy(_contract), "a long, b long").distinct(), "forest")
    if cur.limit(few + 1).count() <= few:
        return cur.coalesce(1).mapInArrow(tidy(_settle), "node long, root long")
    last = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, small_min).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_min.select("a", F.col("m").alias("b")))
        new = tables.write(small.where("a != b").distinct(), "star")
        tables.drop(cur)
        cur = new
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        last = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
