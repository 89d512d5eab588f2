"""Best-fit packing of token sequences, by hierarchical residual packing.

Pieces are dealt at random to groups, each of which packs its own best-fit decreasing and
closes the bins that are nearly full. Underfull bins become items of the next round, where
the bins of several groups meet in one, until a single group is left. A group never holds
more than about ``GROUP`` bins: where more stay open, they are dealt anew each round, until
a round saves less than one bin in ``GAIN``. Only numbers take part, never tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Tables, tidy
from weftline.llm.tokens import encoder

#: Partitions (or groups) whose underfull bins meet in one group of the next round.
FAN_IN = 8
#: Pieces or bins of a group, about; and a round that saves less than one open bin in so many is the last.
GROUP, GAIN = 100_000, 2000
#: Bins with this many free tokens or fewer are closed at once.
SLACK = 0
#: Cached words of a generation: as many as a few bulks of texts hold (without the marks after them).
WORDS = 240_000
END_ID = 0


def cut(ids_raw: bytes, dtype: np.dtype, capacity: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids as little-endian unsigned 32-bit) of one document with its end id."""
    ids = np.append(np.frombuffer(ids_raw, dtype).astype("<u4"), np.uint32(END_ID)).astype("<u4")
    for k, start in enumerate(range(0, len(ids), capacity)):
        own = ids[start : start + capacity]
        yield k, start, len(own), own.tobytes()


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, WORDS)
        for b in batches:
            cols: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for doc, raw in zip(b.column(0).to_pylist(), enc.many(t.as_py() for t in b.column(1)), strict=True):
                for k, start, n, ids in cut(raw, enc.dtype, capacity):
                    row = (doc, k, start, n, zlib.crc32(ids), ids)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts (null: empty) with the end id; only longer documents are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_pieces(path, capacity, with_ids)), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and the fill of each bin.

    Open bins are kept by free space, and a bit mask finds the tightest one that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for i in order.tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = free - n
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pack_partition(capacity: int, at: int):
    """Items of one partition with their bin, offset and the bin's fill; lengths are in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        bins, offsets, fills = best_fit(t.column(at).to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 36
        for c in (base + bins, offsets, fills[bins]):
            t = t.append_column(f"x{t.num_columns}", pa.array(c))
        yield from t.combine_chunks().to_batches(1 << 16)

    return run


def _merge(capacity: int, round_no: int):
    """Underfull bins of some groups as items: (bin, into, shift, fill), fill that of the new bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        group, ids, fill = (t.column(c).to_numpy() for c in ("grp", "bin", "fill"))
        order = np.lexsort((ids, group))  # the result doesn't depend on the order of arrival
        group, ids, fill = group[order], ids[order], fill[order]
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1):
            bins, offsets, fills = best_fit(fill[part], capacity)
            into = (1 << 62) | (round_no << 56) | (group[part] << 34) | bins
            cols = [ids[part], into, offsets, fills[bins]]
            yield from pa.Table.from_arrays([pa.array(c) for c in cols], names=["bin", "into", "shift", "fill"]).to_batches(1 << 16)

    return run


def pack(items: DataFrame, capacity: int = 2048, fan_in: int = FAN_IN, group: int = GROUP, slack: int = SLACK, tables: Tables | None = None) -> DataFrame:
    """``items`` (``length`` long from 1 to ``capacity``, and any columns to carry, whatever their
    names) with ``sequence_id`` and ``offset``, which replace columns of these names: sequences of
    at most ``capacity``, gapless from 0.

    Each row is packed once, whatever it holds (repeated rows, null ids); no rows give no
    sequences. Rows are dealt by a number that is written with them, and order within a group is
    fixed by the bins' numbers, so a task that runs again gives the same bins.
    """
    tables = tables or Tables(items.sparkSession, "packing")
    items = items.drop("sequence_id", "offset")
    names, n_cols = items.columns, len(items.columns)
    numbered = tables.write(items.toDF(*[f"c{i}" for i in range(n_cols)]).withColumn("n", F.monotonically_increasing_id()), "numbered")
    n_groups = max(1, -(-numbered.count() // group))
    dealt = numbered.repartition(n_groups, F.xxhash64("n")).sortWithinPartitions("n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    packed = tables.write(dealt.mapInArrow(_pack_partition(capacity, names.index("length")), f"{kinds}, bin long, at long, fill long"), "local")
    level = tables.write(packed.where(F.col("fill") < capacity - slack).select("bin", "fill").distinct(), "open-0")
    open_bins, maps = level.count(), []
    for k in range(1, 60):
        if open_bins <= 1 or n_groups == 1:
            break
        n_groups = max(-(-n_groups // fan_in), -(-open_bins // group))
        met = level.withColumn("grp", F.pmod(F.xxhash64(F.lit(k), "bin"), F.lit(n_groups)))
        step = tables.write(met.repartition(n_groups, "grp").mapInArrow(_merge(capacity, k), "bin long, into long, shift long, fill long"), f"round-{k}")
        maps.append(step.select("bin", "into", "shift"))
        level = tables.write(step.where(F.col("fill") < capacity - slack).select(F.col("into").alias("bin"), "fill").distinct(), f"open-{k}")
        made = step.select("into").distinct().count()
        small = made > open_bins - open_bins / GAIN and n_groups <= -(-open_bins // group)
        open_bins = level.count()
        if small:
            break
    total = None
    for step in reversed(maps):  # where each bin of a round ends up, from the last round back
        if total is None:
            total = step
        else:
            up = total.select(F.col("bin").alias("_b"), F.col("into").alias("_i"), F.col("shift").alias("_s"))
            total = step.join(up, F.col("into") == F.col("_b"), "left").select("bin", F.coalesce("_i", "into").alias("into"), (F.col("shift") + F.coalesce("_s", F.lit(0))).alias("shift"))
    carried = [f"c{i}" for i in range(n_cols)]
    if total is None:
        out = packed.select(*carried, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    else:
        out = packed.join(total, "bin", "left").select(*carried, F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return out.toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, fan_in: int = FAN_IN) -> DataFrame:
    """Whole documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives its end id alone. Repeated rows are packed each. Other
    columns are not read. Equal inputs in equal files give equal results.
    """
    tables = Tables(docs.sparkSession, "packing")
    cut_up = tables.write(pieces(docs, path, capacity), "pieces")
    return pack(cut_up, capacity, fan_in, tables=tables)
