"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``2*r + 1`` bits differ
in at most ``r`` bits in one of their two 32-bit segments. With ``r = 1`` every fingerprint
is stored in one table for each segment, and the ball of radius 1 around its segment is
enumerated; of the two ends of a link only the one whose bit is 0 probes, so each link is
met once. What shares a table entry is verified over the complete 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Tables, components, counted, one_of_equal, text_hash, tidy

#: Shingles whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 15
#: Table entries with more fingerprints than this are refined and dealt in blocks.
BUCKET = 2048
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give 0."""
    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(toks)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < words:
        return digest(b" ".join(toks), SEED)
    joined = b" ".join(toks)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    bits = np.zeros(64, np.int64)
    total = n - words + 1
    for i in range(0, total, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], np.uint64)
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, th, fp): one row for each input row; th is a hash of the text, which tells rows that share
    an id apart; fp holds the 64 bits in a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text")).alias("th"))
    return rows.mapInArrow(tidy(_fingerprints(words)), "doc_id long, th long, fp long")


def _grow(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the link graph over one entry's fingerprints: grows each component by
    comparing a member with those not yet reached, so no edge list of all pairs is made."""
    edges, rest = [], fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                edges.append((np.full(len(found), x), found))
                front.extend(found)
                rest = rest[~near]
    return edges


def _entries(bits: int, n_keys: int):
    """Rows come sorted by their keys; an entry may span Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: np.ndarray | None = None  # rows of the last entry, which the next batch may go on with

        def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((rows[1:, :n_keys] != rows[:-1, :n_keys]).any(axis=1)) + 1
            got = []
            for g in np.split(rows[:, n_keys], cut):
                if len(g) > 1:
                    u = np.unique(g).view(np.uint64)
                    if len(u) > 1:
                        got += _grow(u, bits)
            if got:
                a, b = (np.concatenate([e[i] for e in got]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if left is not None:
                rows = np.concatenate([left, rows])
            start = int(np.flatnonzero((rows[:, :n_keys] == rows[-1, :n_keys]).all(axis=1))[0])
            left = rows[start:]
            if start:
                yield from edges(rows[:start])
        if left is not None and len(left) > 1:
            yield from edges(left)

    return run


def _linked(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Verified edges among rows that agree in ``keys`` (all longs), which no group of unbounded size does."""
    dealt = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(_entries(bits, len(keys))), "a long, b long")


def _segment(fp: Column, seg: Column) -> Column:
    return F.when(seg == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def links(fps: DataFrame, tables: Tables, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fps`` (fp): enough to connect all that link
    through chains at ``bits`` or fewer differing bits, each of them verified.

    Entries of more than ``bucket`` fingerprints are refined by the bytes of the other
    segment (of which one is equal in every link), then cut in blocks of at most ``bucket``
    rows, and every pair of blocks is one group: no cap, and no group of unbounded size.

    The slots are 66 rows for each fingerprint, but Spark takes them for as many bytes as the
    fingerprints' file has: left alone it broadcasts them from the driver, so the join is named.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius 1 find links of at most 3 bits")
    # slot 32 of a segment is its table row, slots 0..31 are the ball
    slots = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("p")).withColumn("seg", F.floor(F.col("p") / 33)).withColumn("r", F.col("p") % 33)
    own = slots.withColumn("own", _segment(F.col("fp"), F.col("seg")))
    table = F.col("r") == 32
    one = F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.col("r").cast("int"))
    keyed = own.where(table | (F.col("own").bitwiseAND(bit) == 0)).select("seg", F.when(table, F.col("own")).otherwise(F.col("own").bitwiseOR(bit)).alias("key"), "fp", table.alias("stored"))
    live = keyed.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"), F.max("stored").alias("stored")).where("n > 1 and stored").drop("stored")
    cand = tables.write(keyed.join(live.hint("merge"), ["seg", "key"]).select("seg", "key", "fp", "n"), "entries")
    cold = _linked(cand.where(F.col("n") <= bucket), ["seg", "key"], bits)
    hot = cand.where(F.col("n") > bucket)
    other = _segment(F.col("fp"), 1 - F.col("seg"))
    byte = F.call_function("shiftright", other, (F.col("sub") * 8).cast("int")).bitwiseAND(F.lit(255))
    refined = hot.select("seg", "key", "fp", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("sub")).withColumn("byte", byte)
    sub = ["seg", "key", "sub", "byte"]
    sizes = refined.groupBy(*sub).agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket / 2)).alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = counted(tables.write(sizes, "sizes"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = refined.join(sizes, sub).withColumn("mine", mine).select(*sub, "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    blocks = dealt.select(*sub, "fp", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
    warm = _linked(blocks, [*sub, "i", "j"], bits)
    return cold.unionByName(warm)


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts have fingerprint 0 and link like any other. ``component_id`` is the
    smallest doc_id reachable. Rows that repeat a doc_id are each fingerprinted and appear
    each; a null doc_id is carried along and is never a component's id unless nothing else is
    there. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "simhash")
    prints = tables.write(fingerprints(docs, words), "prints")
    ids = _firsts(prints, tables, bits, bucket).select("fp", F.col("first.doc_id").alias("component_id"))
    return prints.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _firsts(prints: DataFrame, tables: Tables, bits: int, bucket: int = BUCKET) -> DataFrame:
    """fp and the first row (doc_id, th; null ids come last) of its component."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = tables.write(prints.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    comp = tables.write(components(links(classes.select("fp"), tables, bits, bucket), tables), "components")
    rooted = classes.join(counted(comp.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "first")


def one_of_each(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with all its columns, and one row of each component: the one with the smallest id (of
    rows that share it, the one whose text has the smallest hash; of equal rows any; rows without an
    id come last)."""
    tables = Tables(docs.sparkSession, "simhash")
    docs = one_of_equal(docs, tables)
    prints = tables.write(fingerprints(docs, words), "prints")
    gone = prints.join(_firsts(prints, tables, bits).hint("merge"), "fp").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select("doc_id", "th")
    d, g = docs.alias("d"), counted(tables.write(gone, "gone")).alias("g")
    return d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (text_hash(F.col("d.text")) == F.col("g.th")), "left_anti")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
