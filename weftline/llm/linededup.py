"""Fuzzy line deduplication by MinHash.

Lines are sets of character shingles. Signatures of ``BANDS`` x ``ROWS`` min-hashes put
lines in one bucket for each band; lines that share a bucket are verified by the exact
Jaccard similarity of their shingles; links make components by distributed union-find, of
which the first line stays.

Equal lines are one class from the start (64-bit keys), and only classes that share a
bucket with another one ever fetch their text. Buckets are verified in two rounds: the
second one skips buckets whose lines the first has already connected. A bucket grows each
component from a member, so links are found without making all pairs; in a bucket of many
lines one line is compared with all, and only lines it doesn't reach meet the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Tables, components, one_of_equal, text_hash, tidy

SHINGLE, LEAST = 5, 0.8
#: Two lines at 0.8 share no bucket once in 110, at 0.85 once in 2,300, at 0.9 once in 450,000;
#: lines at 0.05, as unrelated ones are, share one twice in a hundred million.
BANDS, ROWS = 20, 7
#: Bands of the first round.
FIRST_BANDS = 3
#: Lines of a bucket that are verified together.
BUCKET = 1024
#: Lines of a bucket up to which their shingle sets are compared two by two.
FEW = 16
#: Bits of the filter that spares texts without candidates the shuffle. It is of fixed size: beyond
#: a few million candidate lines it lets more lines through, which the join then drops.
FILTER_BITS = 1 << 25
#: Shingles hashed at once, and keys a task remembers to skip repeats.
BLOCK, SEEN = 1 << 16, 400_000
#: Bytes of a (band, key) pair, pairs that a task packs at once, input that makes one group of bands, and
#: the most bits of a group's number: a million groups, of some 100 MB each when the input has 100 TB.
PAIR, PACKED, GROUP_BYTES, MOST_BITS = 16, 1 << 19, 1 << 20, 20
STRIP = " \t\r\f\v"

_rng = np.random.default_rng(20)
_POWERS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def key_of(line: str) -> int:
    """Signed 64-bit key of a stripped line."""
    k = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return k - (1 << 64) if k >> 63 else k


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """Number and stripped text of each line that isn't blank."""
    for i, line in enumerate((text or "").split("\n")):
        if line := line.strip(STRIP):
            yield i, line


def shingles(line: str) -> np.ndarray:
    """Distinct hashes (64 bits) of a line's shingles; a shorter line is its only shingle."""
    h = _hashes(np.frombuffer(line.ljust(SHINGLE, "\0").encode("utf-32-le", "surrogatepass"), "<u4"))
    h.sort()  # np.unique would build a hash table, which takes three times as long
    return h[np.r_[True, h[1:] != h[:-1]]]


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets share."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _hashes(cp: np.ndarray) -> np.ndarray:
    c, n = cp.astype(np.uint64), len(cp) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = c[:n] * _POWERS[0]
        for k in range(1, SHINGLE):
            h += c[k : k + n] * _POWERS[k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def signatures(lines: list[str]) -> np.ndarray:
    """Min-hashes of each line, one row a line."""
    padded = [x.ljust(SHINGLE, "\0") for x in lines]
    out = np.full((len(lines), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(size)
    # the hash of a shingle that would cross into the next line is left out
    h = _hashes(cp).astype(np.uint32) if len(cp) else np.zeros(0, np.uint32)
    inside = np.ones(len(h) + SHINGLE - 1, bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    base = h[inside[: len(h)]]
    starts = np.concatenate(([0], np.cumsum(size - SHINGLE + 1)))
    for a, b in _spans(starts):
        own, at = base[starts[a] : starts[b]], starts[a:b] - starts[a]
        if b > a + 1:
            tmp, low = np.empty_like(own), np.empty((BANDS * ROWS, b - a), np.uint32)
            for p in range(BANDS * ROWS):
                np.multiply(own, _MUL[p], out=tmp)
                np.minimum.reduceat(tmp, at, out=low[p])
            out[a:b] = low.T
        else:  # one line, however long, in parts
            for lo in range(0, len(own), BLOCK):
                part = own[lo : lo + BLOCK]
                np.minimum(out[a], [(part * m).min() for m in _MUL], out=out[a])
    return out


def _spans(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines of about ``BLOCK`` shingles."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each line and band; its lowest 5 bits are the band's number."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            acc = (acc ^ (acc >> np.uint64(29)) ^ v[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (acc ^ (acc >> np.uint64(32))) & ~np.uint64(31)
    return (mixed | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def bucket_bits(docs: DataFrame) -> int:
    """Leading bits of a band's key that deal it to a group of bands; groups of the size that about
    ``GROUP_BYTES`` of input make."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BITS, max(0, (size // GROUP_BYTES).bit_length()))


def _bands(bits: int):
    """(grp, data): pairs (band, key) of each line that this partition hasn't met yet, packed by group of
    bands, so that the shuffle moves few rows of many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[str] = []
        keys: list[int] = []
        size, n = 0, 0
        got: list[np.ndarray] = []

        def sign() -> None:
            nonlocal held, keys, size, n
            bands = band_keys(signatures(held)).ravel()
            got.append(np.stack([bands, np.repeat(np.array(keys, np.int64), BANDS)], axis=1))
            n += len(bands)
            held, keys, size = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal got, n
            pairs = np.concatenate(got)
            got, n = [], 0
            grp = pairs[:, 0].view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(pairs), np.uint64)
            order = np.argsort(grp)
            pairs, grp = pairs[order], grp[order]
            cut = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            ends = np.r_[cut, len(pairs)].astype(np.int32) * np.int32(PAIR)
            data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
            return pa.RecordBatch.from_arrays([pa.array(grp[cut].astype(np.int32)), data], names=["grp", "data"])

        for batch in batches:
            for t in batch.column(0):
                for _, line in lines_of(t.as_py()):
                    k = key_of(line)
                    if k in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
                    held.append(line)
                    keys.append(k)
                    size += len(line)
                    if size >= 2 * BLOCK:
                        sign()
                        if n >= PACKED:
                            yield out()
        if held:
            sign()
        if n:
            yield out()

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, b, key, n) of buckets of two or more different keys, each key once, with their number.
    Rows come sorted by group; one group's pairs are held at a time."""
    held: list[np.ndarray] = []
    last = None

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.argsort(rows[:, 0])]
        new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        rows = rows[~(new & np.r_[new[1:], True])]  # most rows are alone
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)]]
        start = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]][: len(rows)])
        n = np.diff(np.r_[start, len(rows)])
        n = np.repeat(n, n)
        many = n > 1
        return pa.RecordBatch.from_arrays([pa.array(rows[many, 0]), pa.array((rows[many, 0] & 31).astype(np.int8)), pa.array(rows[many, 1]), pa.array(n[many])], names=["band", "b", "key", "n"])

    for batch in batches:
        for grp, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if grp != last and held:
                yield out()
            last = grp
            held.append(np.frombuffer(data.as_py(), np.int64).reshape(-1, 2))
    if held:
        yield out()


def _filter_words(keys: np.ndarray) -> np.ndarray:
    u = keys.astype(np.int64).view(np.uint64)
    return np.stack([(u & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)])


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        at = _filter_words(b.column(0).to_numpy()).ravel()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    words = bits.view("<i8")
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])


def key_filter(live: DataFrame) -> np.ndarray:
    """A filter over the live keys, at most ``FILTER_BITS`` bits whatever their number."""
    got = live.select("key").mapInArrow(tidy(_filter_bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, "<i8")
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return words.view(np.uint8)


def _positions(filter_var):
    """(doc_id, th, line_no, key, text): the text only where the filter knows the key, once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_var.value
        sent: set[int] = set()
        for b in batches:
            rows, nos, keys, texts = [], [], [], []
            for row, t in enumerate(b.column(1)):
                for i, line in lines_of(t.as_py()):
                    rows.append(row)
                    nos.append(i)
                    keys.append(key_of(line))
                    texts.append(line)
            k = np.array(keys, np.int64)
            at = _filter_words(k)
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0) if len(k) else np.zeros(0, bool)
            if len(sent) > SEEN:
                sent.clear()
            for i, h in enumerate(hit.tolist()):
                if not h or keys[i] in sent:
                    texts[i] = None
                else:
                    sent.add(keys[i])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(nos, pa.int32()), pa.array(k), pa.array(texts, pa.string())], names=["doc_id", "th", "line_no", "key", "text"])

    return run


def grow(keys: np.ndarray, comps: np.ndarray, lines: list[str], least: float) -> list[tuple[int, int]]:
    """Verified links that connect the lines of a bucket as all pairs of at least ``least`` would.
    Lines of one component already (``comps``) aren't compared."""
    sets = [shingles(x) for x in lines]
    size = np.array([len(s) for s in sets])
    many = len(sets) > FEW  # then shingles are numbered, and a line's are marked for all others at once
    if many:
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        mark = np.zeros(int(ids.max()) + 1, bool)

    def shared(x: int, at: np.ndarray) -> np.ndarray:
        if not many:
            return np.array([in_common(sets[x], sets[i]) for i in at.tolist()])
        own, n = ids[starts[x] : starts[x] + size[x]], size[at]
        mark[own] = True
        pos = np.repeat(starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.add.reduceat(mark[ids[pos]].astype(np.int64), np.cumsum(n) - n)
        mark[own] = False
        return both

    rest, edges = np.arange(len(keys)), []
    while len(rest) > 1:
        front = [int(rest[0])]
        rest = rest[1:]
        while front and len(rest):
            x = front.pop()
            near = comps[rest] == comps[x]
            fit = ~near & (np.minimum(size[rest], size[x]) >= least * np.maximum(size[rest], size[x]))
            if fit.any():
                at = rest[fit]
                both = shared(x, at)
                ok = both >= least * (size[at] + size[x] - both) - 1e-9
                near[np.flatnonzero(fit)[ok]] = True
                edges += [(int(keys[x]), int(keys[i])) for i in at[ok].tolist()]
            if near.any():
                front += rest[near].tolist()
                rest = rest[~near]
    return edges


def _verify(least: float):
    """Rows (band, i, j, key, comp, text) sorted by their first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, comps, texts, last = [], [], [], None
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if len(keys) > 1 and len(set(comps)) > 1:
                edges.extend(grow(np.array(keys), np.array(comps), texts, least))

        def out() -> pa.RecordBatch:
            e = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

        for b in batches:
            for band, i, j, key, comp, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (band, i, j) != last:
                    close()
                    keys, comps, texts, last = [], [], [], (band, i, j)
                keys.append(key)
                comps.append(comp)
                texts.append(text)
            if len(edges) > 50_000:
                yield out()
                edges.clear()
        close()
        yield out()

    return run


def _reached(least: float):
    """Which lines are as close to the pivot of their bucket (last two columns: its key and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, np.ndarray] = {}
        for b in batches:
            ok = []
            for text, pkey, ptext in zip(*[b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1)], strict=True):
                if (p := pivots.get(pkey)) is None:
                    if len(pivots) > 64:
                        pivots.clear()
                    p = pivots[pkey] = shingles(ptext)
                s = shingles(text)
                both = in_common(p, s) if min(len(p), len(s)) >= least * max(len(p), len(s)) else 0
                ok.append(both >= least * (len(p) + len(s) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], b.column(b.num_columns - 2), pa.array(ok, pa.bool_())], names=["band", "key", "comp", "pcomp", "pkey", "ok"])

    return run


def _edges(buckets: DataFrame, texts: DataFrame, least: float, bucket: int, tables: Tables) -> DataFrame:
    """Verified links of ``buckets`` (band, key, comp, n) that connect what all pairs would.

    Near copies meet in most bands, so buckets of the very same lines (equal XORs of two hashes
    of their keys, which can't overflow as sums do) are verified once. Of a bucket of more than
    ``bucket`` lines one, the pivot, is compared with all. The lines it reaches are connected, so
    only pairs with an unreached line are left; these are looked at in blocks.
    """
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"s{i}") for i in (1, 2)]
    same = buckets.groupBy("band").agg(*sums, F.count(F.lit(1)).alias("m"))
    once = same.groupBy("s1", "s2", "m").agg(F.min("band").alias("band")).select("band")
    kept = tables.write(buckets.join(once, "band"), "kept")
    none = F.lit(0).cast("long")
    dealt = kept.where(F.col("n") <= bucket).select("band", none.alias("i"), none.alias("j"), "key", "comp")
    crowded, links = kept.where(F.col("n") > bucket).select("band", "key", "comp"), None
    if not crowded.isEmpty():
        pivot = crowded.groupBy("band").agg(F.min_by(F.struct("key", "comp"), F.xxhash64("key")).alias("p")).select("band", F.col("p.key").alias("pkey"), F.col("p.comp").alias("pcomp"))
        pivot = pivot.join(texts.select(F.col("key").alias("pkey"), F.col("text").alias("ptext")), "pkey").select("band", "pcomp", "pkey", "ptext")
        met = crowded.join(texts, "key").join(pivot, "band").select("band", "key", "comp", "pcomp", "text", "pkey", "ptext")
        near = tables.write(met.mapInArrow(tidy(_reached(least)), "band long, key long, comp long, pcomp long, pkey long, ok boolean"), "near")
        links = near.where("ok and key != pkey").select(F.col("pkey").alias("a"), F.col("key").alias("b"))
        near = near.withColumn("ok", F.col("ok") | (F.col("comp") == F.col("pcomp")))
        many = lambda c: F.ceil(F.sum(c) * 2 / bucket).cast("long")
        sizes = near.groupBy("band").agg(many(F.when(F.col("ok"), 0).otherwise(1)).alias("far"), many(F.when(F.col("ok"), 1).otherwise(0)).alias("by"))
        rows = near.join(sizes.where("far > 0"), "band")
        mine = F.when(F.col("ok"), F.col("far") + F.pmod(F.xxhash64("key"), F.col("by"))).otherwise(F.pmod(F.xxhash64("key"), F.col("far")))
        others = F.sequence(none, F.when(F.col("ok"), F.col("far")).otherwise(F.col("far") + F.col("by")) - 1)
        placed = rows.select("band", "key", F.when(F.col("ok"), F.col("pcomp")).otherwise(F.col("comp")).alias("comp"), mine.alias("mine"), F.explode(others).alias("o"))
        dealt = dealt.unionByName(placed.select("band", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "key", "comp"))
    rows = dealt.join(texts, "key").select("band", "i", "j", "key", "comp", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    found = rows.mapInArrow(tidy(_verify(least)), "a long, b long")
    return found if links is None else found.unionByName(links)


def line_classes(docs: DataFrame, least: float = LEAST, bucket: int = BUCKET, tables: Tables | None = None) -> DataFrame:
    """One row for each line that isn't blank: doc_id, line_no (from 0), first_doc_id and first_line_no
    (the first line of its component in order of doc_id and number) and kept.

    Lines are cut at line feeds and compared without white space at their ends. Null and empty
    texts have no lines. Rows that share a doc_id are told apart by a hash of their texts, which
    also orders them; rows equal in both share their positions and are kept alike. Null ids come
    first. Other columns aren't read. Keys have 64 bits: two different lines share one with a
    chance of n^2 / 2^65.
    """
    return _classes(docs, least, bucket, tables or Tables(docs.sparkSession, "linededup")).drop("th")


def _classes(docs: DataFrame, least: float, bucket: int, tables: Tables) -> DataFrame:
    """``line_classes`` with th, the hash of each line's text."""
    spark: SparkSession = docs.sparkSession
    texts_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text")).alias("th"))
    banded = texts_in.select("text").mapInArrow(tidy(_bands(bucket_bits(texts_in))), "grp int, data binary")
    live = tables.write(banded.repartition("grp").sortWithinPartitions("grp").mapInArrow(tidy(_live), "band long, b byte, key long, n long"), "buckets")
    known = spark.sparkContext.broadcast(key_filter(live))
    lines = tables.write(texts_in.mapInArrow(tidy(_positions(known)), "doc_id long, th long, line_no int, key long, text string"), "lines")
    texts = tables.write(lines.where("text is not null").join(live.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")), "texts")
    first = tables.write(_edges(live.where(F.col("b") < FIRST_BANDS).select("band", "key", F.col("key").alias("comp"), "n"), texts, least, bucket, tables), "edges")
    comp = tables.write(components(first, tables), "first")
    later = live.where(F.col("b") >= FIRST_BANDS).join(comp.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("comp"), "n")
    open_ = later.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band")
    second = tables.write(_edges(later.join(open_, "band"), texts, least, bucket, tables), "edges")
    roots = tables.write(components(first.unionByName(second), tables), "roots").withColumnRenamed("node", "key")
    # places are summed up by line before they are by class, and each join reads written tables, so that
    # a line or a class with many places is split between tasks
    places = lines.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "th", "line_no")).alias("f"), F.count(F.lit(1)).alias("n"))
    rooted = places.join(roots, "key", "left").where("n > 1 or root is not null")
    many = tables.write(rooted.select("key", F.coalesce("root", "key").alias("cls"), "f"), "many")
    firsts = tables.write(many.groupBy("cls").agg(F.min("f").alias("f")), "firsts")
    heads = tables.write(many.select("key", "cls").join(firsts, "cls").select("key", "f"), "heads")
    out = lines.select("doc_id", "th", "line_no", "key").join(heads, "key", "left")
    mine = F.struct(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("line_no").alias("l"))
    head = F.when(F.col("f").isNotNull(), F.struct(F.col("f.doc_id").alias("d"), F.col("f.th").alias("t"), F.col("f.line_no").alias("l"))).otherwise(mine)
    return out.select("doc_id", "th", "line_no", head["d"].alias("first_doc_id"), head["l"].alias("first_line_no"), head.eqNullSafe(mine).alias("kept"))


def _without(names: list[str], schema: pa.Schema):
    """Texts without the lines listed in the last column; only texts that had a line and lose all go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for i, gone in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if gone:
                    drop = set(gone)
                    left = [x for k, x in enumerate(texts[i].split("\n")) if k not in drop]
                    texts[i] = "\n".join(left)
                    keep[i] = any(x.strip(STRIP) for x in left)
            cols = [pa.array(texts, schema.field(at).type) if k == at else b.column(k).cast(schema.field(k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema).filter(pa.array(keep))

    return run


def dedup_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with all its columns, texts without repeated lines; a document stays unless it had
    lines and loses every one. Rows that share a doc_id are judged each by its own text; of rows
    that are equal in both (and have a line) one stays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tables = Tables(docs.sparkSession, "linededup")
    docs = one_of_equal(docs, tables, F.col("text").rlike(f"[^{STRIP}\\n]"))
    gone = _classes(docs, least, BUCKET, tables).where("not kept").groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("gone"))
    d, g = docs.alias("d"), gone.alias("g")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (text_hash(F.col("d.text")) == F.col("g.th"))
    # by place: whatever names the columns have
    joined = d.join(g, on, "left").select("d.*", "g.gone").toDF(*[f"c{i}" for i in range(len(docs.columns) + 1)])
    return joined.mapInArrow(tidy(_without(docs.columns, to_arrow_schema(docs.schema))), docs.schema)
