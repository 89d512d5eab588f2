"""Token-id shards with a minimal perfect hash index for keyed access.

A shard is two files. ``ids-NNNNN.bin`` is the raw little-endian ids of its documents, one
after the other. ``ids-NNNNN.idx`` starts with a fixed header (magic, version, id width,
number of documents, distinct keys, hash levels, ids) and goes on with the arrays: keys in
file order, ids before each document (n + 1), the hash levels' sizes and bit words with the
ranks of each word, the keys no level could place, and for each hash slot the key's
fingerprint and first document. Looking a key up reads one bit in a few levels, one rank
and one fingerprint, whatever the shard's size.

Files are written under a task's own name and then renamed, so a task that is lost or run
twice leaves one whole shard. Shards go to the shared folder, through whichever file
system its address names.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Tables, tidy
from weftline.llm.tokens import encoder

MAGIC, VERSION = b"WEFTIDS1", 1
HEADER = struct.Struct("<8sIIQQIIQ")
LEVELS, GAMMA = 24, 2
#: Cached words of a generation: as many as a few bulks of texts hold (without the marks after them).
WORDS = 240_000
#: Bytes of neighbouring documents that one read fetches.
RANGE = 4 << 20
NULL_KEY = -(1 << 63)
END_ID = 0


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class PerfectHash:
    """Distinct 64-bit keys to 0..n-1 without gaps: a cascade of bit arrays, in each of which the
    keys that fall alone on a bit stay; ranks of bits number them."""

    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # all levels' bits
    ranks: np.ndarray  # bits set before each word
    rest: np.ndarray  # keys placed by no level, sorted

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.int64), [], []
        for k in range(LEVELS):
            if not len(left):
                break
            m = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = (mix(left.view(np.uint64), k) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(m)
            left = left[~alone]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, "<i8"), words, (np.cumsum(counts) - counts).astype("<i8"), np.sort(left).astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that wasn't there may get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_, before = np.arange(len(keys)), 0
        u = keys.astype(np.int64).view(np.uint64)
        for k, m in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = (mix(u[open_], k) % np.uint64(m)).astype(np.int64)
            w, bit = before // 64 + at // 64, (at % 64).astype(np.uint64)
            word = self.words[w]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[w] + below)[hit]
            open_ = open_[~hit]
            before += m
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            base = int(np.bitwise_count(self.words).sum())
            out[open_[hit]] = base + i[hit]
        return out


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 99) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """``keys`` in file order (repeats together), ``offsets``: n + 1 of them."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    own = keys[first]
    mph = PerfectHash.build(own)
    slot = mph.slots(own)
    fp, at = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    fp[slot], at[slot] = prints(own), first
    head = HEADER.pack(MAGIC, VERSION, width, len(keys), len(own), len(mph.sizes), len(mph.rest), int(offsets[-1]))
    return b"".join([head, keys.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), mph.sizes.tobytes(), struct.pack("<Q", len(mph.words)), mph.words.tobytes(), mph.ranks.tobytes(), mph.rest.tobytes(), fp.tobytes(), at.tobytes()])


class Shard:
    """A whole shard's index in memory, to read all of its documents."""

    def __init__(self, fs: pafs.FileSystem, stem: str):
        self.fs, self.stem = fs, stem
        with fs.open_input_file(f"{stem}.idx") as f:
            raw = f.readall()
        magic, version, width, self.n, self.n_keys, levels, rest, self.total = HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{stem}.idx is not a token index")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.dtype = np.dtype(f"<u{width}")
        self.keys, self.offsets, sizes = take("<i8", self.n), take("<i8", self.n + 1), take("<i8", levels)
        n_words = int(take("<u8", 1)[0])
        self.mph = PerfectHash(sizes, take("<u8", n_words), take("<i8", n_words), take("<i8", rest))
        self.fp, self.first = take("<u4", self.n_keys), take("<u4", self.n_keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, or -1. A stored fingerprint rejects foreign keys; the key
        itself is compared as well, so none slips through."""
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.fp[slot[ok]] == prints(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.first[slot[ok]]
        ok[ok] = self.keys[out[ok]] == keys[ok]
        out[~ok] = -1
        return out

    def read(self, f, at: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents ``at``, in that order; neighbours come with one read of up to ``RANGE`` bytes."""
        size, i = self.dtype.itemsize, 0
        while i < len(at):
            k = i + 1
            while k < len(at) and at[k] == at[k - 1] + 1 and (self.offsets[at[k] + 1] - self.offsets[at[i]]) * size <= RANGE:
                k += 1
            base = int(self.offsets[at[i]])
            f.seek(base * size)
            ids = np.frombuffer(f.read((int(self.offsets[at[k - 1] + 1]) - base) * size), self.dtype)
            for d in at[i:k].tolist():
                yield ids[self.offsets[d] - base : self.offsets[d + 1] - base]
            i = k


class _Places:
    """One shard's files, of which a look-up reads single numbers: a word of bits in a few levels, a
    rank, a fingerprint, a place, the key there and its offsets. Only the level sizes are kept."""

    def __init__(self, fs: pafs.FileSystem, stem: str):
        self.idx, self.bin = fs.open_input_file(f"{stem}.idx"), fs.open_input_file(f"{stem}.bin")
        magic, version, width, self.n, self.n_keys, levels, self.n_rest, _ = HEADER.unpack(self.idx.read_at(HEADER.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{stem}.idx is not a token index")
        self.dtype, self.reads = np.dtype(f"<u{width}"), 0
        self.keys = HEADER.size
        self.offsets = self.keys + 8 * self.n
        sizes = self.offsets + 8 * (self.n + 1)
        head = np.frombuffer(self.idx.read_at(8 * levels + 8, sizes), "<i8")
        self.sizes, self.n_words = head[:-1].tolist(), int(head[-1])
        self.words = sizes + 8 * levels + 8
        self.ranks = self.words + 8 * self.n_words
        self.rest = self.ranks + 8 * self.n_words
        self.fp = self.rest + 8 * self.n_rest
        self.first = self.fp + 4 * self.n_keys

    def number(self, kind: str, base: int, i: int) -> int:
        self.reads += 1
        width = int(kind[-1])
        return int(np.frombuffer(self.idx.read_at(width, base + width * i), kind)[0])

    def slot(self, key: int) -> int:
        u, before = np.array([key], np.int64).view(np.uint64), 0
        for k, m in enumerate(self.sizes):
            at = int(mix(u, k)[0] % np.uint64(m))
            word = self.number("<u8", self.words, before // 64 + at // 64)
            if word >> (at % 64) & 1:
                return self.number("<i8", self.ranks, before // 64 + at // 64) + (word & ((1 << at % 64) - 1)).bit_count()
            before += m
        lo, hi = 0, self.n_rest  # keys that no level placed, sorted: next to none
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.number("<i8", self.rest, mid) < key else (lo, mid)
        return self.n_keys - self.n_rest + lo if lo < self.n_rest else -1

    def documents(self, key: int) -> list[np.ndarray]:
        slot, out = self.slot(key), []
        if slot < 0 or self.number("<u4", self.fp, slot) != int(prints(np.array([key]))[0]):
            return out
        i = self.number("<u4", self.first, slot)
        while i < self.n and self.number("<i8", self.keys, i) == key:
            a, b = self.number("<i8", self.offsets, i), self.number("<i8", self.offsets, i + 1)
            out.append(np.frombuffer(self.bin.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype))
            i += 1
        return out


class Shards:
    """Keyed access to a whole set of shards: the manifest says which shard may hold a key."""

    def __init__(self, out: str, manifest: list):
        """``manifest``: the rows of ``write_shards``, one for each shard."""
        self.fs, self.root = file_system(out)
        own = sorted((m.first_key, m.last_key, m.shard) for m in manifest if m.n_docs)
        self.firsts, self.lasts, self.numbers = ([x[i] for x in own] for i in range(3))
        self.open: dict[int, _Places] = {}

    def documents(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document of a key (None: of those without an id)."""
        key, out = NULL_KEY if key is None else key, []
        i = bisect.bisect_right(self.firsts, key) - 1
        while i >= 0 and self.lasts[i] >= key:
            shard = self.numbers[i]
            if shard not in self.open:
                self.open[shard] = _Places(self.fs, f"{self.root}/ids-{shard:05d}")
            out = self.open[shard].documents(key) + out
            i -= 1
        return out


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; names of S3 that only Hadoop knows are put right."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _write(path: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, WORDS), TaskContext.get().partitionId()
        fs, root = file_system(out)
        stem = f"{root}/ids-{part:05d}"
        own = f"{root}/.{part:05d}-{uuid.uuid4().hex}"
        end = np.array([END_ID], enc.dtype).tobytes()
        keys, sizes = [], []
        with fs.open_output_stream(f"{own}.bin") as f:
            for b in batches:
                keys += [NULL_KEY if k is None else k for k in b.column(0).to_pylist()]
                for ids in enc.many(t.as_py() for t in b.column(1)):
                    raw = ids + end
                    f.write(raw)
                    sizes.append(len(raw) // enc.dtype.itemsize)
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int64)
        with fs.open_output_stream(f"{own}.idx") as f:
            f.write(index_bytes(np.array(keys, np.int64), offsets, enc.dtype.itemsize))
        for kind in ("bin", "idx"):
            _move(fs, f"{own}.{kind}", f"{stem}.{kind}")
        k = np.array(keys[:1] + keys[-1:] or [0, 0], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (part, len(keys), int(offsets[-1]), int(k[0]), int(k[-1]))], names=["shard", "n_docs", "n_tokens", "first_key", "last_key"])

    return run


def _move(fs: pafs.FileSystem, a: str, b: str) -> None:
    try:
        fs.move(a, b)
    except OSError:  # some stores don't rename over a file that another attempt left
        fs.delete_file(b)
        fs.move(a, b)


def write_shards(docs: DataFrame, path: str, out: str, shards: int | None = None) -> DataFrame:
    """Encode whole texts (null: empty), append the end id, and write shards in ascending doc_id order
    (null first) to folder ``out``. Returns the manifest: shard, n_docs, n_tokens, first_key,
    last_key; documents of a repeated doc_id stand together. An empty table gives empty shards.
    """
    fs, root = file_system(out)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = shards or max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return ordered.mapInArrow(tidy(_write(path, out)), "shard long, n_docs long, n_tokens long, first_key long, last_key long")


def _read(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(out)
        for b in batches:
            for part, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(fs, f"{root}/ids-{part:05d}")
                if not s.n:
                    continue
                at = s.find(s.keys)  # through the index, as a keyed reader would
                same = np.arange(s.n) - np.r_[0, np.maximum.accumulate(np.where(s.keys[1:] != s.keys[:-1], np.arange(1, s.n), 0))]
                at = at + same
                crc = np.zeros(s.n, np.int64)
                with fs.open_input_file(f"{s.stem}.bin") as f:
                    for i, ids in zip(at.tolist(), s.read(f, at), strict=True):
                        crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                keys = pa.array(s.keys, pa.int64(), mask=s.keys == NULL_KEY)
                cols = [keys, pa.array(before + s.offsets[at]), pa.array(s.offsets[at + 1] - s.offsets[at]), pa.array(crc[at])]
                yield from pa.Table.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(1 << 16)

    return run


def read_shards(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back through each shard's index.

    The driver holds one line for each shard (not for each document) to place the shards.
    """
    lines = sorted((r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in lines]))).tolist()
    placed = spark.createDataFrame([(s, int(b)) for (s, _), b in zip(lines, before, strict=False)], "shard long, before long")
    return placed.repartition(max(1, len(lines)), "shard").mapInArrow(tidy(_read(out)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """Write shards to the shared folder and read them back."""
    tables = Tables(docs.sparkSession, "tokens")
    out = tables.path("ids")
    manifest = tables.write(write_shards(docs, path, out, shards), "manifest")
    return read_shards(docs.sparkSession, manifest, out)
