"""Quality classifier with supervised subword embeddings.

A document is the mean of learned vectors of its words, of its word pairs and of the
character 3- and 4-grams inside words (word ends included), all hashed to one table; a
softmax layer gives the classes. A pair is hashed by the difference of its words' hashes,
so that all words said twice share one vector. Vectors and layer are trained together by stochastic gradient descent in
numpy. For scoring, each vector is folded with the layer into one number, which leaves
the same function: the logit is the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import supervised as sup
from weftline.llm.common import tidy

BITS, DIM, EPOCHS, RATE = 17, 10, 8, 1.0
#: Labelled documents of each class that a fit reads.
PER_CLASS = 2000
#: Code points hashed at once; bounds memory for very long texts.
BLOCK = 1 << 19

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(0x3001, bool)
_SPACE[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64."""
    inv = np.uint64(pow(int(_P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _P)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, inv)])
    return up, down


_POW: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def features(cp: np.ndarray, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word pairs and n-grams of a run of code points, and the position of each
    one's start. ``texts``: where texts in the run start; pairs stay inside one.

    The run has to begin and end with a space, which stands for the ends of words.
    """
    global _POW
    if len(_POW[0]) < len(cp) + 1:
        _POW = _powers(len(cp) + 1)
    shift = np.uint64(64 - BITS)
    space = (cp < len(_SPACE)) & _SPACE[np.minimum(cp, len(_SPACE) - 1)]
    with np.errstate(over="ignore"):
        c = np.where(space, np.uint64(1), cp.astype(np.uint64) + np.uint64(2)) * _MIX
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        total = np.r_[np.uint64(0), np.cumsum(c * _POW[0][: len(c)])]
        words = (total[ends] - total[starts]) * _POW[1][starts]
        n3 = c[:-2] + c[1:-1] * _P + c[2:] * (_P * _P)
        n4 = n3[:-1] + c[3:] * (_P * _P * _P)
        in3 = np.flatnonzero(~space[1:-1])
        in4 = np.flatnonzero(~(space[1:-2] | space[2:-1]))
        pairs, first = words[1:] - words[:-1], starts[:-1]
        if texts is not None and len(texts) > 1:
            which = np.searchsorted(texts, starts, "right")
            same = which[1:] == which[:-1]
            pairs, first = pairs[same], first[same]
        hashed = np.concatenate([words + np.uint64(1), pairs + np.uint64(2), n3[in3] + np.uint64(3), n4[in4] + np.uint64(4)])
        hashed ^= hashed >> np.uint64(29)
        buckets = (hashed * _MIX) >> shift
    return buckets.astype(np.int64), np.concatenate([starts, first, in3, in4])


def _runs(cp: np.ndarray) -> Iterator[np.ndarray]:
    """Long texts in runs cut at spaces, so that no word or n-gram inside one is lost or met twice."""
    while len(cp) > BLOCK:
        space = np.flatnonzero((cp[:BLOCK] < len(_SPACE)) & _SPACE[np.minimum(cp[:BLOCK], len(_SPACE) - 1)])
        cut = int(space[-1]) if len(space) and space[-1] else None
        if cut is None:  # a word longer than a block: as far as it goes
            rest = np.flatnonzero((cp[BLOCK:] < len(_SPACE)) & _SPACE[np.minimum(cp[BLOCK:], len(_SPACE) - 1)])
            if not len(rest):
                break
            cut = BLOCK + int(rest[0])
        yield cp[:cut]
        cp = cp[cut:]
    yield cp


_END = np.array([32], np.uint32)


def _joined(cp: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
    """The runs of a text, and for each the bucket of the pair of its first word and the last one of
    the run before, which no run holds."""
    if len(cp) <= BLOCK:
        yield cp, None
        return
    last = None
    for r in _runs(cp):
        space = np.r_[True, (r < len(_SPACE)) & _SPACE[np.minimum(r, len(_SPACE) - 1)], True]
        edge = np.flatnonzero(space[1:] != space[:-1])
        pair = None
        if len(edge):
            if last is not None:  # two words and then their pair come first
                pair = int(features(np.concatenate([_END, last, _END, r[edge[0] : edge[1]], _END]))[0][2])
            last = r[edge[-2] : edge[-1]]
        yield r, pair


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each is met."""
    got = []
    for r, pair in _joined(code_points(text)):
        got.append(features(np.concatenate([_END, r, _END]))[0])
        if pair is not None:
            got.append(np.array([pair], np.int64))
    return np.unique(np.concatenate(got), return_counts=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    return shares(*counted(text))


def shares(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return u, n / max(1, n.sum())


@dataclass
class Model:
    table: np.ndarray  # one number for each bucket
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[np.ndarray] = []
        marks: list[tuple[int, int]] = []  # text and start in the buffer
        size = 0

        def flush() -> None:
            nonlocal held, marks, size
            if not held:
                return
            where = np.array([m[1] for m in marks])
            b, at = features(np.concatenate([*held, _END]), where)
            which = np.searchsorted(where, at, "right") - 1
            np.add.at(sums, [m[0] for m in marks], np.bincount(which, self.table[b], len(marks)))
            np.add.at(counts, [m[0] for m in marks], np.bincount(which, minlength=len(marks)))
            held, marks, size = [], [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            for r, pair in _joined(code_points(t)):
                if pair is not None:
                    sums[i] += self.table[pair]
                    counts[i] += 1
                if size + len(r) > BLOCK:
                    flush()
                marks.append((i, size))
                held += [_END, r]
                size += len(r) + 1
        flush()
        return sup.sigmoid(self.bias + sums / np.maximum(counts, 1))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, shift: float = 0.0, seed: int = 5) -> Model:
    """Train on texts' bags and 0/1 labels. Without both classes the score is the same for all texts."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    seen = np.full(1 << BITS, 1e-8, np.float32)
    w, bias = rng.normal(0, 1 / np.sqrt(DIM), (2, DIM)), np.zeros(2)
    w2, b2 = np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            u, share = bags[i]
            h = share @ v[u]
            z = w @ h + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[int(y[i])] -= 1
            gh = g @ w
            seen[u] += (share * share * (gh @ gh)).astype(np.float32)
            v[u] -= (rate * share / np.sqrt(seen[u]))[:, None].astype(np.float32) * gh.astype(np.float32)
            gw = np.outer(g, h)
            w2 += gw * gw
            b2 += g * g
            w -= rate * 0.3 * gw / np.sqrt(w2)
            bias -= rate * 0.3 * g / np.sqrt(b2)
    return Model(v.astype(np.float64) @ (w[1] - w[0]), float(bias[1] - bias[0]) + shift)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counted(t.as_py()) for t in b.column(1)]
        lists = [pa.array([g[i].astype(np.int32) for g in got], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(2)], names=["doc_id", "buckets", "counts", "y"])


def _score(model_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        for b in batches:
            s = np.concatenate([model.scores(b.column(1).slice(i, 256).to_pylist()) for i in range(0, b.num_rows, 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier of quality 1) and predicted for each row.

    Fits on at most about ``per_class`` labelled documents of each class, of which the executors
    make bags of features; whole texts are learnt from and scored.
    Null and empty texts get the score of no features. A row that repeats is scored again; a
    null doc_id isn't held out and is never learnt from. Other columns aren't read. Without
    labels every score is 0.5.
    """
    rows, counts = sup.labelled_rows(docs, labels, "quality", parts, part, per_class)
    got = rows.mapInArrow(tidy(_bags), "doc_id long, buckets array<int>, counts array<int>, y int").toArrow().sort_by("doc_id")
    bags = [shares(u.values.to_numpy(), n.values.to_numpy()) for u, n in zip(got["buckets"], got["counts"], strict=True)]
    y = got["y"].to_numpy()
    model = docs.sparkSession.sparkContext.broadcast(fit(bags, y, sup.prior_shift(counts, y) if len(y) else 0.0))
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", sup.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
