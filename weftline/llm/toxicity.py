"""Toxicity from the nearest labelled examples.

Examples and texts are TF-IDF vectors over all words of the examples, with document
frequencies counted over all documents. Words that depend on the label weigh more (chi
square, from the examples that a fit reads); none is left out, and the others keep
``FLOOR`` of their weight, so a text without telling words still has its neighbours by
plain TF-IDF cosine. Unweighted, insults of a few words drown in the rest of a document.

The nearest examples are found exactly through an inverted index whose terms keep the
largest weight in each block of examples: blocks that can't reach the k-th best cosine are
never scored. Where a block holds few examples of a term, as of most words, bounds cost more
than they save, and a text's terms are scored for all examples. Votes weighted by distance,
with the strength of the match, go through a logistic calibration fitted on the examples
themselves, each left out in turn. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import supervised as sup
from weftline.llm.common import release, tidy

#: Labelled documents of each class that a fit reads, neighbours that vote, neighbours returned.
PER_CLASS, NEIGHBOURS, EVIDENCE = 2000, 15, 3
#: Part of its weight that a term keeps which doesn't depend on the label; the chi square at which it
#: begins to count as dependent (one in 10,000 by chance) and at which it has its full weight; and the
#: least number of examples with it.
FLOOR, LEAST_CHI, FULL_CHI, LEAST_DF = 0.05, 15.1, 100.0, 3
BLOCK = 64
#: Terms kept as rows of a dense matrix, and texts that share a product with it.
DENSE, TOGETHER = 128, 32
#: Blocks scored in the first rounds, which raise the bar for the rest.
ROUNDS = (2, 8)
#: Examples in a run, on average over a text's terms, from which blocks are bounded: a run takes about as long.
LONG = 16
#: Tokens other than plain words that a worker remembers.
CACHE = 60_000
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def word_counts(text: str | None) -> tuple[list[str], list[int], int]:
    """Words of a text, how often each is there, and the number of tokens between white space."""
    tokens = tokens_of(text)
    words: Counter = Counter()
    for token, n in tokens.items():
        for w in _LETTERS.findall(token):
            words[w] += n
    return list(words), list(words.values()), tokens.total()


class Lookup:
    """Places of words in the vocabulary; what tokens with other signs hold is remembered."""

    def __init__(self, vocabulary: list[str]):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.mixed: dict[str, tuple[int, ...]] = {}

    def places(self, token: str) -> tuple[int, ...]:
        """Of a token that isn't a word of the vocabulary itself."""
        got = self.mixed.get(token)
        if got is None:
            got = tuple(self.place[w] for w in _LETTERS.findall(token) if w in self.place)
            if len(self.mixed) >= CACHE:
                self.mixed.clear()
            self.mixed[token] = got
        return got

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of a text's words in order, how often each is there, and the number of tokens."""
        tokens, get, out = tokens_of(text), self.place.get, {}
        for token, n in tokens.items():
            i = get(token)
            if i is not None:
                out[i] = out.get(i, 0) + n
            elif not token.isalpha():
                for i in self.places(token):
                    out[i] = out.get(i, 0) + n
        at = np.fromiter(out, np.int64, len(out))
        order = np.argsort(at)
        return at[order], np.fromiter(out.values(), np.int64, len(out))[order], tokens.total()

    def present(self, text: str | None) -> np.ndarray:
        """Places of the words that a text has, in no order."""
        tokens, place = set((text or "").lower().split()), self.place
        out = {place[t] for t in tokens if t in place}
        for t in tokens:
            if not t.isalpha():
                out.update(self.places(t))
        return np.fromiter(out, np.int64, len(out))


def dependence(bags: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """What each term keeps of its weight, by the chi square of its presence and the label."""
    counts = np.zeros((2, n_terms))
    for b, label in zip(bags, y.tolist(), strict=True):
        counts[label, b] += 1
    b, a = counts
    n1, n = float(y.sum()), float(len(y))
    n0 = n - n1
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1e-9, (a + b) * (n - a - b) * n1 * n0)
    return np.where((chi >= LEAST_CHI) & (a + b >= LEAST_DF), FLOOR + (1 - FLOOR) * np.minimum(1, np.sqrt(chi / FULL_CHI)), FLOOR)


def weigh(t: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit-length TF-IDF weights and the length before."""
    w = (1 + np.log(counts)) * idf[t]
    norm = float(np.sqrt(w @ w))
    return (w / norm if norm else w), norm


def _ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of a[i] .. a[i] + n[i] - 1, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Exact top-k cosine over unit sparse vectors.

    The terms with the most postings are kept as rows of a dense matrix, whose part of all
    cosines is one product; the others are an inverted index of runs (a term's postings in
    one block of examples) with the largest weight of each.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, dense: int = DENSE, long: int = LONG):
        self.n, self.block, self.long = len(vectors), block, long
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        ex = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in vectors])
        w = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        df = np.bincount(terms, minlength=n_terms)
        common = np.argsort(-df, kind="stable")[:dense]
        common = common[df[common] > 0]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        own = self.row[terms]
        self.dense[own[own >= 0], ex[own >= 0]] = w[own >= 0]
        terms, ex, w = terms[own < 0], ex[own < 0], w[own < 0]
        order = np.lexsort((ex, terms))
        terms, self.ex, self.w = terms[order], ex[order], w[order]
        run = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (self.ex[1:] // block != self.ex[:-1] // block)]) if len(terms) else np.zeros(0, np.int64)
        self.run_at = np.r_[run, len(terms)].astype(np.int32)
        self.run_block = (self.ex[run] // block).astype(np.int32) if len(run) else np.zeros(0, np.int32)
        self.run_max = np.maximum.reduceat(self.w, run) if len(run) else np.zeros(0)
        self.term_at = np.searchsorted(terms[run], np.arange(n_terms + 1)).astype(np.int32) if len(run) else np.zeros(n_terms + 1, np.int32)
        self.starts = np.arange(0, self.n, block)
        self.scored = 0  # postings read, for tests

    def bases(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to each cosine: a row for each of some vectors."""
        q = np.zeros((len(vectors), len(self.dense)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        return q @ self.dense

    def holders(self, term: int) -> np.ndarray:
        """Examples that have a term."""
        if self.row[term] >= 0:
            return np.flatnonzero(self.dense[self.row[term]])
        return self.ex[self.run_at[self.term_at[term]] : self.run_at[self.term_at[term + 1]]]

    def _add(self, scores: np.ndarray, a: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        """Postings a[i] .. end[i] - 1, whose term weighs q[i]."""
        n = end - a
        at = _ranges(a, n)
        scores += np.bincount(self.ex[at], np.repeat(q, n) * self.w[at], self.n)
        self.scored += len(at)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine (ties: the smaller number first). ``base``: the
        vector's row of ``bases``, if it's there already; it is overwritten."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        scores = self.bases([(terms, weights)])[0] if base is None else base
        a = self.term_at[terms]
        n = self.term_at[terms + 1] - a
        first, end = self.run_at[a], self.run_at[a + n]

        def bar() -> float:  # the k-th best so far: no cosine ends below what it is now
            if leave >= 0:
                scores[leave] = 0
            return np.partition(scores, -k)[-k] if k <= self.n else 0.0

        if (end - first).sum() <= self.long * n.sum():
            self._add(scores, first, end, weights)
            kth = bar()
        else:
            kth = self._rounds(scores, _ranges(a, n), np.repeat(weights, n), k, bar)
        found = np.flatnonzero((scores > 0) & (scores >= kth))
        found = found[np.lexsort((found, -scores[found]))[:k]]
        return found, scores[found]

    def _rounds(self, scores: np.ndarray, runs: np.ndarray, q: np.ndarray, k: int, bar: Callable[[], float]) -> float:
        """Add what ``runs`` give, in all blocks that may reach the k-th best; the k-th best after that."""
        blocks, kth = self.run_block[runs], bar()
        bound = (np.bincount(blocks, q * self.run_max[runs], len(self.starts)) + np.maximum.reduceat(scores, self.starts)) * (1 + 1e-9)
        best = np.argsort(-bound, kind="stable")
        edges = [0, *np.cumsum([max(ROUNDS[0], -(-k // self.block)), *ROUNDS[1:]]).tolist(), len(best)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # the most promising blocks, then all that may still reach the k-th
            own = best[lo:hi]
            own = own[(bound[own] >= kth) & (bound[own] > 0)]
            if not len(own):
                break
            ask = np.zeros(len(self.starts), bool)
            ask[own] = True
            ask = ask[blocks]
            asked = runs[ask]
            self._add(scores, self.run_at[asked], self.run_at[asked + 1], q[ask])
            kth = bar()
        return kth


@dataclass
class Model:
    vocabulary: list[str]
    idf: np.ndarray  # with what the dependence on the label leaves of it
    index: BlockMaxIndex
    ids: np.ndarray
    y: np.ndarray
    vote_weight: np.ndarray  # what an example counts for: labelled rows of its class to each sampled one
    coef: np.ndarray
    empty: float  # score of a text without terms
    k: int = NEIGHBOURS
    look: Lookup | None = field(default=None, repr=False)

    def lookup(self) -> Lookup:
        if self.look is None:
            self.look = Lookup(self.vocabulary)
        return self.look

    def __getstate__(self):
        return self.__dict__ | {"look": None}

    def measures(self, t: np.ndarray, w: np.ndarray, norm: float, words: int, leave: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the calibration sees, and the neighbours with their cosines."""
        found, cos = self.index.nearest(t, w, self.k, leave, base)
        near = cos * cos / (1.0001 - np.minimum(cos, 1.0)) ** 0.5
        vote = near * self.vote_weight[found]
        toxic = self.y[found] == 1
        share = float(vote[toxic].sum() / vote.sum()) if len(found) else 0.0
        strength = float((cos[toxic].sum() - cos[~toxic].sum()) / self.k)
        return np.array([1.0, share, strength, share * np.log1p(norm), share * norm / np.sqrt(words + 1.0)]), found, cos

    def judge(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's score, its nearest examples and their cosines."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            counted = [self.lookup().counts(t) for t in texts[i : i + TOGETHER]]
            weighed = [weigh(t, n, self.idf) for t, n, _ in counted]
            bases = self.index.bases([(c[0], w) for c, (w, _) in zip(counted, weighed, strict=True)])
            for (t, _, words), (w, norm), base in zip(counted, weighed, bases, strict=True):
                if norm:
                    m, found, cos = self.measures(t, w, norm, words, base=base)
                    if len(found):
                        out.append((float(sup.sigmoid(m @ self.coef)), found, cos))
                        continue
                out.append((self.empty, np.zeros(0, np.int64), np.zeros(0)))
        return out

    def score(self, text: str | None) -> float:
        return self.judge([text])[0][0]

    def evidence(self, text: str | None) -> list[dict]:
        """The nearest examples of a text: doc_id, label, cosine and shared words, the heaviest first."""
        _, found, cos = self.judge([text])[0]
        own = sorted(self.lookup().counts(text)[0].tolist(), key=lambda x: -self.idf[x])
        return [{"doc_id": int(self.ids[i]), "label": int(self.y[i]), "cosine": c, "words": [self.vocabulary[x] for x in own if i in self.index.holders(x)]} for i, c in zip(found.tolist(), cos.tolist(), strict=True)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    pen = ridge * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(50):
        p = sup.sigmoid(x @ beta)
        g = x.T @ (weight * (p - y)) + pen * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(sample: list[tuple[int, np.ndarray, np.ndarray, int, int]], vocabulary: list[str], idf: np.ndarray, class_counts: dict[int, int]) -> Model:
    """``sample``: doc_id, places of terms, counts, number of tokens and label of each example."""
    y = np.array([s[4] for s in sample], np.int64)
    if len(y) and y.min() != y.max():
        idf = idf * dependence([s[1] for s in sample], y, len(vocabulary))
    # examples that share their strongest term stand together, which keeps blocks' bounds tight
    weighed = [(s, *weigh(s[1], s[2], idf)) for s in sample]
    weighed.sort(key=lambda x: (x[0][4], int(x[0][1][np.argmax(x[1])]) if x[2] else -1, x[0][0]))
    y = np.array([s[4] for s, _, _ in weighed], np.int64)
    n = np.bincount(y, minlength=2)
    each = np.array([max(1, class_counts.get(c, 0)) / max(1, n[c]) for c in (0, 1)])
    index = BlockMaxIndex([(s[1], w) for s, w, _ in weighed], len(vocabulary))
    weight = each[y] if len(y) else np.zeros(0)
    model = Model(vocabulary, idf, index, np.array([s[0] for s, _, _ in weighed], np.int64), y, weight, np.zeros(5), 0.5)
    if not len(y):
        return model
    prior = float(weight[y == 1].sum() / weight.sum())
    rows, labels, weights, none = [], [], [], [prior, 1.0]
    for i, (s, w, norm) in enumerate(weighed):
        m, found, _ = model.measures(s[1], w, norm, s[3], i) if norm else (None, [], None)
        if len(found):
            rows.append(m)
            labels.append(s[4])
            weights.append(weight[i])
        else:
            none[0] += weight[i] * s[4]
            none[1] += weight[i]
    model.empty = none[0] / none[1]
    one = y.min() == y.max()
    model.coef = logistic(np.array(rows), np.array(labels, float), np.array(weights)) if rows and not one else np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3)), 0, 0, 0, 0])
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [word_counts(t.as_py()) for t in b.column(1)]
        cols = [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.int64()), b.column(2)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "terms", "counts", "words", "y"])


def _frequencies(vocabulary_var):
    """Documents of one partition that have each term: (term, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_var.value
        look, df = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for t in b.column(0):
                df[look.present(t.as_py())] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    return run


def _score(model_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for b in batches:
            got = model.judge(b.column(1).to_pylist())
            near = [[{"doc_id": d, "label": y, "cosine": c} for d, y, c in zip(model.ids[f[:EVIDENCE]].tolist(), model.y[f[:EVIDENCE]].tolist(), cos[:EVIDENCE].tolist(), strict=True)] for _, f, cos in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(near, kind)], names=["doc_id", "score", "evidence"])

    return run


def fit_model(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_class: int = PER_CLASS) -> Model:
    """Fit on at most about ``per_class`` labelled documents of each class, whole texts; frequencies over
    all documents. The examples' words are counted where the texts are."""
    spark = docs.sparkSession
    rows, counts = sup.labelled_rows(docs, labels, "toxic", parts, part, per_class)
    got = rows.mapInArrow(tidy(_bags), "doc_id long, terms array<string>, counts array<int>, words long, y int").toArrow().sort_by("doc_id").combine_chunks()
    terms, ns = (got[c].combine_chunks() for c in ("terms", "counts"))
    terms, ns = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (terms, ns))
    encoded = terms.flatten().dictionary_encode()
    vocabulary, ends = encoded.dictionary.to_pylist(), np.cumsum(terms.value_lengths().to_numpy())[:-1]
    lists = [np.split(x.to_numpy(), ends) for x in (encoded.indices, ns.flatten())] if len(got) else [[], []]  # 32 bits each
    ids, words, y = (got[c].to_pylist() for c in ("doc_id", "words", "y"))
    got = terms = encoded = None  # the words of all examples, each as often as it is in a text
    release()
    df = np.zeros(len(vocabulary))
    n_docs = docs.count()
    if len(vocabulary):
        var = spark.sparkContext.broadcast(vocabulary)
        found = docs.select(F.col("text").cast("string")).mapInArrow(tidy(_frequencies(var)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[found["term"].to_numpy()] = found["n"].to_numpy()  # one row for each word of the bounded examples
        var.unpersist()
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    sample = list(zip(ids, *lists, words, y, strict=True))
    return fit(sample, vocabulary, idf, counts)


def _sent(docs: DataFrame, labels: DataFrame, parts: int, part: int, per_class: int):
    """The fitted model as a broadcast; the driver gives back what the fit took."""
    var = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, parts, part, per_class))
    release()
    return var


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted and evidence (the nearest
    ``EVIDENCE`` examples: doc_id, label, cosine) for each row.

    Whole texts are scored. A null, empty or term-free text gets the rate of such examples and
    has no evidence. Repeated rows are scored each; a null doc_id isn't held out and is never
    learnt from; other columns aren't read. Without labels of both classes all texts score
    alike (0.5 without any).
    """
    model = _sent(docs, labels, parts, part, per_class)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_score(model)), "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")
    return scored.select("doc_id", sup.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _clean(model_var, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        for b in batches:
            yield b.filter(pa.array([s < 0.5 for s, _, _ in model.judge(b.column(at).to_pylist())], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with all its columns, without the rows that ``toxicity_scores`` predicts toxic. No shuffle."""
    model = _sent(docs, labels, parts, part, per_class)
    return docs.mapInArrow(tidy(_clean(model, docs.columns.index("text"))), docs.schema)
