import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.llm import langid, quality, queries, toxicity
from weftline.llm import supervised as sup

SF01 = SF.replace("sf0.001", "sf0.01")


def held(ids, parts, part):
    return {i for i in ids if zlib.crc32(str(i).encode()) % parts == part}


def contract(spark, name, parts, part, labels=None):
    rows = queries.QUERIES[name](spark, SF01).collect()
    ids = {r.doc_id for r in rows}
    assert len(rows) == 1000 and {r.doc_id for r in rows if r.held_out} == held(ids, parts, part)
    assert all(0 <= r.score <= 1 for r in rows)
    return rows


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    rows = contract(spark, "op2_language_id", 4, 2)
    out = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.97 * len(out)


@pytest.mark.parametrize(("name", "column", "parts", "part", "least"), [("op3_toxicity", "toxic", 5, 0, 0.9), ("op6_quality_classifier", "quality", 3, 1, 0.93)])
def test_label_accuracy(spark, name, column, parts, part, least):
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = contract(spark, name, parts, part)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in out) >= least * len(out)


def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "123 !!", "de"), (5, "word " * 60_000, "en"), (None, "some words", "en"), (6, "some words", "en"), (6, "some words", "en"), (7, "einige wörter und sätze", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit("clash"))


def test_odd_rows(spark):
    df, none = odd(spark), odd(spark).limit(0)
    got = langid.identify(df).collect()
    assert len(got) == 9
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 4))
    assert langid.identify(none).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, 0), (7, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity_scores, quality.quality_scores):
        got = f(df, labels).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id == 6}) == 1
        assert f(none, labels).count() == 0
        assert {r.score for r in f(df, labels.limit(0)).collect()} == {0.5}


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(0, 7), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w) if len(t) else w))
    index = toxicity.BlockMaxIndex(vectors, 60, block=16, dense=9)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        t, w = vectors[i]
        for leave in (-1, i):
            found, cos = index.nearest(t, w, 9, leave)
            want = dense @ dense[i]
            if leave >= 0:
                want[leave] = 0
            best = np.sort(want[want > 0])[::-1][:9]
            assert np.allclose(cos, best) and np.allclose(want[found], cos)
    assert index.scored < 0.8 * sum(len(v[0]) for v in vectors) * 200  # blocks were skipped


def test_blocks_are_bounded_only_where_it_pays():
    """Short runs are scored without bounds, long ones by blocks; cosines are the same to the bit."""
    rng = np.random.default_rng(5)

    def unit(t, w):
        return np.array(t), np.array(w) / np.linalg.norm(w)

    def pair(vectors, n_terms, **shape):
        return [toxicity.BlockMaxIndex(vectors, n_terms, **shape, **more) for more in ({}, {"long": 0}, {"long": 1 << 20})]

    def asked(indexes, vectors, k):
        for i in range(0, len(vectors), 9):
            for leave in (-1, i):
                one, *others = [x.nearest(*vectors[i], k, leave) for x in indexes]
                assert all((one[0] == x[0]).all() and (one[1] == x[1]).all() for x in others)

    rare = [unit(np.sort(rng.choice(400, 6, replace=False)), rng.random(6) + 0.1) for _ in range(900)]
    indexes = pair(rare, 400, block=16, dense=5)
    indexes[0].run_max = None  # bounds would read it
    asked(indexes, rare, 9)
    assert indexes[0].nearest(np.zeros(0, np.int64), np.zeros(0), 9)[0].size == 0

    near = [unit([c, 10, 11], [3, *rng.random(2) + 0.1]) for c in range(10) for _ in range(64)]
    indexes = pair(near, 12, block=64, dense=0)
    asked(indexes, near, 9)
    assert indexes[0].scored == indexes[1].scored < 0.8 * indexes[2].scored  # blocks were skipped


def test_evidence():
    texts = [("you utter moron", 1), ("what a moron you are", 1), ("a lovely day", 0), ("lovely weather this day", 0)] * 12
    vocabulary = sorted({w for t, _ in texts for w in toxicity.word_counts(t)[0]})
    look = toxicity.Lookup(vocabulary)
    model = toxicity.fit([(i, *look.counts(t), v) for i, (t, v) in enumerate(texts)], vocabulary, np.ones(len(vocabulary)), {0: 24, 1: 24})
    e = model.evidence("such a moron")
    assert e and all(x["label"] == 1 and "moron" in x["words"] for x in e)
    assert model.score("such a moron") > 0.5 > model.score("lovely")


def test_toxicity_equals_brute_force(spark):
    """Whole documents: words, weights, dense cosines, votes and evidence made here; the calibration's coefficients are the model's."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_model(docs, labels)
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    word = re.compile(r"[^\W\d_]+")
    bags = {d: Counter(word.findall(t.lower())) for d, t in rows}
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    train = sorted(y)
    words = sorted({w for d in train for w in bags[d]})
    place = {w: i for i, w in enumerate(words)}
    has = np.array([[w in bags[d] for w in words] for d in train])
    df = np.array([sum(w in b for b in bags.values()) for w in words])
    label = np.array([y[d] for d in train])
    a, b, n1, n0 = has[label == 1].sum(0), has[label == 0].sum(0), label.sum(), (1 - label).sum()
    chi = len(train) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n0 + n1 - a - b) * n0 * n1, 1e-9)
    keep = np.where((chi >= 15.1) & (a + b >= 3), 0.05 + 0.95 * np.minimum(1, np.sqrt(chi / 100)), 0.05)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1) * keep

    def vector(d):
        v = np.zeros(len(words))
        for w, n in bags[d].items():
            if w in place:
                v[place[w]] = (1 + np.log(n)) * idf[place[w]]
        return v, np.sqrt(v @ v)

    dense = np.array([vector(d)[0] / max(1e-300, vector(d)[1]) for d in train])
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    weight = {c: sum(label == c) / sum(label == c) for c in (0, 1)}
    none = 0
    for d, text in rows:
        v, norm = vector(d)
        cos = dense @ (v / norm) if norm else np.zeros(len(train))
        best = sorted((i for i in range(len(train)) if cos[i] > 1e-12), key=lambda i: -cos[i])[:15]
        if not best:
            none += 1
            continue
        c, lab = cos[best], label[best]
        vote = c * c / (1.0001 - np.minimum(c, 1)) ** 0.5 * np.array([weight[x] for x in lab])
        share = vote[lab == 1].sum() / vote.sum()
        m = np.array([1, share, (c[lab == 1].sum() - c[lab == 0].sum()) / 15, share * np.log1p(norm), share * norm / np.sqrt(len(text.split()) + 1)])
        assert abs(sup.sigmoid(m @ model.coef) - got[d].score) < 1e-6
        assert np.allclose([e.cosine for e in got[d].evidence], c[:3]) and all(y[e.doc_id] == e.label for e in got[d].evidence)
    assert none <= 0.05 * len(rows)


def test_fit_of_toxicity_gives_memory_back(spark, monkeypatch):
    """The driver, which later stages share, keeps 32 bits for each word of an example, and frees the words
    before the fit and the rest after it."""
    fit, seen, freed = toxicity.fit, [], []
    monkeypatch.setattr(toxicity, "fit", lambda sample, *rest: seen.append({x.dtype.itemsize for s in sample for x in s[1:3]}) or fit(sample, *rest))
    monkeypatch.setattr(toxicity, "release", lambda: freed.append(len(seen)), raising=False)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.drop_toxic(docs, labels).count() < docs.count()
    assert seen == [{4}] and freed == [0, 1]


def test_features_dont_depend_on_neighbours():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é\n!𝄞 ") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", " "]
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.1)
    together = model.scores(texts)
    apart = np.array([model.scores([t])[0] for t in texts])
    by_bag = np.array([sup.sigmoid(0.1 + (lambda b: (model.table[b[0]] * b[1]).sum())(quality.bag(t or ""))) for t in texts])
    assert np.allclose(together, apart) and np.allclose(together, by_bag)


def test_long_texts_in_runs(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.0)
    whole = model.scores([text])[0]
    monkeypatch.setattr(quality, "BLOCK", 500)
    assert abs(model.scores([text])[0] - whole) < 1e-12
    monkeypatch.setattr(quality, "BLOCK", 1 << 19)
    u, n = quality.bag(text)
    monkeypatch.setattr(quality, "BLOCK", 90)
    cut = quality.bag(text + "  \n " * 60)
    assert (cut[0] == u).all() and (cut[1] == n).all()


def naive_features(text):
    """Words, pairs and n-grams one at a time, hashed with Python's integers."""
    m, p, mix = (1 << 64) - 1, 0x100000001B3, 0x9E3779B97F4A7C15
    code = lambda ch: ((1 if ch.isspace() else ord(ch) + 2) * mix) & m
    poly = lambda s: sum(code(ch) * pow(p, k, 1 << 64) for k, ch in enumerate(s)) & m
    words = [poly(w) for w in text.split()]
    padded = f" {text} "
    out = [w + 1 for w in words] + [b - a + 2 for a, b in zip(words[:-1], words[1:], strict=True)]
    for k in range(len(padded) - 2):
        if not padded[k + 1].isspace():
            out.append(poly(padded[k : k + 3]) + 3)
            if k + 4 <= len(padded) and not padded[k + 2].isspace():
                out.append(poly(padded[k : k + 4]) + 4)
    return sorted((((h & m) ^ ((h & m) >> 29)) * mix & m) >> (64 - quality.BITS) for h in out)


def test_features_equal_naive_ones():
    for text in ("one two one", "a", "ab é\n𝄞 xyz  wörd", "", " ", "\tx y"):
        cp = np.concatenate([quality._END, quality.code_points(text), quality._END])
        assert sorted(quality.features(cp)[0].tolist()) == naive_features(text)


def test_convolution_equals_naive_loops():
    rng = np.random.default_rng(4)
    f = len(langid.WIDTHS) * langid.FILTERS
    net = langid.Network(["a", "b"], rng.normal(size=(256, langid.EMBED)), rng.normal(size=(langid.WIDEST * langid.EMBED, f)) * langid._mask(), rng.normal(size=f), rng.normal(size=(f, 2)), rng.normal(size=2))
    net.embed[0] = 0
    raw = bytes(rng.integers(1, 256, 70).tolist())
    w = langid.windows(raw)[0].tolist() + [0] * langid.WIDEST
    best = [max(sum(net.embed[w[at + j], e] * net.conv[j * langid.EMBED + e, k] for j in range(langid.WIDTHS[k // langid.FILTERS]) for e in range(langid.EMBED)) for at in range(langid.WINDOW)) for k in range(f)]
    o = np.maximum(np.array(best) + net.conv_bias, 0) @ net.out + net.out_bias
    want = np.exp(o - o.max()) / np.exp(o - o.max()).sum()
    assert np.allclose(net.probabilities(langid.windows(raw))[0], want)


def test_windows_hold_every_byte():
    raw = bytes(range(1, 256)) * 5
    assert langid.windows(raw).ravel()[: len(raw)].tobytes() == raw
