import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import common, simhash
from weftline.llm.common import Tables, components

SCHEMA = "doc_id long, text string"


def brute_print(text, words=3):
    t = (text or "").encode().translate(simhash._LOWER)
    toks = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", t) if w]
    if not toks:
        return 0
    sh = [b" ".join(toks)] if len(toks) < words else [b" ".join(toks[i : i + words]) for i in range(len(toks) - words + 1)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints, bits=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Ab", "c", "É", "d\tE", "f\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", " \n", "one", "One two", None, "a b c", "x " * 70_000]
    for t in texts:
        assert simhash.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_connect_as_all_pairs_do(spark, bucket):
    """The small bucket sends crowded entries through refinement and blocks."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)] + [0]
    prints = list(base)
    for b in base[:12]:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    tables = Tables(spark, "test")
    edges = simhash.links(df, tables, bucket=bucket)
    for a, b in edges.collect():
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    got = {r.node: r.root for r in components(edges, tables).collect()}
    want = brute_components(prints)
    groups = lambda f: sorted(sorted(v) for v in f.values())
    by_got, by_want = {}, {}
    for s, w in zip(signed, want, strict=True):
        by_got.setdefault(got.get(s, s), []).append(s)
        by_want.setdefault(w, []).append(s)
    assert groups(by_got) == groups(by_want)


def test_edges_and_extra_columns(spark):
    rows = [(5, "same words here again", "x"), (2, "same words here again", "y"), (9, None, "z"), (7, "", "z"), (8, " ", None), (5, "same words here again", "x"), (None, "alone in all the world it is", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", F.lit("clash"))
    out = simhash.simhash_components(df).collect()
    assert len(out) == 7
    got = {r.doc_id: r.component_id for r in out}
    assert got[5] == got[2] == 2
    assert got[9] == got[7] == got[8] == 7
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_few_edges_by_one_task(spark):
    """The same by one task and by rounds; a forest of few edges takes no rounds, which the driver has to plan and keep."""
    rng = np.random.default_rng(5)
    pairs = [*rng.integers(-300, 300, (250, 2)).tolist(), [-(1 << 63), 7], [(1 << 63) - 1, 7], [400, 400], [7, 7]]
    for own in (pairs, []):
        edges, got = spark.createDataFrame(own, "a long, b long").repartition(5), []
        for args in ({}, {"few": 0}):
            tables = Tables(spark, "test")
            got.append(sorted(tuple(r) for r in components(edges, tables, **args).collect()))
            assert args or tables.n == 1
        parent = {x: x for p in own for x in p}
        for _ in parent:
            for a, b in own:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert got[0] == got[1] == sorted((x, r) for x, r in parent.items() if x != 400)


def test_components_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Tables(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == got[1000] == 1000 and len(got) == n + 3


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a line that repeats itself", "x"), (2, "a line that repeats itself", "y"), (2, "quite unique content nobody else has", "z"), (2, "quite unique content nobody else has", "z"), (None, "quite unique content nobody else has", "n"), (None, "words of no one with an id", "n")], "doc_id long, text string, first string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a line that repeats itself", "x"), (2, "quite unique content nobody else has", "z"), (None, "words of no one with an id", "n")]))


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    """By the bytes of its file every table here is small enough for Spark to broadcast it, and the slots of
    fingerprints, 66 for each, too: at 0.51 GB those filled the driver."""
    plans, write = [], Tables.write

    def noted(self, df, name):
        if name not in ("forest", "star"):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(Tables, "write", noted)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(9))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [rows[0], rows[1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for (d, _), c in zip(rows, brute_components([brute_print(t) for _, t in rows]), strict=True):
        want.setdefault(c, set()).add(d)
    for most in (common.BROADCAST_ROWS, -1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        plans.clear()
        of = simhash.simhash_components(docs)
        kept = simhash.one_of_each(docs)
        assert {r.doc_id: r.component_id for r in of.collect()} == {d: min(ds) for ds in want.values() for d in ds}
        assert sorted(r.doc_id for r in kept.collect()) == sorted(min(ds) for ds in want.values())
        plans.append(("result", of._jdf.queryExecution().executedPlan().toString()))
        assert {"entries", "gone", "result"} <= {n for n, _ in plans}
        assert [n for n, p in plans if "Broadcast" in p and (most < 0 or n == "entries")] == []
