import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.llm import linededup
from weftline.llm.common import Tables


def brute(rows, least=0.8):
    """First line of each component, by comparing all pairs of different lines."""
    lines = [(d is not None, d, i, x) for d, t in rows for i, x in linededup.lines_of(t)]
    texts = sorted({x for *_, x in lines})
    sets = {x: set(linededup.shingles(x).tolist()) for x in texts}
    inverted = {}
    for x in texts:
        for s in sets[x]:
            inverted.setdefault(s, []).append(x)
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in texts:
        for y in {y for s in sets[x] for y in inverted[s] if y < x}:
            both = len(sets[x] & sets[y])
            if both >= least * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                parent[find(x)] = find(y)
    first = {}
    for k, d, i, x in sorted(lines, key=lambda r: (r[0], r[1] or 0, r[2])):
        first.setdefault(find(x), (d, i))
    return {(d, i): first[find(x)] for _, d, i, x in lines}


def classes(df, **kw):
    return {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in linededup.line_classes(df, **kw).collect()}


def test_equals_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert classes(df) == brute(rows)


@pytest.mark.parametrize("bucket", [linededup.BUCKET, 6])
def test_many_variants(spark, bucket):
    """A family of near copies of one line; the small bucket cuts it in blocks."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    base = rng.sample(words, 40)
    rows = []
    for d in range(60):
        own = list(base)
        own[rng.randrange(40)] = rng.choice(words)
        rows.append((d, "\n".join([" ".join(own), " ".join(rng.sample(words, 12)), "", "  same line in each  "])))
    assert classes(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket) == brute(rows)


def test_signatures_and_grow():
    rng = random.Random(2)
    lines = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 400))) for _ in range(50)] + ["x" * 300_000, "é"]
    together = linededup.signatures(lines)
    assert (together == np.concatenate([linededup.signatures([x]) for x in lines])).all()
    keys, comps = np.arange(4), np.array([0, 1, 2, 2])
    got = linededup.grow(keys, comps, ["abcdefghijk", "abcdefghijk", "zzzzzzzzz", "yyyyyyyyy"], 0.8)
    assert [sorted(e) for e in got] == [[0, 1]]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a line that repeats itself"), (5, "own text\n  a line that repeats itself\n"), (None, "a line that repeats itself"), (4, "a line that repeats itself"), (6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("_n", F.lit(1))
    assert classes(df) == brute(rows)
    out = linededup.dedup_lines(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", None), ("2", ""), ("3", " \n\t"), ("None", "a line that repeats itself"), ("5", "own text\n"), ("6", "x")], key=lambda r: (r[0], r[1] or ""))
    assert out[0].key == "clash"
    assert linededup.line_classes(df.limit(0)).count() == 0 and linededup.dedup_lines(df.limit(0)).count() == 0


def test_buckets_of_many_lines_are_compared_without_overflow(spark):
    """Sums of the hashes of so many keys don't fit a long; equal buckets are still verified once."""
    n = 400_000
    keys = spark.range(n).select(F.col("id").alias("key"))
    buckets = keys.crossJoin(spark.createDataFrame([(0,), (32,)], "band long")).select("band", "key", F.col("key").alias("comp"), F.lit(2).cast("long").alias("n"))
    texts = spark.createDataFrame([(k, f"boilerplate that has another number in each document: {k}") for k in (3, 7)], "key long, text string")
    got = linededup._edges(buckets, texts, linededup.LEAST, linededup.BUCKET, Tables(spark, "edges")).collect()
    assert [sorted((r.a, r.b)) for r in got] == [[3, 7]]
    fewer = buckets.where("band = 0 or key != 5")
    assert len(linededup._edges(fewer, texts, linededup.LEAST, linededup.BUCKET, Tables(spark, "edges")).collect()) == 2


def test_rows_that_share_an_id(spark):
    rows = [(1, "a line that repeats itself", 0), (2, "a line that repeats itself", 0), (2, "quite unique content nobody else has", 0), (2, "quite unique content nobody else has", 0), (3, None, 0), (3, None, 0), (None, "a line that repeats itself\nnone of the others has this one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(2, "quite unique content nobody else has", 0), (3, None, 0), (3, None, 0), (None, "a line that repeats itself\nnone of the others has this one", 0)]))
