import math

import duckdb
import numpy as np
import pytest

from weftline.llm import egojoin


def brute(rows, least=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    parent = {id(r): r for r in rows}

    def find(r):
        while parent[id(r)] is not r:
            r = parent[id(r)]
        return r

    links = {id(r): 0 for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    parent[id(find(a))] = find(b)
    least_id = {}
    for r in ok:
        k = id(find(r))
        least_id[k] = min(least_id.get(k, r[0]), r[0])
    return sorted((r[0], links[id(r)], least_id.get(id(find(r)), r[0]), least_id.get(id(find(r)), r[0]) == r[0]) for r in rows)


SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def rows_of(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.02, 0.12, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2)), "clash"))
    for i in range(0, n, 9):  # exact and scaled copies
        out.append((1000 + i, out[i][1], out[i][2], "clash"))
        out.append((2000 + i, [x * 2 for x in out[i][1]], out[i][2], "clash"))
    return out


@pytest.mark.parametrize("interval", [egojoin.INTERVAL, 10])
def test_equals_brute_force(spark, monkeypatch, interval):
    monkeypatch.setattr(egojoin, "LEAF", 8 if interval == 10 else 256)
    rows = rows_of(3, 130)
    got = egojoin.near_duplicates(spark.createDataFrame(rows, SCHEMA), interval=interval).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (11, [1.0, 2.0], 0), (12, [1.0, 2.0], 0)]
    got = egojoin.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (11, 1, 11, True), (12, 1, 11, False)]
    want += [(i, 0, i, True) for i in range(4, 11)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert egojoin.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distant_blocks_are_skipped():
    rng = np.random.default_rng(1)
    far = np.zeros((2048, 4))
    far[:1024, 0], far[1024:, 1] = 1, 1
    far += rng.normal(size=far.shape) * 0.001
    p = np.pad(far, ((0, 0), (0, 2)))
    s = egojoin._Sequence(np.arange(2048), np.ones(2048, np.int64), far, p)
    j = egojoin._Join(s, s, 0.93, math.sqrt(0.14))
    j.run(0, 2048, 0, 2048)
    assert j.products == 2 * (4 + 6)  # of 36 leaf pairs
    assert (s.links == 1023).all()


def test_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    rows = rows_of(5, 90)
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows] + [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [1.0] * 12, None)])
    more = [(5000, None, 1, "x"), (5001, [0.0] * 12, 1, "x"), (5002, [1.0] * 12, None, "x")]
    got = egojoin.near_duplicates(spark.createDataFrame(rows + more, SCHEMA))
    r = c.execute(egojoin.SQL)
    assert [x[0] for x in r.description] == got.columns
    want = sorted(r.fetchall())
    assert sorted(map(tuple, got.collect())) == want and any(w[1] for w in want)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [0.01, 1.0], 0), (None, [-1.0, 0.0], 0), (1, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)]
    got = egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (None, 0, None, True), (1, 1, 1, True), (3, 1, 1, False)]))
