"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2t). They are projected
on their leading principal axes, which never makes two of them farther apart, and sorted
by the cells of a grid of side eps. The sorted sequence is cut in intervals; pairs of
intervals whose boxes are more than eps apart are never met, the others are joined by
recursive halving with the same test, down to small matrix products in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Tables, components, spanning_forest, tidy

#: Leading axes of the grid, vectors of an interval, vectors of a leaf of the recursion.
AXES, INTERVAL, LEAF = 6, 4096, 256


@dataclass(frozen=True)
class Grid:
    """An orthonormal basis for vectors of one length (others use their first coordinates) and the cell side."""

    basis: np.ndarray
    eps: float

    def project(self, unit: np.ndarray) -> np.ndarray:
        d = unit.shape[1]
        own = unit @ self.basis if d == len(self.basis) else unit[:, :AXES]
        return np.pad(own, ((0, 0), (0, AXES - own.shape[1])))


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_length(b: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values, sizes = _matrix(b.column(b.schema.get_field_index(name)))
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[(ends[at] - d)[:, None] + np.arange(d)]


def _moments(d: int):
    """Upper triangle of the sum of products of one partition's unit vectors of length ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((d, d))
        for b in batches:
            for _, v in _by_length(b, "v"):
                if v.shape[1] == d:
                    u = _unit(v)
                    s += u.T @ u
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(s[i, j])], names=["at", "s"])

    return run


def principal_axes(reps: DataFrame, d: int) -> np.ndarray:
    """The leading axes of all vectors of length ``d``; only d * (d + 1) / 2 sums reach the driver."""
    s = np.zeros((d, d))
    for r in reps.select("v").mapInArrow(tidy(_moments(d)), "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        s[r["at"] // d, r["at"] % d] = s[r["at"] % d, r["at"] // d] = r.s
    _, vectors = np.linalg.eigh(s)
    return vectors[:, ::-1][:, :AXES]


def _cells(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, AXES), np.int32)
            for at, v in _by_length(b, "v"):
                cells[at] = np.floor(grid.project(_unit(v)) / grid.eps)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cells[:, k].copy()) for k in range(AXES)]], names=[*b.schema.names, *[f"c{k}" for k in range(AXES)]])

    return run


def _intervals(grid: Grid, interval: int):
    """Number the intervals of one partition of the sorted sequence; a change of group starts a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        last, seq, filled = None, -1, 0
        for b in batches:
            groups = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            seqs = np.zeros(b.num_rows, np.int64)
            for i, g in enumerate(groups):
                if g != last or filled == interval:
                    last, seq, filled = g, seq + 1, 0
                filled += 1
                seqs[i] = base | seq
            proj = np.zeros((b.num_rows, AXES))
            for at, v in _by_length(b, "v"):
                proj[at] = grid.project(_unit(v))
            cols = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seqs), *[pa.array(proj[:, k].copy()) for k in range(AXES)]], names=["rep", "label", "d", "n", "v", "seq", *[f"p{k}" for k in range(AXES)]])

    return run


class _Sequence:
    """One interval's vectors in grid order."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, v: np.ndarray, p: np.ndarray):
        order = np.lexsort((ids, *p.T[::-1]))  # any order is right; this one keeps halves compact
        self.ids, self.n, self.unit, self.p = ids[order], n[order], _unit(v[order]), p[order]
        self.links = np.zeros(len(ids), np.int64)


class _Join:
    def __init__(self, a: _Sequence, b: _Sequence, least: float, eps: float):
        self.a, self.b, self.least, self.eps2 = a, b, least, eps * eps * (1 + 1e-9)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.products = 0

    def apart(self, i0: int, i1: int, j0: int, j1: int) -> bool:
        a, b = self.a.p[i0:i1], self.b.p[j0:j1]
        gap = np.maximum(0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
        return float(gap @ gap) > self.eps2

    def run(self, i0: int, i1: int, j0: int, j1: int) -> None:
        same = self.a is self.b
        if same and j1 <= i0 or self.apart(i0, i1, j0, j1):
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            self.leaf(i0, i1, j0, j1)
        elif same and (i0, i1) == (j0, j1):
            m = (i0 + i1) // 2
            self.run(i0, m, i0, m)
            self.run(i0, m, m, i1)
            self.run(m, i1, m, i1)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            self.run(i0, m, j0, j1)
            self.run(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            self.run(i0, i1, j0, m)
            self.run(i0, i1, m, j1)

    def leaf(self, i0: int, i1: int, j0: int, j1: int) -> None:
        self.products += 1
        near = self.a.unit[i0:i1] @ self.b.unit[j0:j1].T >= self.least
        if self.a is self.b and (i0, i1) == (j0, j1):
            np.fill_diagonal(near, False)
            self.a.links[i0:i1] += near @ self.a.n[i0:i1]
            near = np.triu(near)
        else:
            self.a.links[i0:i1] += near @ self.b.n[j0:j1]
            self.b.links[j0:j1] += self.a.n[i0:i1] @ near
        x, y = np.nonzero(near)
        if len(x):
            self.edges.append(spanning_forest(self.a.ids[i0 + x], self.b.ids[j0 + y]))


def _pairs(least: float, eps: float):
    """Rows sorted by pair; each pair of intervals is joined once both sides are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def join() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            seq, a = t.column("seq").to_numpy(), t.column("a").to_numpy()[0]
            values, sizes = _matrix(t.column("v"))
            v = values.reshape(len(seq), sizes[0])
            p = np.stack([t.column(f"p{k}").to_numpy() for k in range(AXES)], axis=1)
            ids, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            left = seq == a
            one = _Sequence(ids[left], n[left], v[left], p[left])
            two = one if left.all() else _Sequence(ids[~left], n[~left], v[~left], p[~left])
            j = _Join(one, two, least, eps)
            j.run(0, len(one.ids), 0, len(two.ids))
            for s in (one, two)[: 1 + (two is not one)]:
                has = s.links > 0
                if has.any():
                    yield pa.RecordBatch.from_arrays([pa.array(s.ids[has]), pa.array(s.links[has]), pa.nulls(int(has.sum()), pa.int64())], names=["a", "links", "b"])
            if j.edges:
                x, y = spanning_forest(np.concatenate([e[0] for e in j.edges]), np.concatenate([e[1] for e in j.edges]))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(y)], names=["a", "links", "b"])

        for b in batches:
            pair = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("a", "b")], axis=1)
            cut = [0, *(np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for i, k in zip(cut[:-1], cut[1:], strict=True):
                if k == i:
                    continue
                if held and last != tuple(pair[i]):
                    yield from join()
                    held = []
                last = tuple(pair[i])
                held.append(b.slice(i, k - i))
        if held:
            yield from join()

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.93, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``embeddings`` (vec_id, embedding, label).

    Rows link at a cosine of at least ``least`` where labels (and lengths) are equal. A null
    label, and a vector that is null, empty, all zero or holds null or non-finite values,
    links with nothing: 0 links, its own component, kept. Equal vectors of a label are joined
    once, with their number. A repeated vec_id counts as another vector, with links and a
    component of its own; a null vec_id links like any other, is no component's id unless it is
    alone there (then null), and counts as kept only then. No rows give none.
    """
    spark = embeddings.sparkSession
    tables = Tables(spark, "egojoin")
    eps = math.sqrt(2 - 2 * least)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    marked = rows.withColumn("ok", usable).withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))
    classes = marked.where("ok").groupBy("h", "label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # a class has a number of its own: vec_ids may repeat or be null; written, the numbers are fixed
    reps = tables.write(classes.select(F.monotonically_increasing_id().alias("rep"), "label", F.size("v").alias("d"), "n", "v", "h", "least"), "classes")
    lengths = reps.groupBy("d").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "d").first()
    if lengths is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    grid = Grid(principal_axes(reps, lengths.d), eps)
    kind = "rep long, label string, d int, n long, v array<double>"
    cells = [f"c{k}" for k in range(AXES)]
    placed = reps.select("rep", "label", "d", "n", "v").mapInArrow(tidy(_cells(grid)), kind + "".join(f", {c} int" for c in cells))
    key = ["label", "d", *cells, F.xxhash64("rep")]  # the hash cuts a crowded cell
    parts = max(1, placed.rdd.getNumPartitions())
    ordered = placed.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("rep", "label", "d", "n", "v")
    axes = [f"p{k}" for k in range(AXES)]
    seqs = tables.write(ordered.mapInArrow(tidy(_intervals(grid, interval)), f"{kind}, seq long" + "".join(f", {p} double" for p in axes)), "sequence")
    boxes = seqs.groupBy("label", "d", "seq").agg(*[f(p).alias(f"{s}{p}") for p in axes for f, s in ((F.min, "lo_"), (F.max, "hi_"))])
    boxes = tables.write(boxes, "boxes")
    cell = lambda c: F.floor(F.col(c) / eps)
    mine = boxes.withColumn("cell", F.explode(F.sequence(cell("lo_p0"), cell("hi_p0"))))
    theirs = boxes.select("label", "d", F.col("seq").alias("b"), *[F.col(f"{s}{p}").alias(f"b_{s}{p}") for p in axes for s in ("lo_", "hi_")])
    theirs = theirs.withColumn("cell", F.explode(F.sequence(cell("b_lo_p0") - 1, cell("b_hi_p0") + 1)))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo_{p}") - F.col(f"hi_{p}"), F.col(f"lo_{p}") - F.col(f"b_hi_{p}")), 2) for p in axes), F.lit(0.0))
    met = mine.join(theirs, ["label", "d", "cell"]).where((F.col("seq") <= F.col("b")) & (gap <= eps * eps * (1 + 1e-9)))
    pairs = tables.write(met.select(F.col("seq").alias("a"), "b").distinct(), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("seq"))
    dealt = seqs.drop("label", "d").join(sides, "seq").repartition("a", "b").sortWithinPartitions("a", "b", "seq")
    joined = tables.write(dealt.mapInArrow(tidy(_pairs(least, eps)), "a long, links long, b long"), "joined")
    links = joined.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = tables.write(components(joined.where("b is not null").select("a", "b"), tables), "components").withColumnRenamed("node", "rep")
    rooted = tables.write(reps.select("rep", "least").join(comp, "rep", "left").select("rep", "least", F.coalesce("root", "rep").alias("root")), "rooted")
    least_of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("rep", "root").join(least_of, "root").select("rep", "component_id")
    known = reps.select("rep", "n", "h", "label", "v").join(links, "rep", "left").join(named, "rep")
    known = known.select("h", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    found = marked.where("ok").join(known, ["h", "label", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same in SQL, by comparing all pairs of a label.
SQL = """WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a"""
