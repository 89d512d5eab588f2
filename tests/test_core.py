import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline import Aggregator, Engine
from weftline.functions import lcg, text
from weftline.operators import aggregators as agg
from weftline.operators.partitioning import HashPartitioner, slice_positions
from weftline.plans import workloads


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def layout(values, n):
    """Plain model of the slice rule."""
    q = len(values) // n
    out = [list(values[i * q : (i + 1) * q]) for i in range(n)]
    for r, v in enumerate(values[n * q :]):
        out[r].append(v)
    return out


def slices_of(ds):
    return [list(r["values"]) for r in ds.slices().orderBy("slice").collect()]


def test_slice_layout(engine):
    ds = engine.parallelize(range(1, 8), 3)
    assert slices_of(ds) == [[1, 2, 7], [3, 4], [5, 6]]
    assert ds.collect() == [1, 2, 7, 3, 4, 5, 6]
    assert slices_of(engine.parallelize(range(4), 8)) == [[0], [1], [2], [3], [], [], [], []]
    assert engine.parallelize([1]).get_num_slices() == 8
    assert slices_of(engine.range(7, 3)) == layout(range(7), 3)
    with pytest.raises(ValueError):
        engine.parallelize([1], 0)


@given(st.integers(0, 60), st.integers(1, 12))
@settings(max_examples=200)
def test_slice_positions_model(size, n):
    assert [slice_positions(i, size, n) for i in range(n)] == layout(range(size), n)


def test_narrow(engine):
    ds = engine.parallelize([1, 2, 3, -3], 2)
    assert sorted(ds.map(lambda v: v + 1).map(lambda v: v - 1).collect()) == [-3, 1, 2, 3]
    assert sorted(ds.filter(lambda v: v > 1).collect()) == [2, 3]
    assert sorted(ds.flat_map(lambda v: F.array(v, v + 1)).collect()) == [-3, -2, 1, 2, 2, 3, 3, 4]
    none = ds.flat_map(lambda v: F.array().cast("array<bigint>"))
    assert none.collect() == [] and none.count() == 0
    assert sorted(ds.map_pair(lambda v: v % 2, lambda v: v).keys().collect()) == [-1, 0, 1, 1]
    assert sorted(ds.map_pair(lambda v: v).map_values(lambda v: v * 2).collect()) == [(-3, -6), (1, 2), (2, 4), (3, 6)]
    assert ds.map_pair(lambda v: v).filter(lambda k, v: v > 2).group_by_key().collect() == [(3, [3])]


def test_chained_maps_are_one_projection(engine):
    plan = engine.range(10, 2).map(lambda v: v + 1).map(lambda v: v - 1).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_filters_reach_the_scan(engine):
    ds = engine.read_parquet(f"{SF}/lineitem.parquet").filter(lambda v: v["l_quantity"] > 45)
    plan = ds.map_pair(lambda v: v["l_orderkey"], lambda v: v["l_quantity"]).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_tax" not in plan.split("ReadSchema")[1]


def test_reduce_folds_from_zero(engine):
    assert engine.parallelize([2, 3, 4]).reduce("product") == 0
    assert engine.parallelize([2, 3, 4]).reduce("min") == 0
    assert engine.parallelize([-2, -3]).reduce("max") == 0
    assert engine.parallelize([2, 3, 4]).reduce("sum") == 9
    assert engine.parallelize([2, 3, 4]).reduce(lambda a, b: a * b) == 0
    assert engine.parallelize([2, 3, 4]).reduce("product", zero=1) == 24
    assert engine.parallelize(["a", "b"], 2).reduce(lambda a, b: a + b) in ("ab", "ba")
    empty = engine.parallelize([], 2)
    assert (empty.reduce("sum"), empty.count(), empty.collect()) == (0, 0, [])
    assert empty.reduce(lambda a, b: a + b) == 0
    assert engine.parallelize([2, 3, 4]).reduce_strict("product") == 24
    assert engine.parallelize([2, 3, 4]).reduce_strict(lambda a, b: a * b) == 24
    with pytest.raises(ValueError):
        empty.reduce_strict("sum")


def test_run_job(engine):
    ds = engine.range(8, 4)
    assert ds.run_job(sum, [1, 3]) == [5, 13]
    assert ds.run_job(sum, [3, 1]) == [13, 5]
    assert ds.run_job(sum) == [1, 5, 9, 13]
    assert engine.run_job(engine.parallelize(range(4), 8), lambda it: len(list(it))) == [1, 1, 1, 1, 0, 0, 0, 0]
    assert engine.parallelize([3, 1, 2], 1).run_job(list) == [[3, 1, 2]]


def test_by_key(engine):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 5), rng.randint(-9, 9)) for _ in range(400)]
    ds = engine.parallelize(pairs, 4, "struct<k: bigint, v: bigint>").map_pair(lambda x: x["k"], lambda x: x["v"])
    want = {}
    for k, v in pairs:
        want.setdefault(k, []).append(v)
    assert {k: sorted(v) for k, v in ds.group_by_key(2).collect()} == {k: sorted(v) for k, v in want.items()}
    for n in (None, 3):
        assert dict(ds.reduce_by_key("sum", n).collect()) == {k: sum(v) for k, v in want.items()}
    assert dict(ds.reduce_by_key(lambda a, b: F.greatest(a, b)).collect()) == {k: max(v) for k, v in want.items()}
    assert dict(ds.count_by_key().collect()) == {k: len(v) for k, v in want.items()}
    assert ds.reduce_by_key("max", 3).df.rdd.getNumPartitions() == 3
    triple = Aggregator(
        lambda v: F.struct(v.alias("s"), F.lit(1).alias("n")),
        lambda c, v: F.struct((c["s"] + v).alias("s"), (c["n"] + 1).alias("n")),
        lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")),
        run=7,
    )
    means = ds.combine_by_key(triple).map_values(lambda c: c["s"] / c["n"])
    assert dict(means.collect()) == {k: sum(v) / len(v) for k, v in want.items()}
    opaque = ds.combine_by_key_py(lambda v: [v], lambda c, v: c + [v], lambda a, b: a + b, "array<bigint>", 2)
    assert {k: sorted(v) for k, v in opaque.collect()} == {k: sorted(v) for k, v in want.items()}


def test_null_keys_are_one_group(engine):
    ds = engine.parallelize([(None, 1), (None, 2), (1, 3)], 2, "struct<k: bigint, v: bigint>").map_pair(lambda x: x["k"], lambda x: x["v"])
    assert dict(ds.reduce_by_key("sum").collect()) == {None: 3, 1: 3}


def test_nested_cache(engine):
    a = engine.range(10, 2).map(lambda v: v * 2).cache()
    b = a.map(lambda v: v + 1).cache()
    assert b.reduce("sum") == 100 and a.reduce("sum") == 90
    assert a.cache_status()["cached"]
    a.unpersist(), b.unpersist()
    assert not a.cache_status()["cached"]


def test_tokens(spark):
    row = spark.createDataFrame([("", " a  b ", "x\ty\r\nz")], ["e", "s", "w"]).select(text.space_tokens(F.col("e")), text.space_tokens(F.col("s")), text.whitespace_tokens(F.col("w")), text.lines(F.col("w"))).first()
    assert list(row) == [[""], ["", "a", "", "b", ""], ["x", "y", "", "z"], ["x\ty\r", "z"]]


def test_files(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one two\r\nthree\n")
    assert sorted(engine.read_lines(str(tmp_path / "in")).collect()) == ["one two\r", "three"]
    (tmp_path / "j.json").write_text('{"t": "x"}\n{"u": 1}\n')
    assert sorted(engine.read_json_field(str(tmp_path / "j.json"), "t").collect()) == ["", "x"]
    from weftline.sources.files import write_text

    write_text(engine.parallelize(["p", "q"], 1), str(tmp_path / "out"), files=1)
    assert sorted(engine.read_lines(str(tmp_path / "out")).collect()) == ["p", "q"]


def test_opaque(engine):
    ds = engine.parallelize(["ab", "c"], 2)
    assert sorted(ds.map_py(len, "int").collect()) == [1, 2]
    assert sorted(ds.flat_map_py(list, "string").collect()) == ["a", "b", "c"]
    assert ds.filter_py(lambda s: len(s) > 1).collect() == ["ab"]


def test_union_and_partition_by(engine):
    a, b = engine.range(3, 2), engine.parallelize([2, 9], 1)
    both = a.union(b)
    assert sorted(both.collect()) == [0, 1, 2, 2, 9]
    dealt = both.map_pair(lambda v: v % 2, lambda v: v).partition_by(3)
    assert dealt.df.rdd.getNumPartitions() == 3
    out = dealt.reduce_by_key("sum")
    assert out.df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert dict(out.collect()) == {0: 4, 1: 10}
    assert sorted(a.map_pair(lambda v: v).union(b.map_pair(lambda v: v)).keys().collect()) == [0, 1, 2, 2, 9]
    assert {r.slice: r.n for r in engine.range(7, 3).count_by_slice().collect()} == {0: 3, 1: 2, 2: 2}


def test_json_to_text(engine, spark, tmp_path):
    import gzip

    from weftline.sources.files import json_to_text

    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write('{"t": "a b"}\n{"u": 1}\n{"t": "b"}\n')
    json_to_text(spark, str(tmp_path / "r.json.gz"), "t", str(tmp_path / "out"), 2)
    words = workloads.word_count(engine.read_lines(str(tmp_path / "out")))
    assert dict(words.collect()) == {"a": 1, "b": 2, "": 1}


def test_workloads(engine, spark):
    assert sorted(workloads.basics(engine).collect()) == [12, 16]
    assert sorted(workloads.nested_flat_map(engine.range(4, 8)).collect()) == [(0, 40), (1, 8)]
    words = "I am a friend of great spark indeed".split()
    lines = [" ".join(words[i % 8 :] + words[: i % 8]) for i in range(45)]
    assert dict(workloads.word_count(engine.parallelize(lines, 45), num_partitions=2).collect()) == dict.fromkeys(words, 45)
    assert [workloads.monte_carlo_hits(spark, c, d).first()[0] for c, d in ((10, 100), (100, 100), (10_000, 100))] == [809, 7816, 785328]
    assert abs(workloads.monte_carlo_pi_random(spark, 200_000).first()[0] - 3.14) < 0.05


def test_seed_residues(spark):
    seeds = spark.createDataFrame([(5,), (5 + lcg.MODULUS,)], ["s"])
    a, b = (r[0] for r in seeds.select(lcg.hits(F.col("s"), 50)).collect())
    assert a == b


def test_barrier(spark):
    assert workloads.barrier_ring(spark, 2) == [(0, "1"), (1, "0")]


def test_streaming_reduce_by_key(spark, tmp_path):
    from weftline.streaming.keyed import reduce_by_key_window, word_count_stream

    spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    out = reduce_by_key_window(stream, "ts", F.col("event_type"), F.floor("value").cast("bigint"), "sum", "1 hour", "10 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{SF}/events.parquet").agg(F.sum(F.floor("value"))).first()[0]
    assert spark.table("sums").agg(F.sum("value")).first()[0] == want
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("a b a\n")
    q = word_count_stream(spark.readStream.text(str(tmp_path / "t"))).writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.value for r in spark.table("words").collect()} == {"a": 2, "b": 1}


def test_triple_combines_before_the_shuffle(spark):
    triple = agg.Aggregator(lambda v: v, lambda c, v: c + v, lambda a, b: a + b, run=10)
    pairs = Engine(spark).range(1000, 4).map_pair(lambda v: v % 3)
    want = sorted((k, sum(range(k, 1000, 3))) for k in range(3))
    for parts, exchanges in ((None, 2), (3, 2)):
        out = pairs.combine_by_key(triple, parts)
        assert sorted(out.collect()) == want
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        # the fold of each partition's values stands below everything that is dealt
        assert plan.index("MapInArrow") > plan.rindex("Aggregate")
        assert out.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") in (exchanges, 2 * exchanges)
    nested = Engine(spark).range(10, 2).map_pair(lambda v: F.struct((v % 2).alias("a")), lambda v: v).combine_by_key(triple)
    assert sorted((k.a, v) for k, v in nested.collect()) == [(0, 20), (1, 25)]
    some = Engine(spark).range(10, 2).map_pair(lambda v: F.when(v % 2 == 0, v % 4), lambda v: v).combine_by_key(triple)
    assert sorted(some.collect(), key=repr) == sorted([(0, 12), (2, 8), (None, 25)], key=repr)


def test_partitioner(spark):
    by = HashPartitioner(5, integral=True)
    assert by == HashPartitioner(5, integral=True) and by != HashPartitioner(4, integral=True)
    pairs = Engine(spark).range(40, 4).map_pair(lambda v: v % 7)
    triple = agg.Aggregator(lambda v: v, lambda c, v: c + v, lambda a, b: a + b)
    for out in (pairs.partition_by(by), pairs.combine_by_key(triple, by), pairs.reduce_by_key("sum", by)):
        assert out.get_num_slices() == 5
        assert [sorted({k for k, _ in x}) for x in out.run_job(list)] == [[0, 5], [1, 6], [2], [3], [4]]


def test_actions_of_pairs(spark):
    pairs = Engine(spark).range(5, 2).map_pair(lambda v: v % 2).persist()
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    assert pairs.reduce(add) == (2, 10) == pairs.reduce_strict(add) and pairs.reduce("max") == (1, 3) and pairs.reduce("min") == (0, 0)
    assert sorted(pairs.iterate()) == sorted(pairs.collect()) and pairs.union(pairs).distinct().count() == 5
    assert sum(pairs.run_job(lambda it: sum(v for _, v in it))) == 10 and len(pairs.run_job(list, [1])) == 1
    status = pairs.cache_status()
    assert status["cached"] and all(h["capacity"] >= h["used"] >= 0 for h in status["hosts"].values())
    assert len(pairs.cache_locations()) == pairs.get_num_slices()
    assert not pairs.unpersist().cache_status()["cached"]


def test_zeros_of_all_types(spark):
    of = lambda f: Engine(spark).range(3, 2).map(f)
    assert of(lambda v: (v + 1).cast("decimal(5,1)")).reduce("min") == 0
    assert of(lambda v: F.date_from_unix_date(v.cast("int") + 1)).reduce("min").isoformat() == "1970-01-01"
    assert of(lambda v: F.timestamp_seconds(v + 1)).reduce("min").year == 1970
    assert of(lambda v: F.encode(v.cast("string"), "utf-8")).reduce("min") == b""
    assert tuple(of(lambda v: F.struct((v + 1).alias("a"), F.lit("x").alias("b"))).reduce("min")) == (0, "")
    assert tuple(of(lambda v: F.struct(v.alias("a"), F.lit("x").alias("b"))).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))) == (3, "xxx")


def test_jumps_equal_the_walk(spark):
    for chunks, draws, hits in ((10, 100, 809), (100, 100, 7816), (1000, 1000, 785219)):
        assert workloads.monte_carlo_hits(spark, chunks, draws).first()[0] == hits
    assert workloads.monte_carlo_hits(spark, 30, 77, jump=False).first() == workloads.monte_carlo_hits(spark, 30, 77).first()
    assert not lcg.hits_by_state(0).any()
