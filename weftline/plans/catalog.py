"""Named queries over the star-schema tables, each with the SQL it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.engine import Engine
from weftline.functions import text
from weftline.operators import aggregators as agg
from weftline.operators.partitioning import HashPartitioner, bucket
from weftline.plans import workloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark)


def _renamed(pairs, key: str, value: str) -> DataFrame:
    return pairs.df.select(F.col("key").alias(key), F.col("value").alias(value))


_WORDS = "SELECT word, count(*) AS cnt FROM (SELECT unnest({split}) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY word"
_SPACE = _WORDS.format(split="string_split(line, ' ')")


@_query(_SPACE)
def word_count(spark, d):
    texts = _engine(spark).read_parquet(f"{d}/documents.parquet", "text")
    return _renamed(workloads.word_count(texts), "word", "cnt")


@_query("SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]')) AS word FROM documents) GROUP BY word")
def word_count_whitespace(spark, d):
    words = _engine(spark).read_parquet(f"{d}/documents.parquet", "text").flat_map(text.whitespace_tokens)
    return _renamed(words.map_pair(lambda w: w, lambda _: F.lit(1).cast("bigint")).reduce_by_key("sum"), "word", "cnt")


@_query(_SPACE)
def cached_word_count(spark, d):
    texts = _engine(spark).read_parquet(f"{d}/documents.parquet", "text")
    return _renamed(workloads.word_count(texts, cache=True), "word", "cnt")


@_query("SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(html, ' ')) AS token FROM pages) GROUP BY token")
def page_tokens(spark, d):
    tokens = _engine(spark).read_parquet(f"{d}/pages.parquet", "html").flat_map(text.space_tokens)
    return _renamed(tokens.map_pair(lambda w: w).count_by_key(), "token", "cnt")


@_query("SELECT l_linenumber AS v, count(*) AS n FROM (SELECT (l_linenumber + 1) - 1 AS l_linenumber FROM lineitem) GROUP BY 1")
def map_chain(spark, d):
    data = _engine(spark).read_parquet(f"{d}/lineitem.parquet", "l_linenumber").map(lambda v: v + 1).map(lambda v: v - 1)
    return _renamed(data.map_pair(lambda v: v).count_by_key(), "v", "n")


@_query("SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_predicate(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    kept = rows.filter(lambda v: (v["l_quantity"] > 45) & (v["l_returnflag"] == "R"))
    return _renamed(kept.map_pair(lambda v: v["l_orderkey"], lambda v: v["l_quantity"].cast("bigint")), "l_orderkey", "qty")


@_query("SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def flat_map_lines(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/documents.parquet")
    lines = rows.flat_map(lambda v: F.transform(text.lines(v["text"]), lambda _: v["doc_id"]))
    return _renamed(lines.map_pair(lambda v: v).count_by_key(), "doc_id", "n_lines")


@_query("SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY l_orderkey")
def group_by_key(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    groups = rows.map_pair(lambda v: v["l_orderkey"], lambda v: v["l_linenumber"]).group_by_key()
    return _renamed(groups.map_values(lambda vs: F.array_join(F.transform(F.sort_array(vs), lambda v: v.cast("string")), ",")), "l_orderkey", "line_numbers")


@_query("SELECT sum(v)::BIGINT AS total FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS v) GROUP BY v % 2")
def basics_group_sum(spark, d):
    return workloads.basics(_engine(spark)).df.select(F.col("value").alias("total"))


@_query("SELECT v % 2 AS parity, sum(v)::BIGINT AS total FROM (SELECT unnest([v, 2 * v]) AS v FROM (SELECT unnest([l_linenumber, l_linenumber + 1])::BIGINT AS v FROM lineitem)) GROUP BY 1")
def nested_flat_map(spark, d):
    data = _engine(spark).read_parquet(f"{d}/lineitem.parquet", F.col("l_linenumber").cast("bigint"))
    return _renamed(workloads.nested_flat_map(data), "parity", "total")


@_query("SELECT o_custkey AS custkey, count(*)::BIGINT AS n_orders, max(CAST(floor(o_totalprice) AS BIGINT)) AS top FROM orders GROUP BY 1")
def reduce_by_key(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/orders.parquet")
    pairs = rows.map_pair(lambda v: v["o_custkey"], lambda v: F.struct(F.lit(1).cast("bigint").alias("n"), F.floor(v["o_totalprice"]).cast("bigint").alias("t")))
    out = pairs.aggregate_by_key(F.struct(F.sum("value.n").alias("n"), F.max("value.t").alias("t")))
    return out.df.select(F.col("key").alias("custkey"), F.col("value.n").alias("n_orders"), F.col("value.t").alias("top"))


@_query("SELECT l_suppkey AS suppkey, min(l_linenumber) AS least FROM lineitem GROUP BY 1")
def reduce_by_key_lambda(spark, d):
    """A Column function instead of a named combiner."""
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    pairs = rows.map_pair(lambda v: v["l_suppkey"], lambda v: v["l_linenumber"])
    return _renamed(pairs.reduce_by_key(lambda a, b: F.least(a, b)), "suppkey", "least")


_SUM_COUNT = "SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total, count(*) AS n FROM lineitem GROUP BY 1"


@_query(_SUM_COUNT)
def combine_by_key_sum_count(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    triple = agg.Aggregator(
        lambda v: F.struct(v.alias("s"), F.lit(1).cast("bigint").alias("n")),
        lambda c, v: F.struct((c["s"] + v).alias("s"), (c["n"] + 1).alias("n")),
        lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")),
    )
    out = rows.map_pair(lambda v: v["l_returnflag"], lambda v: v["l_quantity"].cast("bigint")).combine_by_key(triple)
    return out.df.select(F.col("key").alias("l_returnflag"), F.col("value.s").alias("total"), F.col("value.n").alias("n"))


@_query(_SUM_COUNT)
def combine_by_key_opaque(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    pairs = rows.map_pair(lambda v: v["l_returnflag"], lambda v: v["l_quantity"].cast("bigint"))
    out = pairs.combine_by_key_py(lambda v: {"s": v, "n": 1}, lambda c, v: {"s": c["s"] + v, "n": c["n"] + 1}, lambda a, b: {"s": a["s"] + b["s"], "n": a["n"] + b["n"]}, "struct<s: bigint, n: bigint>")
    return out.df.select(F.col("key").alias("l_returnflag"), F.col("value.s").alias("total"), F.col("value.n").alias("n"))


_LONGEST = agg.Aggregator(
    lambda v: F.struct(v.alias("longest"), F.lit(1).cast("bigint").alias("n")),
    lambda c, v: F.struct(F.greatest(c["longest"], v).alias("longest"), (c["n"] + 1).alias("n")),
    lambda a, b: F.struct(F.greatest(a["longest"], b["longest"]).alias("longest"), (a["n"] + b["n"]).alias("n")),
)


@_query("SELECT l_suppkey AS suppkey, max(l_extendedprice) AS longest, count(*) AS n FROM lineitem GROUP BY 1")
def combine_by_key_partitions(spark, d):
    """The triple with a fixed number of reduce partitions."""
    rows = _engine(spark).read_parquet(f"{d}/lineitem.parquet")
    out = rows.map_pair(lambda v: v["l_suppkey"], lambda v: v["l_extendedprice"]).combine_by_key(_LONGEST, 5)
    return out.df.select(F.col("key").alias("suppkey"), F.col("value.longest").alias("longest"), F.col("value.n").alias("n"))


@_query("SELECT (o_custkey % 5)::INTEGER AS partition, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1")
def partitioner(spark, d):
    """Rows and keys of each reduce partition that a partitioner says, counted where they lie."""
    rows = _engine(spark).read_parquet(f"{d}/orders.parquet")
    dealt = rows.map_pair(lambda v: v["o_custkey"], lambda v: v["o_orderkey"]).partition_by(HashPartitioner(5, integral=True))
    return dealt.df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@_query("SELECT max(o_custkey) AS custkey, max(o_orderkey) FILTER (o_custkey = top) AS orderkey FROM orders, (SELECT max(o_custkey) AS top FROM orders)")
def reduce_pairs(spark, d):
    """The largest pair: a fold of structs from the defaults of key and value."""
    rows = _engine(spark).read_parquet(f"{d}/orders.parquet")
    pairs = rows.map_pair(lambda v: v["o_custkey"], lambda v: v["o_orderkey"]).as_dataset()
    return pairs.df.agg(pairs.reduce_expr("max").alias("r")).select(F.col("r.key").alias("custkey"), F.col("r.value").alias("orderkey"))


@_query("SELECT least(0, min(CAST(c_acctbal AS DECIMAL(12, 2))))::DOUBLE AS lowest, DATE '1970-01-01' AS first_day FROM customer")
def fold_zeros(spark, d):
    """Minima from the zeros of a decimal and of a date."""
    rows = _engine(spark).read_parquet(f"{d}/customer.parquet")
    low = rows.map(lambda v: v["c_acctbal"].cast("decimal(12,2)"))
    day = rows.map(lambda v: F.date_from_unix_date(v["c_custkey"].cast("int")))
    return low.df.agg(low.reduce_expr("min").cast("double").alias("lowest")).crossJoin(day.df.agg(day.reduce_expr("min").alias("first_day")))


@_query("SELECT n_nationkey AS nation, upper(n_name) AS name FROM nation")
def map_values(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/nation.parquet")
    return _renamed(rows.map_pair(lambda v: v["n_nationkey"], lambda v: v["n_name"]).map_values(F.upper), "nation", "name")


@_query("SELECT count(*) AS n FROM orders")
def count_action(spark, d):
    return _engine(spark).read_parquet(f"{d}/orders.parquet", "o_orderkey").count_df()


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def keyed_counts(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/events.parquet", "event_type")
    return _renamed(rows.map_pair(lambda v: v).count_by_key(), "event_type", "n")


def _fold(spark, d, combiner, table, column, name):
    data = _engine(spark).read_parquet(f"{d}/{table}.parquet", F.floor(F.col(column)).cast("bigint"))
    return data.df.agg(data.reduce_expr(combiner).alias(name))


@_query("SELECT coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0)::BIGINT AS total FROM orders")
def reduce_sum(spark, d):
    return _fold(spark, d, "sum", "orders", "o_totalprice", "total")


@_query("SELECT least(0, coalesce(min(CAST(floor(o_totalprice) AS BIGINT)), 0)) AS least_value FROM orders")
def fold_min_zero(spark, d):
    return _fold(spark, d, "min", "orders", "o_totalprice", "least_value")


@_query("SELECT greatest(0, coalesce(max(CAST(floor(c_acctbal) AS BIGINT)), 0)) AS greatest_value FROM customer")
def fold_max_zero(spark, d):
    return _fold(spark, d, "max", "customer", "c_acctbal", "greatest_value")


def _order_slices(spark, d, n):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return _engine(spark).slices(orders, F.col("o_orderkey"), orders.count(), n, F.col("o_orderkey"))


_SLICED = "(SELECT o_orderkey, CASE WHEN o_orderkey < {n} * (total // {n}) THEN o_orderkey // (total // {n}) ELSE o_orderkey - {n} * (total // {n}) END::INTEGER AS slice FROM orders, (SELECT count(*) AS total FROM orders))"


@_query(f"SELECT slice, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, sum(o_orderkey)::BIGINT AS total FROM {_SLICED.format(n=7)} GROUP BY slice")
def slice_layout(spark, d):
    df = _order_slices(spark, d, 7).df
    return df.groupBy(F.col("_slice").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"))


@_query(f"SELECT slice, sum(o_orderkey)::BIGINT AS total FROM {_SLICED.format(n=8)} WHERE slice IN (1, 3) GROUP BY slice")
def run_job_subset(spark, d):
    """A job over chosen slices: the choice is a filter, so other slices are never aggregated."""
    df = _order_slices(spark, d, 8).df.where(F.col("_slice").isin(1, 3))
    return df.groupBy(F.col("_slice").alias("slice")).agg(F.sum("value").alias("total"))


@_query("SELECT (o_orderkey % 6)::INTEGER AS bucket, count(*) AS n FROM orders GROUP BY 1")
def hash_bucket(spark, d):
    keys = _engine(spark).read_parquet(f"{d}/orders.parquet", "o_orderkey")
    return _renamed(keys.map_pair(lambda v: bucket(v, 6)).count_by_key(), "bucket", "n")


@_query("SELECT cnt, count(*) AS n_words FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY word) GROUP BY cnt")
def two_shuffle(spark, d):
    counts = workloads.word_count(_engine(spark).read_parquet(f"{d}/documents.parquet", "text"))
    return _renamed(counts.map_pair(lambda k, v: v, lambda k, v: F.lit(1).cast("bigint")).reduce_by_key("sum"), "cnt", "n_words")


@_query("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def distinct_keys(spark, d):
    return _engine(spark).read_parquet(f"{d}/lineitem.parquet", "l_partkey").distinct().count_df()


@_query("SELECT label, sum(floor(v * 1000))::BIGINT AS total FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")
def flat_map_arrays(spark, d):
    rows = _engine(spark).read_parquet(f"{d}/embeddings.parquet")
    cells = rows.flat_map(lambda v: F.transform(v["embedding"], lambda x: F.struct(v["label"].alias("label"), x.cast("double").alias("x"))))
    return _renamed(cells.map_pair(lambda v: v["label"], lambda v: F.floor(v["x"] * 1000).cast("bigint")).reduce_by_key("sum"), "label", "total")


_PI = """WITH RECURSIVE w(seed, i, n, c) AS (
  SELECT seed, 0, (seed % 134456)::BIGINT, 0::BIGINT FROM range({chunks}) t(seed)
  UNION ALL
  SELECT seed, i + 1, ny, c + CASE WHEN (nx / 67228.0::DOUBLE - 1) * (nx / 67228.0::DOUBLE - 1) + (ny / 67228.0::DOUBLE - 1) * (ny / 67228.0::DOUBLE - 1) < 1 THEN 1 ELSE 0 END
  FROM (SELECT seed, i, c, nx, (998244353::BIGINT * nx + 19260817) % 134456 AS ny FROM (SELECT seed, i, c, (998244353::BIGINT * n + 19260817) % 134456 AS nx FROM w WHERE i < {draws}))
) SELECT sum(c)::BIGINT AS hits FROM w WHERE i = {draws}"""


@_query(_PI.format(chunks=100, draws=100))
def monte_carlo_pi(spark, d):
    return workloads.monte_carlo_hits(spark, 100, 100)


@_query()
def monte_carlo_pi_random(spark, d):
    return workloads.monte_carlo_pi_random(spark, 1_000_000)


@_query("SELECT upper(event_type) AS kind, count(*) AS n FROM events WHERE length(event_type) > 4 GROUP BY 1")
def opaque_python(spark, d):
    """Python closures in place of Column functions, moved in Arrow batches."""
    rows = _engine(spark).read_parquet(f"{d}/events.parquet", "event_type")
    kept = rows.filter_py(lambda s: len(s) > 4).map_py(lambda s: s.upper(), "string")
    return _renamed(kept.map_pair(lambda v: v).count_by_key(), "kind", "n")


@_query("SELECT c_custkey AS custkey, c_mktsegment AS seg, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_by_key(spark, d):
    """Beyond the core: a join of two pair datasets."""
    e = _engine(spark)
    left = e.read_parquet(f"{d}/customer.parquet").map_pair(lambda v: v["c_custkey"], lambda v: v["c_mktsegment"])
    right = e.read_parquet(f"{d}/orders.parquet", "o_custkey").map_pair(lambda v: v).count_by_key()
    return left.join(right).select(F.col("key").alias("custkey"), F.col("left").alias("seg"), F.col("right").alias("n"))


@_query("SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key")
def union_counts(spark, d):
    """Beyond the core: two datasets' partitions side by side, then a keyed count."""
    e = _engine(spark)
    both = e.read_parquet(f"{d}/customer.parquet", "c_nationkey").union(e.read_parquet(f"{d}/supplier.parquet", "s_nationkey"))
    return _renamed(both.map_pair(lambda v: v).count_by_key(), "key", "n")


@_query("SELECT o_custkey AS custkey, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total, count(*) AS n FROM orders GROUP BY 1")
def partition_by(spark, d):
    """One exchange on the key; both the sum and the count use its partitioning."""
    rows = _engine(spark).read_parquet(f"{d}/orders.parquet")
    dealt = rows.map_pair(lambda v: v["o_custkey"], lambda v: F.floor(v["o_totalprice"]).cast("bigint")).partition_by(8)
    out = dealt.aggregate_by_key(F.struct(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")))
    return out.df.select(F.col("key").alias("custkey"), F.col("value.s").alias("total"), F.col("value.n").alias("n"))


@_query(f"SELECT slice, count(*) AS n FROM {_SLICED.format(n=5)} GROUP BY slice")
def count_by_slice(spark, d):
    return _order_slices(spark, d, 5).count_by_slice()


@_query("SELECT o_orderpriority AS priority, sum(length(o_orderstatus))::BIGINT AS n FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1")
def filter_pairs(spark, d):
    """Pairs stay pairs through ``filter``."""
    rows = _engine(spark).read_parquet(f"{d}/orders.parquet")
    pairs = rows.map_pair(lambda v: v["o_orderpriority"], lambda v: F.struct(v["o_custkey"].alias("c"), F.length(v["o_orderstatus"]).cast("bigint").alias("n")))
    return _renamed(pairs.filter(lambda _, v: v["c"] % 2 == 1).map_values(lambda v: v["n"]).reduce_by_key("sum"), "priority", "n")
