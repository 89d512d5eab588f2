import duckdb
import pytest

from tests.conftest import SF
from weftline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    assert got
    if name in catalog.SQL:
        r = sql.execute(catalog.SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in r.fetchall()) == got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_word_count_combines_before_the_shuffle(spark):
    plan = catalog.QUERIES["word_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "ReadSchema: struct<text:string>" in plan
