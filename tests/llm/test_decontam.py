import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.llm import decontam, queries


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return {(r.doc_id, r.item_id): (round(r.coverage, 3), r.changed) for r in decontam.leaks(d, b).collect()}


QUESTION = "A train leaves London at 9 hours and travels 120 km. Then Alice walks 120 km to Paris. How far did Alice go in 2 days?"


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES["op9_benchmark_decontamination"](spark, SF)
    r = c.execute(decontam.SQL)
    names = [x[0] for x in r.description]
    rows = r.fetchall()
    assert rows and sorted(map(repr, rows)) == sorted(repr(tuple(x)) for x in df.select(names).collect())


def test_sql_equals_on_slots(spark):
    docs = [(i, t) for i, t in enumerate(VARIANTS)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.execute("CREATE TABLE benchmark AS SELECT 1::BIGINT AS item_id, ? AS text", [QUESTION])
    want = {(r[0], r[1]): (round(r[4], 3), r[5]) for r in c.execute(decontam.SQL).fetchall()}
    assert found(spark, docs, [(1, QUESTION)]) == want


VARIANTS = [
    QUESTION,
    "Some intro here. " + QUESTION.upper() + " and more",
    QUESTION.replace("120", "77.5").replace("Alice", "Robert").replace("London", "Rome"),
    QUESTION.replace("120 km.", "5 km.").replace("120 km to", "6 km to"),
    "Nothing of the kind stands here, only 120 km and 2 days of words.",
]


@pytest.mark.parametrize(("k", "want"), [(0, (1.0, False)), (1, (1.0, False)), (2, (1.0, True)), (3, (0.824, True)), (4, None)])
def test_slots(spark, k, want):
    """A copy, one in capitals, one with other numbers and names, one where one value of the item
    stands for two (only windows of the less frequent one don't count), and another text."""
    assert found(spark, [(5, VARIANTS[k])], [(1, QUESTION)]).get((5, 1)) == want


def test_partial_and_split_passages(spark):
    item = " ".join(f"word{chr(97 + i)}" for i in range(26))
    half = " ".join(item.split()[:14])
    edited = item.replace("wordm", "other")
    got = found(spark, [(1, half), (2, "x y z " + item + " tail"), (3, edited), (4, item.replace(" ", ",\n"))], [(9, item), (8, "too short")])
    assert got == {(2, 9): (1.0, False), (4, 9): (1.0, False)}
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    assert found(spark, [(1, long.replace("wbd", "zzz"))], [(9, long)])[1, 9][0] == round(51 / 56, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "just three words"), (4, "just three words"), (None, "one two three four five six"), (5, "word " * 60_000)]
    items = [(1, "just three words"), (2, None), (3, ""), (4, "One two three four five, six!"), (5, "word word word word word word")]
    assert found(spark, docs, items) == {(4, 1): (1.0, False), (None, 4): (1.0, False), (5, 5): (1.0, False)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert found(spark, docs, items[1:2]) == {}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    left = decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3"]  # a null id saves no one
    twice = spark.createDataFrame([(7, "just three words"), (7, "clean"), (None, "clean too")], "doc_id long, text string").withColumn("_leak", F.lit("clash"))
    left = decontam.decontaminate(twice, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "_leak"] and sorted(r.text for r in left.collect()) == ["clean", "clean too"]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    want = {tuple(r) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()} == want


def test_native(spark):
    df = queries.QUERIES["op9_benchmark_decontamination"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for x in (df, decontam.windows(decontam.templates(docs, "doc_id"), "doc_id")):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


TOM = "Tom has 5 apples. Tom gives 2 apples to Ben. How many apples does Tom have left now?"
MARK = 'Mark has a garden with flowers. Mark planted 10 roses there.\n"Lucy wants 8 of them," said Mark. Mark sold 8 of them to Lucy at noon.'


def test_names_that_begin_a_sentence(spark):
    """Other names at the start of texts, sentences, lines and quotes; one that stands for two; titles."""
    anna = TOM.replace("Tom", "Anna").replace("Ben", "Carl").replace("5", "7").replace("2", "3")
    docs = [
        (1, anna),
        (2, "Before it. " + MARK.replace("Mark", "Peter").replace("Lucy", "Sophie").replace("8", "12")),
        (3, TOM.replace("Tom has", "Anna has").replace("Tom gives", "Carl gives").replace("does Tom", "does Ruth").replace("Ben", "Max")),
        (4, "Quite Another Book Title Of Words In Capitals"),
        (5, TOM),
    ]
    items = [(1, TOM), (2, MARK), (3, "Some Title Of The Same Kind In Capitals"), (4, "Hello there")]
    assert found(spark, docs, items) == {(1, 1): (1.0, True), (2, 2): (1.0, True), (5, 1): (1.0, False)}


def test_loose_windows_take_nothing_away(spark):
    """A sentence begins otherwise, at odds with an equal beginning; the sure windows still count."""
    rest = " ".join(f"word{chr(97 + i)}" for i in range(26)) + " 5 " + " ".join(f"more{chr(97 + i)}" for i in range(26))
    item = f"The boy went out early today. {rest}. The boy came home"
    doc = item.replace("The boy went", "Some boy went").replace(" 5 ", " 6 ")
    assert found(spark, [(1, doc)], [(9, item)])[1, 9][1]
