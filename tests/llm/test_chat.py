import hashlib

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.llm import chat, queries


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return chat.format_conversations(spark.createDataFrame(rows, schema))


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    df = queries.QUERIES["op5_chat_formatting"](spark, SF)
    r = c.execute(chat.SQL)
    names = [x[0] for x in r.description]
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in df.select(names).collect())


def test_control_strings_round_trip(spark):
    texts = ["</turn>", "\\l\\e\\", "<turn:user>x</turn>", "a\\<b>", "", None, "é\n<image:0> 𝄞"]
    rows = [(1, i, "a<b>\\g" if i == 2 else "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    out = formatted(spark, rows)
    turns = out.select(chat.read_back(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [(r[2], r[3] or "") for r in rows]
    d = chat.digests(out).first()
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (7, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    said = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows)
    assert d.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_parts(spark):
    def part(kind, text=None, uri=None, w=None, h=None, s=None, p=None):
        return (kind, text, uri, w, h, s, p)

    rows = [
        (1, 0, "user", None, [part("text", "see <"), part("image", uri="i.png", w=28, h=15), part("audio", uri="a.wav", s=1.5), part("text", "!")], "clash"),
        (1, 1, "assistant", "plain", None, "clash"),
        (1, 2, "user", "ignored", [part("document", uri="d.pdf", p=3), part("image")], "clash"),
        (2, 0, "user", None, [], "clash"),
    ]
    got = {r.conv_id: r for r in formatted(spark, rows, f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>, formatted string").collect()}
    r = got[1]
    assert r.formatted == "<turn:user>see \\l<image:0><audio:1>!</turn><turn:assistant>plain</turn><turn:user><document:2><image:3></turn>"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 768), (3, "image", None, 1)]
    assert r.attachment_tokens == 811
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["plain"]
    assert got[2].formatted == "<turn:user></turn>" and got[2].attachments == []


def test_placeholders_and_texts_that_look_like_them(spark):
    rows = [(1, 0, "user", [("text", "say <image:0>\\", None, None, None, None, None), ("image", None, "i.png", 28, 28, None, None), ("text", "<audio:1>", None, None, None, None, None)]), (1, 1, "assistant", [])]
    out = formatted(spark, rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    turns = out.select(chat.read_parts(F.col("formatted")).alias("t")).first().t
    assert [(t.role, [tuple(p) for p in t.parts]) for t in turns] == [("user", [("text", "say <image:0>\\", None), ("image", None, 0), ("text", "<audio:1>", None)]), ("assistant", [])]
    d = chat.digests(out).first()
    assert (d.n_attachments, d.attachment_tokens) == (1, 4)


def test_ties_nulls_and_no_rows(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, None, "z"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert got[None].formatted == "<turn:>z</turn><turn:user>a</turn><turn:user>b</turn>"
    assert got[3].n_turns == 2
    assert formatted(spark, []).count() == 0


def test_native(spark):
    plan = queries.QUERIES["op5_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
