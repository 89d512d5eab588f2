"""Chat formatting with typed content parts, in DataFrame functions only.

Template: ``<turn:ROLE>BODY</turn>`` for each turn. In texts a backslash becomes ``\\e`` and
``<`` becomes ``\\l`` (in roles also ``>`` becomes ``\\g``), so ``<`` only ever starts a
control string and every text is restored exactly. Attachments stand in their body as
``<image:N>``, ``<audio:N>`` or ``<document:N>``, numbered through the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parts a turn may hold; fields that a type doesn't need are null.
PART = "struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
PATCH = 14  # pixels to an image token's side
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 256
ATTACHED = ("image", "audio", "document")
OPEN, CLOSE = "<turn:", "</turn>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\g"), F.lit(">")))


def is_attached(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*ATTACHED), F.lit(False))


def expanded_tokens(p: Column) -> Column:
    """Token positions that an attachment's placeholder stands for, at least one."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / PATCH)
    n = F.when(p["type"] == "image", side(p["width"]) * side(p["height"])).when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE)).otherwise(F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
    return F.greatest(F.lit(1), n).cast("long")


def _visit(parts: Column, before: Column) -> tuple[Column, Column]:
    """Body and attachments of one turn's parts; ``before``: attachments of earlier turns.

    A part of no known type counts as text.
    """
    # numbers of attached parts within the turn: how many positions of attached parts are at or before it
    at = F.filter(F.transform(parts, lambda p, i: F.when(is_attached(p), i)), lambda i: i.isNotNull())
    number = lambda i: before + F.array_position(at, i) - 1
    body = F.array_join(F.transform(parts, lambda p, i: F.when(is_attached(p), F.concat(F.lit("<"), p["type"], F.lit(":"), number(i).cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    refs = F.transform(at, lambda i: F.struct(number(i).alias("number"), parts[i]["type"].alias("type"), parts[i]["uri"].alias("uri"), expanded_tokens(parts[i]).alias("tokens")))
    return body, refs


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, n_turns, loss_spans (start and length in
    code points of each assistant body), attachments (number, type, uri, tokens), attachment_tokens.

    ``turns``: conv_id, turn, role and text, or ``parts`` (array of ``PART``), which wins
    where it isn't null. Null texts and roles are empty; a null turn number comes first; rows
    with equal turn numbers follow in order of role, text and their other columns' hash;
    repeated rows are turns each; rows with a null conv_id form one conversation. A whole
    conversation is one row, as its output is; no turns at all give no rows. Other columns
    aren't read.
    """
    # text sorted as its bytes; parts only break ties
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), parts) if "text" in turns.columns else F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    n_att = F.size(F.filter("parts", is_attached))
    order = ["turn", "role", F.get(F.col("parts"), 0)["text"], F.xxhash64("parts")]
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() if isinstance(c, str) else c.asc_nulls_first() for c in order])
    placed = rows.withColumn("k", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum(n_att).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    body, refs = _visit(F.col("parts"), F.col("before"))
    bodied = placed.select("conv_id", "k", "role", body.alias("body"), refs.alias("refs"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">"))
    shown = bodied.select("conv_id", "k", "role", head.alias("head"), "body", "refs").withColumn("n", F.length("head") + F.length("body") + len(CLOSE))
    at = F.sum("n").over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") + F.length("head")
    spanned = shown.withColumn("span", F.when(F.col("role") == "assistant", F.struct(at.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    out = spanned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("head", "body", F.lit(CLOSE)).alias("s"), "span", "refs"))).alias("t"))
    atts = F.flatten(F.transform("t", lambda x: x["refs"]))
    return out.select(
        "conv_id",
        F.array_join(F.col("t.s"), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        atts.alias("attachments"),
        F.aggregate(atts, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) parsed from formatted text; placeholders stay in the text as they are."""
    segs = F.filter(F.split(formatted, CLOSE), lambda s: s != "")

    def turn(s: Column) -> Column:
        head = F.substring_index(s, ">", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(s, F.length(head) + 2)).alias("text"))

    return F.transform(segs, turn)


def read_parts(formatted: Column) -> Column:
    """Turns (role, parts) parsed from formatted text; parts are texts (type text) and placeholders
    (type and number of the attachment), so a text that says ``<image:0>`` isn't taken for one."""
    segs = F.filter(F.split(formatted, CLOSE), lambda s: s != "")
    none = lambda t: F.lit(None).cast(t)

    def part(p: Column) -> Column:
        placed = F.struct(F.regexp_extract(p, "^<([a-z]+):", 1).alias("type"), none("string").alias("text"), F.regexp_extract(p, ":([0-9]+)>$", 1).cast("int").alias("number"))
        return F.when(p.startswith("<"), placed).otherwise(F.struct(F.lit("text").alias("type"), unescape(p).alias("text"), none("int").alias("number")))

    def turn(s: Column) -> Column:
        head = F.substring_index(s, ">", 1)
        pieces = F.regexp_extract_all(F.substr(s, F.length(head) + 2), F.lit("<[a-z]+:[0-9]+>|[^<]+"), F.lit(0))
        return F.struct(unescape_role(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), F.transform(pieces, part).alias("parts"))

    return F.transform(segs, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from formatted conversations and their loss spans, and the
    attachments recorded with their expanded tokens."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = formatted.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "attachment_tokens")


PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESC = "replace(replace({0}, '\\', '\\e'), '<', '\\l')"
SQL = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(14 + length(replace({_ESC.format('role')}, '>', '\\g')) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens FROM g"""
