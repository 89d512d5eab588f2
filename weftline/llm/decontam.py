"""Benchmark decontamination by templates, in DataFrame functions only.

Texts become words without punctuation; numbers and the units after them become typed
placeholders (plain template), and in a second template all capitalised words do as well
(loose), as a name may stand anywhere, also where a sentence begins. Windows of five
template words of the benchmark are hash-joined with those of the documents, and only the
windows that met look at what stood in their placeholders. That has to be consistent: along
one alignment of item and document, each value of the item stands for one value of the
document, the most frequent one; windows at odds with it don't count. So a question with
other numbers and names is found, and windows that only look alike don't count.

A window of fewer than ``LITERALS`` words that aren't placeholders would match too much (a
table of numbers, a title); it is compared by its words as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Tables

WORDS, LEAST = 5, 0.8
#: Benchmark windows of up to so many bytes (counted first) are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Words of a window that aren't placeholders, at least.
LITERALS = 2
UNITS = "mm|cm|m|km|in|inch|inches|ft|foot|feet|yard|yards|mile|miles|mg|g|kg|gram|grams|lb|lbs|oz|ton|tons|ml|l|liter|liters|litre|litres|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|usd|eur|percent|degree|degrees|mph|kmh|kb|mb|gb|tb|w|kw|v|hz|khz|mhz|ghz"
#: Placeholders: characters that no word holds.
NUM, UNIT, NAME = "#", "%", "@"
_JOINER = "§"  # stands between the digits of one number
#: What stands between words: ASCII and Latin-1 signs, listed one by one (a table look-up for the regex
#: engine, where a property like "letter" takes eight times as long), and the punctuation blocks.
_SIGNS = "".join(f"\\x{i:02x}" for i in range(256) if not chr(i).isalnum() and chr(i) != _JOINER)
_BETWEEN = f"[{_SIGNS}\\x{{2000}}-\\x{{206f}}\\x{{3000}}-\\x{{303f}}]+"


def _spaced_numbers(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, "([0-9])[.,](?=[0-9])", f"$1{_JOINER}"), f"([0-9{_JOINER}]+)", " $1 ")


def _template(words: Column) -> Column:
    """Placeholders for numbers and units; the number of words stays."""
    return F.regexp_replace(F.regexp_replace(words, f"[0-9{_JOINER}]+", NUM), f"({NUM} )(?i:{UNITS})( |$)", f"$1{UNIT}$2")


def templates(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and two aligned arrays of words, in the letters' case: raw, and plain with placeholders
    for numbers and units; digits: whether they may differ. A text without a word is one empty word."""
    t = rows.select(*keys, F.col("text").cast("string").alias("t")).withColumn("digits", F.col("t").rlike("[0-9]"))
    t = t.select(*keys, "digits", F.when(F.col("digits"), _spaced_numbers(F.col("t"))).otherwise(F.col("t")).alias("t"))
    t = t.select(*keys, "digits", F.trim(F.regexp_replace("t", _BETWEEN, " ")).alias("w"))
    t = t.select(*keys, "digits", F.split("w", " ").alias("raw"), "w")
    return t.select(*keys, "digits", "raw", F.when(F.col("digits"), F.split(_template(F.col("w")), " ")).otherwise(F.col("raw")).alias("plain"))


def _is_name(w: Column) -> Column:
    """A word with capital and small letters."""
    return (F.lower(w) != w) & (F.upper(w) != w)


def _is_slot(w: Column) -> Column:
    return w.isin(NUM, UNIT, NAME)


_EVEN = -2  # all bits but the lowest


def _hash(w: Column) -> Column:
    """A word's hash without regard to case; odd for names."""
    return F.when(F.lower(w) == w, F.xxhash64(w).bitwiseAND(_EVEN)).otherwise(F.xxhash64(F.lower(w)).bitwiseAND(_EVEN).bitwiseOR(F.when(F.upper(w) != w, 1).otherwise(0)))


def windows(words: DataFrame, *keys: str) -> DataFrame:
    """One row for each window and template: ``keys``, pos, h (hash of the template), hl (of the loose
    one, if there is any), and the columns of ``templates``. A shorter text is one window.

    A loose window stands beside the plain one where it has a name in it and words enough.
    Words are hashed once each, windows from the hashes.
    """
    rows = words.withColumn("ph", F.transform("plain", _hash))
    rows = rows.withColumn("rh", F.when(F.col("digits"), F.transform("raw", _hash)).otherwise(F.col("ph")))
    # a filter on empty texts would be pushed below the templates and make them twice
    at = F.when(F.get("raw", F.lit(0)) != "", F.sequence(F.lit(0), F.greatest(F.size("plain") - WORDS, F.lit(0))))
    rows = rows.withColumn("pos", F.explode(at))
    rows = rows.selectExpr("*", *[f"get(ph, pos + {k}) AS v{k}" for k in range(WORDS)])
    each = lambda form, by: by.join(form.format(v=f"v{k}") for k in range(WORDS))
    odd, number = "coalesce({v} & 1 = 1, false)", f"({{v}} = (xxhash64('{NUM}') & {_EVEN}) OR {{v}} = (xxhash64('{UNIT}') & {_EVEN}))"
    few = lambda slot: "(" + each(f"if({{v}} IS NULL OR {slot}, 0, 1)", " + ") + f") < {LITERALS}"
    plain = f"xxhash64({each(f'{{v}} & {_EVEN}', ', ')})"
    exact = "xxhash64(" + ", ".join(f"get(rh, pos + {k}) & {_EVEN}" for k in range(WORDS)) + ")"
    loose = "xxhash64(" + each(f"if({odd}, xxhash64('{NAME}') & {_EVEN}, {{v}})", ", ") + ")"
    rows = rows.selectExpr("*", f"if(digits AND {few(number)}, {exact}, {plain}) AS hp", f"if(({each(odd, ' OR ')}) AND NOT {few(f'({odd} OR {number})')}, {loose}, NULL) AS hl")
    both = F.expr("if(hl IS NULL, array(hp), array(hp, hl))")
    return rows.select(*keys, "pos", "raw", "plain", "hl", F.explode(both).alias("h"))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_pos, h, loose and a0 to a4 (what stood in each placeholder, null elsewhere) of the
    benchmark. Windows of few words but placeholders are left out where an item has others."""
    w = windows(templates(items, "item_id"), "item_id").withColumn("loose", F.coalesce(F.col("h") == F.col("hl"), F.lit(False)))
    own = lambda k: F.get("plain", F.col("pos") + k)
    count = lambda slot: F.size(F.filter(F.array(*[own(k) for k in range(WORDS)]), lambda x: x.isNotNull() & ~slot(x)))
    w = w.withColumn("telling", count(lambda x: _is_slot(x) | _is_name(x)) >= LITERALS).withColumn("exact", ~F.col("loose") & (count(_is_slot) < LITERALS))
    shown = lambda k: ~F.col("exact") & (_is_slot(own(k)) | (F.col("loose") & _is_name(own(k))))
    slots = [F.when(shown(k), F.lower(F.get("raw", F.col("pos") + k))).alias(f"a{k}") for k in range(WORDS)]
    w = w.select("item_id", F.col("pos").alias("item_pos"), "h", "loose", "telling", *slots).distinct()
    any_ = w.groupBy("item_id").agg(F.max("telling").alias("any"))
    kept = w.alias("w").join(any_.alias("a"), F.col("w.item_id").eqNullSafe(F.col("a.item_id"))).where("telling or not any")
    return kept.select("w.item_id", "item_pos", "h", "loose", *[f"a{k}" for k in range(WORDS)])


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is its id and its text: rows that share an id are told apart by a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))


def found(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``leaks`` with th, the hash of the text."""
    tables = Tables(docs.sparkSession, "decontam")
    theirs = tables.write(item_windows(benchmark.select(F.col("item_id").cast("long"), "text")), "windows")
    sizes = theirs.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_windows"))
    at = range(WORDS)
    size = F.expr(" + ".join(["100"] + [f"coalesce(octet_length(a{k}) + 24, 0)" for k in at]))
    small = (theirs.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    # a window carries its own five words, never its text
    mine = windows(templates(_keyed(docs), "doc_id", "th"), "doc_id", "th").selectExpr("doc_id", "th", "pos", "h", *[f"get(raw, pos + {k}) AS r{k}" for k in at])
    met = mine.join(F.broadcast(theirs) if small else theirs, "h")
    met = tables.write(met.selectExpr("doc_id", "th", "item_id", "item_pos", "pos - item_pos AS shift", "loose", *[f"a{k}" for k in at], *[f"if(a{k} IS NULL, NULL, lower(r{k})) AS b{k}" for k in at]), "matches")
    along = ["doc_id", "th", "item_id", "shift"]
    slotless = " AND ".join(f"a{k} IS NULL" for k in at)
    pairs = ", ".join(f"struct(item_pos + {k} AS at, a{k} AS a, b{k} AS b)" for k in at)
    slotted = met.where(f"NOT ({slotless})").selectExpr(*along, "item_pos", "loose", f"inline(array({pairs}))").where("a IS NOT NULL")
    votes = slotted.select(*along, "at", "a", "b").distinct().groupBy(*along, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*along, "a").agg(F.max(F.struct("n", "b"))["b"].alias("best"))
    x, y = slotted.alias("x"), best.alias("y")
    judged = x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*along, "a"]]).select("x.*", "best")
    sound = judged.groupBy(*along, "item_pos", "loose").agg(F.min(F.col("b") == F.col("best")).alias("ok"), F.max(F.col("a") != F.col("b")).alias("changed")).where("ok")
    keys = ["doc_id", "th", "item_id"]
    plain = met.where(slotless).select(*keys, "item_pos", F.lit(False).alias("changed"))
    total = plain.unionByName(sound.select(*keys, "item_pos", "changed")).groupBy(*keys, "item_pos").agg(F.max("changed").alias("changed"))
    total = total.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"), F.max("changed").alias("changed"))
    sizes = sizes.withColumnRenamed("item_id", "_item")
    joined = total.join(F.broadcast(sizes) if small else sizes, F.col("item_id").eqNullSafe(F.col("_item")))
    out = joined.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return out.where(F.col("coverage") >= least).select(*keys, "n_windows", "n_matched", "coverage", "changed")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, n_windows (of the item),
    n_matched (found consistently), coverage and changed (a placeholder held another value).

    A pair is reported at a coverage of at least ``least``. Null texts and texts without words
    match nothing; an item of fewer than five words is matched by documents that are equal to
    it as a whole. Rows that repeat a doc_id are judged each by its own text (equal rows give
    one result); rows that repeat an item_id count together; null ids are reported as null.
    Other columns aren't read. Either table may be empty.
    """
    return found(docs, benchmark, least).drop("th")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with all its columns, without the rows whose text holds a benchmark item, whatever their id."""
    bad = found(docs, benchmark, least).select("doc_id", "th").distinct()
    d, b = docs.alias("d"), bad.alias("b")
    return d.join(b, F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("b.th")), "left_anti")


# -- the same in SQL


def _sql(table: str, keys: str) -> str:
    num = "regexp_replace({0}, '([0-9])[.,]([0-9])', '\\1§\\2', 'g')"
    tpl = f"regexp_replace(regexp_replace(w, '[0-9{_JOINER}]+', '{NUM}', 'g'), '({NUM} )(?i:{UNITS})( |$)', '\\1{UNIT}\\2', 'g')"
    n = f"len(list_filter({{0}}, lambda x: x NOT IN ('{NUM}', '{UNIT}', '{NAME}')))"
    return f"""(SELECT DISTINCT {keys}, pos, loose, telling, CASE WHEN loose THEN l WHEN few THEN r ELSE p END AS w,
      CASE WHEN few AND NOT loose THEN [] ELSE list_filter(list_transform(range(0, {WORDS}), lambda k: CASE WHEN (CASE WHEN loose THEN l ELSE p END)[1 + k] IN ('{NUM}', '{UNIT}', '{NAME}') THEN {{'k': k, 'v': r[1 + k]}} END), lambda x: x IS NOT NULL) END AS slots
      FROM (SELECT *, {n.format('p')} < {LITERALS} AS few, {n.format('l')} >= {LITERALS} AS telling
        FROM (SELECT {keys}, pos, r[pos + 1 : pos + {WORDS}] AS r, p[pos + 1 : pos + {WORDS}] AS p, l[pos + 1 : pos + {WORDS}] AS l
          FROM (SELECT {keys}, r, p, l, unnest(range(0, greatest(len(p) - {WORDS}, 0) + 1)) AS pos
            FROM (SELECT {keys}, string_split(lower(w), ' ') AS r, string_split(lower(c), ' ') AS p, list_transform(string_split(c, ' '), lambda x: CASE WHEN lower(x) <> x AND upper(x) <> x THEN '{NAME}' ELSE lower(x) END) AS l
              FROM (SELECT {keys}, w, {tpl} AS c
                FROM (SELECT {keys}, trim(regexp_replace(regexp_replace({num.format(num.format('text'))}, '([0-9{_JOINER}]+)', ' \\1 ', 'g'), '{_BETWEEN}', ' ', 'g')) AS w FROM {table} WHERE text IS NOT NULL)
                WHERE w <> ''))))), (SELECT unnest([false, true]) AS loose)
      WHERE NOT loose OR (telling AND list_contains(l, '{NAME}')))"""


SQL = f"""WITH d AS {_sql('(SELECT DISTINCT doc_id, text, md5(text) AS th FROM documents)', 'doc_id, th')},
i AS {_sql('benchmark', 'item_id')},
b AS (SELECT i.* FROM i JOIN (SELECT item_id, bool_or(telling) AS any_ FROM i GROUP BY 1) a ON i.item_id IS NOT DISTINCT FROM a.item_id WHERE telling OR NOT any_),
m AS (SELECT d.doc_id, d.th, b.item_id, b.pos AS item_pos, d.pos - b.pos AS shift, b.loose, b.slots AS bs, d.slots AS ds FROM d JOIN b USING (w)),
n AS (SELECT item_id, count(DISTINCT pos) AS n_windows FROM b GROUP BY 1),
p AS (SELECT doc_id, th, item_id, item_pos, shift, loose, item_pos + bs[j].k AS slot, bs[j].v AS a, ds[j].v AS b
  FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS j FROM m WHERE len(bs) > 0)),
v AS (SELECT doc_id, th, item_id, shift, a, max({{'n': n, 'b': b}}).b AS best FROM (
  SELECT doc_id, th, item_id, shift, a, b, count(DISTINCT slot) AS n FROM p GROUP BY ALL) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT p.doc_id, p.th, p.item_id, p.item_pos, p.shift, p.loose, bool_and(b = best) AS ok, bool_or(p.a <> b) AS changed
  FROM p JOIN v ON p.doc_id IS NOT DISTINCT FROM v.doc_id AND p.th = v.th AND p.item_id IS NOT DISTINCT FROM v.item_id AND p.shift = v.shift AND p.a = v.a GROUP BY ALL),
f AS (SELECT doc_id, th, item_id, item_pos, false AS changed FROM m WHERE len(bs) = 0
  UNION ALL SELECT doc_id, th, item_id, item_pos, changed FROM s WHERE ok)
SELECT doc_id, c.item_id, n_windows, n_matched, n_matched / n_windows AS coverage, changed FROM (
  SELECT doc_id, th, item_id, count(DISTINCT item_pos) AS n_matched, bool_or(changed) AS changed FROM f GROUP BY 1, 2, 3) c JOIN n ON c.item_id IS NOT DISTINCT FROM n.item_id
WHERE n_matched / n_windows >= {LEAST}"""
