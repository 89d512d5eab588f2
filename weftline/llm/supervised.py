"""What the three classifiers share: folds by crc32, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def thin(rows: DataFrame, label: str, per_class: int, seed: int = 11) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each value of ``label`` (all, if there are fewer), chosen by a hash
    of doc_id alone, and the number of rows of each value. Values are classes: few of them."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts.items():
        keep = F.when(F.col(label) == value, u < min(1.0, per_class / n)).otherwise(keep)
    return rows.where(keep), counts


def one_text_each(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of rows that repeat a key one stays, by a hash of the text: (key, text and the other columns).
    Partial aggregation leaves one row for each key and task before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, parts: int, part: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of rows (doc_id, text, y), held-out ones left out, and the number of labelled
    rows of each class it stands for. Texts are whole.

    Rows whose label is null don't count; a doc_id labelled twice takes the larger label; of
    documents that share an id one is read. The ids are chosen from the labels first, so only
    that bounded set is broadcast to the texts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part) & F.col("doc_id").isNotNull())
    chosen, counts = thin(known.groupBy("doc_id").agg(F.max("y").alias("y")), "y", per_class)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return one_text_each(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")), counts


def prior_shift(counts: dict[int, int], y: np.ndarray) -> float:
    """What to add to a logit learnt on the sample to stand for all labelled rows."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    return float(np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(n1 / n0))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
