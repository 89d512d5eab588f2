"""Escape hatches for opaque Python: always explicit, always in Arrow batches where Spark allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(f: Callable[[Any], Any], returns: str) -> Callable[..., Any]:
    """A per-value Python function as an Arrow-transferred column function."""
    return F.udf(f, returns, useArrow=True)


def per_slice(df: DataFrame, slice_col: str, pos_col: str, wanted: Sequence[int], func: Callable[[Iterator[Any]], Any]) -> list[Any]:
    """One result for each wanted slice, in that order."""
    rows = df.where(F.col(slice_col).isin(sorted(set(wanted)))).select(slice_col, pos_col, "value")
    grouped = rows.rdd.map(lambda r: (r[0], (r[1], r[2]))).groupByKey()
    found = dict(grouped.mapValues(lambda vs: func(v for _, v in sorted(vs, key=lambda x: x[0]))).collect())
    return [found[i] if i in found else func(iter(())) for i in wanted]


def _merge(acc: dict, it: Iterator[tuple[Any, Any]], first: Callable, then: Callable) -> dict:
    for k, v in it:
        acc[k] = then(acc[k], v) if k in acc else first(v)
    return acc


def combine_by_key(df: DataFrame, create: Callable, merge_value: Callable, merge_combiners: Callable, combiner_type: str, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Opaque combiners with map-side combine: fold per partition, shuffle the combiners, merge.

    Two Arrow passes around one hash exchange. Each pass holds the keys of its own
    partition, not their values.
    """
    key = df.schema["key"].dataType
    mid = T.StructType([T.StructField("key", key), T.StructField("value", T._parse_datatype_string(combiner_type))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(mid)

    def side(first: Callable, then: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict = {}
            for b in batches:
                _merge(acc, zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), first, then)
            if acc:
                yield pa.RecordBatch.from_arrays([pa.array(list(acc), arrow.field(0).type), pa.array(list(acc.values()), arrow.field(1).type)], schema=arrow)

        return run

    partial = df.select("key", "value").mapInArrow(side(create, merge_value), mid)
    return deal(partial).mapInArrow(side(lambda c: c, merge_combiners), mid)


def gather_by_key(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """(key, values): each partition's values by key, ``rows`` of them at a time, without a shuffle, so
    that what combines them can do so before one. Vectorised: keys are numbered, values taken in
    their order. Keys of nested types aren't gathered: each is a list of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([df.schema["key"], T.StructField("values", T.ArrayType(df.schema["value"].dataType))])
    key, values = to_arrow_schema(kind)
    nested = isinstance(df.schema["key"].dataType, (T.StructType, T.ArrayType, T.MapType))

    def out(t: pa.Table) -> pa.RecordBatch:
        keys, vals = t.column(0).combine_chunks(), t.column(1).combine_chunks()
        codes = np.arange(len(keys)) if nested else keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(order)].astype(np.int32)), vals.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(order[start])).cast(key.type), lists.cast(values.type)], schema=pa.schema([key, values]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield out(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield out(pa.Table.from_batches(held))

    return df.select("key", "value").mapInArrow(run, kind)
