"""Combiners for by-key aggregation.

``Algebraic`` combiners are Spark aggregate expressions: partial aggregation
before the shuffle, final after it, spill included. ``Aggregator`` is the
general create / merge_value / merge_combiners triple over Column lambdas.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Callable[[Column], Column]


@dataclass(frozen=True)
class Algebraic:
    """A combiner with native partial aggregation; ``zero`` is the fold's neutral start per value."""

    name: str
    aggregate: Expr
    merge: Callable[[Column, Column], Column]


SUM = Algebraic("sum", F.sum, lambda a, b: a + b)
MIN = Algebraic("min", F.min, lambda a, b: F.least(a, b))
MAX = Algebraic("max", F.max, lambda a, b: F.greatest(a, b))
PRODUCT = Algebraic("product", F.product, lambda a, b: a * b)
ANY = Algebraic("any", F.bool_or, lambda a, b: a | b)
ALL = Algebraic("all", F.bool_and, lambda a, b: a & b)
BY_NAME = {x.name: x for x in (SUM, MIN, MAX, PRODUCT, ANY, ALL)}


@dataclass(frozen=True)
class Aggregator:
    """``create(v) -> c``, ``merge_value(c, v) -> c``, ``merge_combiners(c, c) -> c`` over Columns.

    Each partition folds its values, some ``run`` rows at a time, before the shuffle, so a
    hot key is folded by all tasks and only combiners travel.
    """

    create: Expr
    merge_value: Callable[[Column, Column], Column]
    merge_combiners: Callable[[Column, Column], Column]
    run: int = 1 << 16


def fold_list(values: Column, create: Expr, merge: Callable[[Column, Column], Column]) -> Column:
    """Left fold of a non-empty array column, started with ``create`` of its first element."""
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), create(values[0]), merge)
