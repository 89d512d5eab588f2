"""Line and token rules. Splits keep empty tokens: leading, inner and trailing ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "[ \\t\\n\\x0B\\f\\r]"


def lines(text: Column) -> Column:
    """Cut at line feeds only; a carriage return stays."""
    return F.split(text, "\n")


def space_tokens(text: Column) -> Column:
    return F.split(text, " ")


def whitespace_tokens(text: Column) -> Column:
    """Cut at each single white-space character."""
    return F.split(text, WHITESPACE)


def line_tokens(text: Column) -> Column:
    """``lines`` and ``space_tokens`` of each in one pass: a line feed ends a token as a space does."""
    return F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
