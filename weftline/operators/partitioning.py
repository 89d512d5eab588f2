"""Slice layout and visible hash buckets, as column expressions.

``n`` slices over ``size`` elements: with ``q = size div n``, slice ``i`` holds
positions ``i*q .. (i+1)*q - 1``; leftover element ``r`` (position ``n*q + r``)
is appended to slice ``r``. Slices may be empty when ``n > size``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_slices(n: int) -> int:
    if n < 1:
        raise ValueError(f"the number of slices must be at least 1, not {n}")
    return n


def slice_id(position: Column, size: int, n: int) -> Column:
    """Slice of a dense position in 0..size-1."""
    q = size // check_slices(n)
    leftover = position - F.lit(n * q)
    if q == 0:  # every element is left over; a division by q must not appear
        return leftover.cast("int")
    return F.when(position < n * q, F.floor(position / q)).otherwise(leftover).cast("int")


def slice_positions(i: int, size: int, n: int) -> list[int]:
    """Positions of slice ``i`` in order; the plain model of ``slice_id``."""
    q = size // check_slices(n)
    own = list(range(i * q, (i + 1) * q))
    return own + ([n * q + i] if n * q + i < size else [])


class Partitioner:
    """Says how many reduce partitions there are, and which one a key belongs to (``partition_of``, an
    int column from 0). Equal partitioners deal equal keys alike."""

    def __init__(self, num_partitions: int):
        self.num_partitions = check_slices(num_partitions)

    def partition_of(self, key: Column) -> Column:
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash((type(self), self.num_partitions))


class HashPartitioner(Partitioner):
    """By the key's own value where it is a whole number (non-negative remainder), else by its hash."""

    def __init__(self, num_partitions: int, integral: bool = False):
        super().__init__(num_partitions)
        self.integral = integral

    def partition_of(self, key: Column) -> Column:
        return F.coalesce(F.pmod(key if self.integral else F.xxhash64(key), F.lit(self.num_partitions)).cast("int"), F.lit(0))


def bucket(key: Column, n: int) -> Column:
    """Visible reduce bucket of a non-negative integer key."""
    check_slices(n)
    return F.pmod(key, F.lit(n)).cast("int")
