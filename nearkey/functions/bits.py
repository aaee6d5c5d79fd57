"""Position sets as sorted integer arrays: what bitmaps mean, without a bitmap class.

Positions count from 0. Sets of a hub's postings are small next to the postings themselves;
Parquet packs them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<int>)"


def set_one(bits: Column, at: Column) -> Column:
    return F.array_sort(F.array_union(bits, F.array(at)))


def set_zero(bits: Column, at: Column) -> Column:
    return F.array_remove(bits, at)


def set_all(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr(NONE))


def value_at(bits: Column, at: Column) -> Column:
    return F.array_contains(bits, at)


def all_zero(bits: Column) -> Column:
    return F.size(bits) == 0


def has_zero(bits: Column, n: Column) -> Column:
    return F.size(bits) < n


def count_one(bits: Column) -> Column:
    return F.size(bits)


def rank(bits: Column, at: Column) -> Column:
    """Ones before position ``at``."""
    return F.size(F.filter(bits, lambda x: x < at))


def next_one(bits: Column, at: Column) -> Column:
    """The first one at or after ``at``; -1 if there is none."""
    return F.coalesce(F.array_min(F.filter(bits, lambda x: x >= at)), F.lit(-1))


def find_one(bits: Column, i: Column) -> Column:
    """Position of the i-th one, from 1; -1 if there are fewer."""
    return F.coalesce(F.try_element_at(F.array_sort(bits), i), F.lit(-1))


def insert_bit(bits: Column, at: Column, one: bool) -> Column:
    """Later positions move up by one."""
    moved = F.transform(bits, lambda x: F.when(x >= at, x + 1).otherwise(x))
    return set_one(moved, at) if one else moved


def delete_bit(bits: Column, at: Column) -> Column:
    return F.transform(F.array_remove(bits, at), lambda x: F.when(x > at, x - 1).otherwise(x))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def compress(bits: Column, parent: Column) -> Column:
    """Positions of ``bits`` as ranks among the ones of ``parent``."""
    return F.transform(bits, lambda x: rank(parent, x))


def uncompress(ranks: Column, parent: Column) -> Column:
    """The inverse of :func:`compress`."""
    return F.transform(ranks, lambda r: F.element_at(F.array_sort(parent), r + 1))


def show(bits: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.array_contains(bits, i), "1").otherwise("0")), "")
