"""Containment in integer intervals as equality: aligned cells of power-of-sixteen width.

An interval is a few cells of levels 0, 4, 8, .. (a cell of level l is 2**l wide); a number is in one cell a level. So "number in
interval" is an equi-join on (level, cell) that meets each pair once, and no hot key is filtered pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 4
LEVELS = tuple(range(0, 32, STEP))


def _cells(level: int, begin: Column, end: Column) -> Column:
    """The cells ``begin .. end - 1`` of a level; none where that is empty."""
    cell = lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))
    return F.when(begin < end, F.transform(F.sequence(begin, end - 1), cell)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def interval_cells(low: Column, high: Column) -> Column:
    """The fewest disjoint cells that make up ``low .. high``, 0 <= both < 2**32: at most 30 a level."""
    low, end = low.cast("long"), high.cast("long") + 1
    parts = []
    for level in LEVELS:
        # whole cells of this level inside the interval, without those that are in whole cells of the next
        begin, stop = F.shiftright(low + ((1 << level) - 1), level), F.shiftright(end, level)
        if level == LEVELS[-1]:
            parts.append(_cells(level, begin, stop))
            continue
        above = level + STEP
        begin_up, stop_up = F.shiftright(low + ((1 << above) - 1), above), F.shiftright(end, above)
        some = begin_up < stop_up
        parts += [_cells(level, begin, F.when(some, F.shiftleft(begin_up, STEP)).otherwise(stop)), _cells(level, F.shiftleft(stop_up, STEP), F.when(some, stop).otherwise(F.shiftleft(stop_up, STEP)))]
    return F.concat(*parts)


def number_cells(number: Column) -> Column:
    """The cell of every level that a number is in."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(number.cast("long"), level).alias("cell")) for level in LEVELS])
