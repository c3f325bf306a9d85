"""Interval arithmetic."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift of the finest bins and by how much each coarser level shifts on.
FINEST, COARSER, LEVELS = 14, 3, 7


def overlap_closed(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2) + 1


def overlap_half_open(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def intersects(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict: sharing a single end base is no intersection."""
    return (s1 < e2) & (e1 > s2)


def level_offset(level: int) -> int:
    """First bin number of a level, 0 being the finest."""
    return sum(8**k for k in range(LEVELS - 1 - level))


def bin_number(start: Column, end: Column) -> Column:
    """The smallest bin of the hierarchy that holds the half-open interval."""
    found = F.lit(0).cast("long")
    for level in reversed(range(LEVELS)):
        shift = FINEST + COARSER * level
        first, last = F.shiftright(start, shift), F.shiftright(end - 1, shift)
        found = F.when(first == last, first + level_offset(level)).otherwise(found)
    return found


def ordinal(chrom: Column, order: list[str]) -> Column:
    return reduce(lambda c, k: c.when(chrom == order[k], k), range(1, len(order)), F.when(chrom == order[0], 0))
