"""Sequence strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def base_count(seq: Column, base: str) -> Column:
    """Of one letter in either case."""
    return (F.length(seq) - F.length(F.translate(seq, base.upper() + base.lower(), ""))).cast("long")


def other_count(seq: Column, bases: str = "ACGT") -> Column:
    return F.length(F.translate(seq, bases.upper() + bases.lower(), "")).cast("long")


def pattern_count(seq: Column, pattern: str) -> Column:
    """Occurrences that may overlap."""
    return F.regexp_count(seq, F.lit(f"(?={pattern})")).cast("long")


def natural_key(text: Column) -> Column:
    """A string by which embedded numbers sort as numbers (up to 12 digits)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")
