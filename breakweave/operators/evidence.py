"""Evidence as pairs of intervals: sanity, aberrance and the geometry of pairs, splits and given intervals.

Coordinates are closed and 0-based. An evidence row has chrom, start, end, strand of either side (suffixes _l and _r);
to_intervals() functions add begin, finish and clip of either side: the breakpoint interval, and how many of its first
positions the curve has lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.functions.calls import pair_type, split_type
from breakweave.operators.overlap import semi


@dataclass(frozen=True)
class PairSource:
    """Paired reads of one library: insert sizes, how far back a break can lie, and the length of the curve."""

    mean: float
    stdev: float
    z: float
    back: int
    reach: int
    min_mapq: int = 0
    weight: int = 1


@dataclass(frozen=True)
class SplitSource:
    back: int
    min_mapq: int = 0
    min_clip: int = 20
    weight: int = 1


@dataclass(frozen=True)
class IntervalSource:
    weight: int = 1


def sane_pairs(df: DataFrame, source: PairSource) -> DataFrame:
    """Enough mapping quality, reads that have length and do not overlap (coordinates are compared across chromosomes too)."""
    apart = F.least("end_l", "end_r") - F.greatest("start_l", "start_r") <= 0
    return df.where((F.col("mapq") >= source.min_mapq) & (F.col("end_l") > F.col("start_l")) & (F.col("end_r") > F.col("start_r")) & apart)


def aberrant_pairs(df: DataFrame, source: PairSource) -> DataFrame:
    """Same strands, left on the reverse strand, or an outer span z deviations off the mean."""
    span = F.col("end_r") - F.col("start_l")
    odd = (F.col("strand_l") == F.col("strand_r")) | (F.col("strand_l") == "-")
    return df.where(odd | (span >= source.mean + source.z * source.stdev) | (span <= source.mean - source.z * source.stdev))


def outside(df: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Rows neither of whose reads touches a region (half-open, met as closed)."""
    for side in "lr":
        df = semi(df, regions, key, anti=True, a_cols=(f"chrom_{side}", f"start_{side}", f"end_{side}"), closed=True)
    return df


def sane_splits(df: DataFrame, source: SplitSource) -> DataFrame:
    distinct = (F.col("strand_l") != F.col("strand_r")) | (F.col("query_l") != F.col("query_r"))
    apart = (F.col("chrom_l") != F.col("chrom_r")) | (F.col("end_l") < F.col("start_r"))
    return df.where((F.col("mapq") >= source.min_mapq) & distinct & apart)


def bounded(df: DataFrame) -> DataFrame:
    """On one chromosome the left interval ends before the right read and the right one starts behind the left read."""
    same = F.col("chrom_l") == F.col("chrom_r")
    cut = F.when(same, F.greatest(F.lit(0), F.col("end_l") + 1 - F.col("begin_r"))).otherwise(0)
    return df.withColumns(
        {"finish_l": F.when(same, F.least("finish_l", F.col("start_r") - 1)).otherwise(F.col("finish_l")), "begin_r": (F.col("begin_r") + cut).cast("long"), "clip_r": (F.col("clip_r") + cut).cast("long")}
    )


def pair_intervals(df: DataFrame, source: PairSource) -> DataFrame:
    columns = {"sv_type": pair_type(F.col("strand_l"), F.col("strand_r"))}
    for side in "lr":
        first = F.when(F.col(f"strand_{side}") == "+", F.col(f"end_{side}") - source.back).otherwise(F.col(f"start_{side}") + source.back - source.reach + 1)
        columns |= {f"begin_{side}": F.greatest(first, F.lit(0)).cast("long"), f"finish_{side}": (first + source.reach - 1).cast("long"), f"clip_{side}": F.greatest(-first, F.lit(0)).cast("long")}
    return bounded(df.withColumns(columns))


def split_intervals(df: DataFrame, source: SplitSource) -> DataFrame:
    """Anchors by type and query order; rows whose type cannot be told are dropped. Strands become those of the break."""
    typed = df.withColumn("sv_type", split_type(F.col("strand_l"), F.col("strand_r"), F.col("query_l"), F.col("query_r"))).where("sv_type is not null and (sv_type <> 'INV' or query_l <> query_r)")
    inward = ((F.col("query_l") < F.col("query_r")) & (F.col("strand_l") == "-")) | ((F.col("query_l") > F.col("query_r")) & (F.col("strand_l") == "+"))
    kind = F.col("sv_type")
    at_start_l = (kind == "DUP") | ((kind == "INV") & inward)
    at_start_r = (kind == "DEL") | ((kind == "INV") & inward)
    columns = {"strand_l": F.when(at_start_l, "-").otherwise("+"), "strand_r": F.when(at_start_r, "-").otherwise("+")}
    for side, at_start in (("l", at_start_l), ("r", at_start_r)):
        first = F.when(at_start, F.col(f"start_{side}")).otherwise(F.col(f"end_{side}")) - source.back
        columns |= {f"begin_{side}": F.greatest(first, F.lit(0)).cast("long"), f"finish_{side}": (first + 2 * source.back).cast("long"), f"clip_{side}": F.greatest(-first, F.lit(0)).cast("long")}
    return bounded(typed.withColumns(columns))


def given_intervals(df: DataFrame) -> DataFrame:
    """The intervals themselves; the lower chromosome is left."""
    return df.withColumns({f"{new}_{s}": F.col(f"{old}_{s}") for s in "lr" for new, old in (("begin", "start"), ("finish", "end"))} | {f"clip_{s}": F.lit(0).cast("long") for s in "lr"})
