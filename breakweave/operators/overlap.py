"""Interval joins by fixed-width bins.

Spark has no interval join, and a bare range predicate becomes a nested loop. Each interval is dealt to the bins it
touches, bins are equi-joined with the chromosome, and a pair is emitted only from the bin where the later of the two
starts lies, so nothing has to be made distinct. Few intervals on either side make AQE broadcast that side; a crowded
bin is a skewed join key, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def _binned(df: DataFrame, tag: str, chrom: str, start: str, end: str, width: int, closed: bool) -> DataFrame:
    last = F.col(end) if closed else F.greatest(F.col(end) - 1, F.col(start))
    row = F.struct(*[F.col(c) for c in df.columns]).alias(tag)
    key = F.col(chrom).alias("chrom")
    return df.select(row, key, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(last / width).cast("long"))).alias("bin"))


def pairs(
    a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str] = ("chrom", "start", "end"), b_cols: tuple[str, str, str] = ("chrom", "start", "end"), closed: bool = False, width: int = BIN, extra: Column | None = None
) -> DataFrame:
    """(a struct, b struct) of all overlapping intervals; extra is a predicate on `a.x` and `b.x`."""
    one, two = _binned(a, "a", *a_cols, width, closed), _binned(b, "b", *b_cols, width, closed)
    s1, e1, s2, e2 = (F.col(x) for x in (f"a.{a_cols[1]}", f"a.{a_cols[2]}", f"b.{b_cols[1]}", f"b.{b_cols[2]}"))
    meet = (s1 <= e2) & (s2 <= e1) if closed else (s1 < e2) & (s2 < e1)
    once = F.col("bin") == F.floor(F.greatest(s1, s2) / width).cast("long")
    found = one.join(two, ["chrom", "bin"]).where(meet & once)
    return (found if extra is None else found.where(extra)).select("a", "b")


def fraction_of(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Share of the half-open [s1, e1) that [s2, e2) covers."""
    return (F.least(F.col(e1), F.col(e2)) - F.greatest(F.col(s1), F.col(s2))) / (F.col(e1) - F.col(s1))


def hits(a: DataFrame, b: DataFrame, min_fraction: float = 0.0, reciprocal: bool = False, same_strand: bool = False, **where) -> DataFrame:
    """All hits, at least min_fraction of a covered (and of b, if reciprocal); strands equal if asked for."""
    a_cols, b_cols = where.get("a_cols", ("chrom", "start", "end")), where.get("b_cols", ("chrom", "start", "end"))
    s1, e1, s2, e2 = f"a.{a_cols[1]}", f"a.{a_cols[2]}", f"b.{b_cols[1]}", f"b.{b_cols[2]}"
    rule = fraction_of(s1, e1, s2, e2) >= min_fraction
    if reciprocal:
        rule &= fraction_of(s2, e2, s1, e1) >= min_fraction
    if same_strand:
        rule &= F.col("a.strand") == F.col("b.strand")
    return pairs(a, b, extra=rule, **where)


def semi(a: DataFrame, b: DataFrame, key: list[str], anti: bool = False, **where) -> DataFrame:
    """Rows of a with (or without) any hit; key identifies a row of a."""
    found = pairs(a, b, **where).select(*[F.col(f"a.{k}").alias(k) for k in key]).distinct()
    return a.join(found, key, "left_anti" if anti else "left_semi")


def left_hits(a: DataFrame, b: DataFrame, key: list[str], hit: str, **where) -> DataFrame:
    """Every row of a with its sorted hits (column `hit` of b), an empty array if there are none."""
    found = pairs(a, b, **where).groupBy(*[F.col(f"a.{k}").alias(k) for k in key]).agg(F.array_sort(F.collect_list(f"b.{hit}")).alias("hits"))
    return a.join(found, key, "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))


def count_hits(a: DataFrame, b: DataFrame, key: list[str], **where) -> DataFrame:
    """Every row of a with its number of hits."""
    found = pairs(a, b, **where).groupBy(*[F.col(f"a.{k}").alias(k) for k in key]).agg(F.count("*").alias("n_hits"))
    return a.join(found, key, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long"))


def pair_to_pair(calls: DataFrame, truth: DataFrame, key: list[str], slop: int = 3, both: bool = True) -> DataFrame:
    """Calls both of whose ends lie within slop of the ends of one truth row (or, not both, those with no such row)."""
    wide = calls.withColumns({"s1": F.col("start_l") - slop, "e1": F.col("end_l") + slop, "s2": F.col("start_r") - slop, "e2": F.col("end_r") + slop})
    second = (F.col("a.s2") < F.col("b.end_r")) & (F.col("b.start_r") < F.col("a.e2")) & (F.col("a.chrom_r") == F.col("b.chrom_r"))
    found = pairs(wide, truth, ("chrom_l", "s1", "e1"), ("chrom_l", "start_l", "end_l"), extra=second)
    matched = found.select(*[F.col(f"a.{k}").alias(k) for k in key]).distinct()
    return calls.join(matched, key, "left_semi" if both else "left_anti")


def on_genome(offsets: DataFrame, genome: DataFrame, column: str) -> DataFrame:
    """Linear genome offsets as (chrom, pos). The genome has (chrom, length, ordinal): one row for each chromosome."""
    begin = F.sum("length").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    starts = genome.withColumn("begin", F.coalesce(begin, F.lit(0)))
    own = (F.col(column) >= F.col("begin")) & (F.col(column) < F.col("begin") + F.col("length"))
    return offsets.join(F.broadcast(starts), own).withColumn("pos", F.col(column) - F.col("begin")).drop("begin", "length", "ordinal")
