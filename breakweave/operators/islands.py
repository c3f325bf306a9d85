"""Islands, coverage and depth by running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island(df: DataFrame, keys: list[str], start: str, end: str, name: str, gap: int = 0, touching: bool = True) -> DataFrame:
    """df with an island number within keys: a new island begins past the running end by more than gap (or at it, not touching)."""
    ordered = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1)) + gap
    opens = F.col(start) > reach if touching else F.col(start) >= reach
    # intervals that sort alike are peers of the running sum and share an island, whichever of them opened it
    marked = df.withColumn("__opens", F.when(reach.isNull() | opens, 1).otherwise(0))
    return marked.withColumn(name, F.sum("__opens").over(ordered).cast("long")).drop("__opens")


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, touching: bool = True) -> DataFrame:
    """The hulls of islands and how many intervals each has."""
    found = island(df, keys, start, end, "__island", gap, touching)
    return found.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def two_level(df: DataFrame, keys: list[str], left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """df with `island_l`, islands of the left intervals, and `island_r`, islands of the right ones within each."""
    return island(island(df, keys, *left, "island_l"), [*keys, "island_l"], *right, "island_r")


def coverage_runs(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, depth) of every run with depth over 0, of half-open intervals. Events are summed before they are ordered."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    ordered = Window.partitionBy(*keys).orderBy("pos")
    depth = F.sum("d").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    runs = steps.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(ordered).alias("end"), depth.alias("depth"))
    return runs.where("depth > 0 and end is not null")


def depth(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, pos, depth) of every covered base."""
    bases = df.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("pos"))
    return bases.groupBy(*keys, "pos").agg(F.count("*").alias("depth"))


def coverage_summary(runs: DataFrame) -> DataFrame:
    """min, max and length-weighted mean depth over runs with depth over 0."""
    size = F.col("end") - F.col("start")
    return runs.where("depth > 0").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), (F.sum(F.col("depth") * size) / F.sum(size)).alias("mean_depth"))


def too_deep(runs: DataFrame, keys: list[str], limit: int, gap: int = 50) -> DataFrame:
    """Regions deeper than limit, merged over gaps."""
    return merged(runs.where(F.col("depth") > limit), keys, gap=gap)
