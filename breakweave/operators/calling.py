"""Roll-ups of clustered evidence into calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.functions.calls import length, reported_type

TYPES = ["PE", "SR", "BD"]


def support(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, SU, PE, SR, BD): rows of evidence in all and of each type; every row counts once whatever its weight."""
    counts = [F.count_if(F.col("ev_type") == t).alias(t) for t in TYPES]
    return members.groupBy(*keys, "sample").agg(F.count("*").alias("SU"), *counts)


def passing(members: DataFrame, keys: list[str], min_weight: int = 0, min_sample_weight: int = 0, weight: str | None = None) -> DataFrame:
    """Clusters with enough weight in all and enough rows in some one sample."""
    w = F.count("*") if weight is None else F.sum(weight)
    per_sample = members.groupBy(*keys, "sample").agg(F.count("*").alias("rows"), w.alias("w"))
    whole = per_sample.groupBy(*keys).agg(F.sum("w").alias("weight"), F.max("rows").alias("max_sample"))
    return whole.where((F.col("weight") >= min_weight) & (F.col("max_sample") >= min_sample_weight))


def strand_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, strands): `++:n,--:m` in the order of the strand pairs."""
    per = members.groupBy(*keys, F.concat("strand_l", "strand_r").alias("s")).agg(F.count("*").alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat("s", F.lit(":"), F.col("n").cast("string")))), ",")
    return per.groupBy(*keys).agg(text.alias("strands"))


def evidence_ids(members: DataFrame, keys: list[str], ev_id: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.array_sort(F.collect_set(ev_id)).alias("ev_ids"))


def typed(calls: DataFrame) -> DataFrame:
    """calls (chrom_l, pos_l, chrom_r, pos_r, sv_type, strands) with `reported` and `sv_len`."""
    kind = reported_type(F.col("chrom_l"), F.col("chrom_r"), F.col("sv_type"), F.col("strands").contains("++"), F.col("strands").contains("--"))
    found = calls.withColumn("reported", kind)
    return found.withColumn("sv_len", length(F.col("reported"), F.col("pos_l"), F.col("pos_r")))


def numbered(calls: DataFrame, order: list[str], chrom: str = "chrom_l") -> DataFrame:
    """calls with consecutive ids from 1 in canonical order: numbered within chromosomes, then moved by those before."""
    own = F.row_number().over(Window.partitionBy(chrom).orderBy(*order))
    counts = calls.groupBy(chrom).agg(F.count("*").alias("__n"))
    # a row for each chromosome
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return calls.withColumn("__own", own).join(F.broadcast(before), chrom).withColumn("call_id", F.col("__own") + F.col("__before")).drop("__own", "__before")
