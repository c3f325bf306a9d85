"""Pairing of records by name, and routing of records to evidence sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def toggled(df: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """(name, first struct, second struct): odd and even records of a name pair up in order; an odd one out is dropped."""
    rn = F.row_number().over(Window.partitionBy(*name).orderBy(*order)) - 1
    numbered = df.withColumn("__pair", F.floor(rn / 2)).withColumn("__second", rn % 2)
    row = F.struct(*df.columns)
    both = numbered.groupBy(*name, "__pair").agg(F.min(F.when(F.col("__second") == 0, row)).alias("first"), F.min(F.when(F.col("__second") == 1, row)).alias("second"))
    return both.where("second is not null").drop("__pair")


def gated(df: DataFrame, name: list[str], order: list[str], opens: Column) -> DataFrame:
    """Like toggled(), but a record that finds no partner waiting is skipped unless it may open a pair."""
    item = F.struct(*order, opens.alias("__opens"), F.struct(*df.columns).alias("row"))
    rows = df.groupBy(*name).agg(F.array_sort(F.collect_list(item)).alias("items"))
    row_type = df.schema.simpleString()
    empty = f"named_struct('waiting', cast(null as {row_type}), 'pairs', cast(array() as array<struct<first:{row_type},second:{row_type}>>))"
    step = """(a, x) -> case
        when a.waiting is null and not x.__opens then a
        when a.waiting is null then named_struct('waiting', x.row, 'pairs', a.pairs)
        else named_struct('waiting', cast(null as {t}), 'pairs', a.pairs || array(named_struct('first', a.waiting, 'second', x.row))) end""".format(t=row_type)
    return rows.select(*name, F.expr(f"inline(aggregate(items, {empty}, {step}).pairs)"))


def routed(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with the `ev_id` of their (file, group), else of their file alone, else dropped.

    sources has (file, grp, seq, ev_id), a row for each evidence source; of equal keys the later seq counts.
    """
    last = sources.groupBy("file", "grp").agg(F.max_by("ev_id", "seq").alias("ev_id"))
    exact = last.where("grp <> ''").withColumnRenamed("ev_id", "__exact")
    whole = last.where("grp = ''").select("file", F.col("ev_id").alias("__whole"))
    found = records.join(exact, ["file", "grp"], "left").join(whole, "file", "left")
    return found.withColumn("ev_id", F.coalesce("__exact", "__whole")).where("ev_id is not null").drop("__exact", "__whole")


def mates(breakends: DataFrame, id_col: str = "id", mate_col: str = "mate_id") -> tuple[DataFrame, DataFrame]:
    """(pairs first struct and second struct, those without a mate); the smaller id is first."""
    one, two = breakends.select(F.struct("*").alias("first")), breakends.select(F.struct("*").alias("second"))
    stitched = one.join(two, (F.col(f"first.{mate_col}") == F.col(f"second.{id_col}")) & (F.col(f"second.{mate_col}") == F.col(f"first.{id_col}")))
    alone = breakends.join(breakends.select(F.col(id_col).alias(mate_col), F.col(mate_col).alias(id_col)), [id_col, mate_col], "left_anti")
    return stitched.where(F.col(f"first.{id_col}") < F.col(f"second.{id_col}")), alone
