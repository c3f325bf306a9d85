"""Derived views over the test tables, as column expressions that Spark and DuckDB both read.

`{div}` is integer division and `{text}` the string type of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = {
    "k1": "l_orderkey", "k2": "cast(l_linenumber as bigint)", "k3": "l_partkey", "k4": "l_suppkey", "k5": "cast(round(l_extendedprice * 100) as bigint)",
    "chrom_l": "cast(l_partkey % 5 as bigint)",
    "chrom_r": "cast(l_partkey % 5 + case when l_partkey % 11 = 0 then 1 else 0 end as bigint)",
    "strand_l": "case when l_returnflag = 'R' then '-' else '+' end",
    "strand_r": "case when l_linestatus = 'O' then '-' else '+' end",
    "start_l": "cast((l_partkey {div} 5) * 20000 + 9900 - cast(l_quantity as bigint) * 3 as bigint)",
    "end_l": "cast((l_partkey {div} 5) * 20000 + 10000 - cast(l_quantity as bigint) * 3 as bigint)",
    "start_r": "cast((l_partkey {div} 5) * 20000 + 11000 + (l_partkey % 7) * 500 + (l_suppkey % 50) * 2 as bigint)",
    "end_r": "cast((l_partkey {div} 5) * 20000 + 11100 + (l_partkey % 7) * 500 + (l_suppkey % 50) * 2 as bigint)",
    "mapq": "cast(60 - cast(round(l_discount * 100) as bigint) * 5 as bigint)",
    "sample": "concat('S', cast(l_suppkey % 3 as {text}))",
    "ev_type": "case when l_linenumber <= 4 then 'PE' when l_linenumber <= 6 then 'SR' else 'BD' end",
    "query_l": "cast(l_quantity as bigint) % 40",
    "query_r": "cast(l_linenumber * 7 % 40 as bigint)",
}

INTERVALS_A = {
    "id": "o_orderkey", "chrom": "o_custkey % 20", "start": "o_orderkey * 37 % 1000000", "end": "o_orderkey * 37 % 1000000 + 100 + o_custkey % 400", "strand": "case when o_orderstatus = 'F' then '-' else '+' end",
}
INTERVALS_B = {
    "pid": "p_partkey", "chrom": "p_partkey % 20", "start": "p_partkey * 4099 % 1000000", "end": "cast(p_partkey * 4099 % 1000000 + 50 + p_size * 20 as bigint)", "strand": "case when p_size % 2 = 0 then '-' else '+' end",
}
SEGMENTS = {"pid": "p_partkey", "chrom": "p_partkey % 20", "start": "p_partkey * 4099 % 1000000", "end": "cast(p_partkey * 4099 % 1000000 + 50 + p_size * 20 as bigint)", "log2": "cast((p_size - 25) / 20.0 as double)"}
CIGARS = {
    **{k: EVIDENCE[k] for k in ("k1", "k2", "k3", "k4", "k5")},
    "pos": "l_partkey * 100",
    "flag": "cast(1 + case when l_returnflag = 'R' then 16 else 0 end + case when l_linestatus = 'O' then 2 else 0 end + case when l_linenumber % 2 = 0 then 64 else 128 end + case when l_quantity > 48 then 1024 else 0 end + case when l_quantity < 3 then 4 else 0 end as bigint)",
    "cigar": "concat(cast(cast(l_quantity as bigint) % 40 + 1 as {text}), 'S', cast(60 + l_linenumber as {text}), 'M', case when l_returnflag = 'A' then '3I10M' when l_returnflag = 'R' then '5D12M' else '' end, case when l_linestatus = 'F' then '7H' else '' end)",
    "sa": "concat('chr', cast(l_partkey % 5 as {text}), ',', cast(l_partkey * 100 + 500 + l_suppkey % 50 as {text}), ',', case when l_suppkey % 3 = 0 then '-' else '+' end, ',', cast(60 + l_linenumber as {text}), 'S', cast(cast(l_quantity as bigint) % 40 + 25 as {text}), 'M,60,0;', case when l_suppkey % 7 = 0 then 'chr1,5,+,10M,60,0;' else '' end)",
    "rname": "concat('chr', cast(l_partkey % 5 as {text}))",
    "isize": "cast(l_partkey % 701 as bigint)",
}
SPARK, DUCK = {"div": "div", "text": "string"}, {"div": "//", "text": "varchar"}
SOURCES = {"evidence": ("lineitem", EVIDENCE), "intervals_a": ("orders", INTERVALS_A), "intervals_b": ("part", INTERVALS_B), "segments": ("part", SEGMENTS), "cigars": ("lineitem", CIGARS)}
ORDER = ["k1", "k2", "k3", "k4", "k5"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = SOURCES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e.format(**SPARK)} as `{c}`" for c, e in columns.items()])


def duck(name: str) -> str:
    """The same view as the body of a common table expression."""
    table, columns = SOURCES[name]
    return f"{name} as (select " + ", ".join(f'{e.format(**DUCK)} as "{c}"' for c, e in columns.items()) + f" from {table})"


def windows(df: DataFrame, width: int = 20) -> DataFrame:
    """Evidence with intervals of `width` on either side of its inner ends, as clustering wants them."""
    kind = F.when(F.col("strand_l") == F.col("strand_r"), "INV").when(F.col("strand_l") == "+", "DEL").otherwise("DUP")
    return df.withColumns(
        {"sv_type": kind, "begin_l": F.col("end_l") - width, "finish_l": F.col("end_l") + width, "begin_r": F.col("start_r") - 2 * width, "finish_r": F.col("start_r") + width, "clip_l": F.lit(0).cast("long"), "clip_r": F.lit(0).cast("long")}
    )


WINDOWS = """windows as (select *, case when strand_l = strand_r then 'INV' when strand_l = '+' then 'DEL' else 'DUP' end as sv_type,
 end_l - 20 as begin_l, end_l + 20 as finish_l, start_r - 40 as begin_r, start_r + 20 as finish_r from evidence)"""
