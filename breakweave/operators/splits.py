"""Split and discordant records of a full alignment set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.functions import cigar
from breakweave.functions.rows import once
from breakweave.operators.stats import has


def usable(df: DataFrame) -> DataFrame:
    f = F.col("flag")
    return df.where(~(has(f, "unmapped") | has(f, "failed") | has(f, "duplicate")))


def discordant(df: DataFrame) -> DataFrame:
    f = F.col("flag")
    return df.where(has(f, "paired") & ~(has(f, "proper") | has(f, "mate_unmapped") | has(f, "supplementary")))


def supplementary(sa: str = "sa") -> tuple:
    """(rname, pos, strand, cigar) of the first entry of an SA tag, and how many entries it has."""
    parts = F.split(F.split(F.col(sa), ";")[0], ",")
    return parts[0], parts[1].cast("long"), parts[2], parts[3], F.size(F.filter(F.split(F.col(sa), ";"), lambda x: x != ""))


def split_reads(df: DataFrame, min_non_overlap: int = 20, min_indel: int = 50, max_desert: int = 50) -> DataFrame:
    """Records (rname, pos 0-based, flag, cigar, sa) with exactly one supplementary place and enough of the read on each side;
    on one chromosome and strand the two must also lie at least min_indel off one diagonal, with little unaligned between."""
    rname, pos, strand, other, entries = supplementary()
    one = df.where(entries == 1).withColumns({"__rname": rname, "__pos": pos - 1, "__strand": strand})
    # a generator keeps the folds over both CIGARs from being worked out again in every expression below
    minus = has(F.col("flag"), "reverse")
    own, mate = cigar.offsets(F.col("cigar"), minus), cigar.offsets(other, F.col("__strand") == "-")
    found = {f"__a_{k}": c for k, c in own.items()} | {f"__b_{k}": c for k, c in mate.items()}
    both = one.select("*", once(__minus=minus, __a_pos=F.col("pos"), __b_pos=F.col("__pos"), **found))
    eqo = lambda s: F.col(f"__{s}_sqo") + F.col(f"__{s}_qa") - 1
    both = both.withColumns({"__a_eqo": eqo("a"), "__b_eqo": eqo("b")})
    first = F.col("__a_sqo") <= F.col("__b_sqo")
    # __l_ is the part that comes first in the read, __r_ the other
    swap = lambda k, one, two: F.when(first, F.col(f"__{one}_{k}")).otherwise(F.col(f"__{two}_{k}"))
    both = both.withColumns({f"__{side}_{k}": swap(k, *order) for side, order in (("l", "ab"), ("r", "ba")) for k in ("sqo", "eqo", "pos", "ra", "sclip", "qa")})
    overlap = F.greatest(F.lit(0), 1 + F.least("__l_eqo", "__r_eqo") - F.greatest("__l_sqo", "__r_sqo"))
    mno = F.least(F.col("__l_eqo") - F.col("__l_sqo"), F.col("__r_eqo") - F.col("__r_sqo")) + 1 - overlap
    tail = lambda s: F.col(f"{s}_pos") + F.col(f"{s}_ra") - (F.col(f"{s}_sclip") + F.col(f"{s}_qa"))
    head = lambda s: F.col(f"{s}_pos") - F.col(f"{s}_sclip")
    ins = F.when(F.col("__minus"), tail("__r") - head("__l")).otherwise(tail("__l") - head("__r"))
    desert = F.col("__r_sqo") - F.col("__l_eqo") - 1
    same = (F.col("rname") == F.col("__rname")) & (F.col("__minus") == (F.col("__strand") == "-"))
    odd = (F.abs(ins) >= min_indel) & ~((desert > 0) & (desert - F.greatest(F.lit(0), ins) > max_desert))
    kept = both.withColumns({"mno": mno, "ins": ins, "desert": desert}).where((F.col("mno") >= min_non_overlap) & (~same | odd))
    return kept.drop(*[c for c in kept.columns if c.startswith("__")])


def for_realignment(df: DataFrame, min_clip: int = 20) -> DataFrame:
    """Unmapped records and those with more than min_clip bases not matched."""
    return df.where(has(F.col("flag"), "unmapped") | (cigar.not_matched(cigar.parse(F.col("cigar"))) > min_clip))


def reverted(df: DataFrame) -> DataFrame:
    """Original qualities back from the OQ tag, duplicate flags cleared."""
    return df.withColumns({"qual": F.coalesce(F.col("tags")["OQ"], F.col("qual")), "flag": F.col("flag").bitwiseAND(F.lit(~1024))})


def blocks(df: DataFrame, start: str = "pos", ops: str = "cigar") -> DataFrame:
    """A row (block_start, block_end) for each stretch of M, = or X on the reference; N and D move on."""
    step = "named_struct('at', a.at + if(x.op in ('M', 'D', 'N', '=', 'X'), x.len, 0), 'out', if(x.op in ('M', '=', 'X'), a.out || array(named_struct('block_start', a.at, 'block_end', a.at + x.len)), a.out))"
    own = df.withColumn("__ops", cigar.parse(F.col(ops)))
    empty = f"named_struct('at', cast({start} as bigint), 'out', cast(array() as array<struct<block_start:bigint,block_end:bigint>>))"
    return own.withColumn("__b", F.expr(f"aggregate(__ops, {empty}, (a, x) -> {step}).out")).select(*df.columns, F.inline("__b"))
