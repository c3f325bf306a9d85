"""CIGAR strings as arrays of (op, len), and what alignments need from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(cigar: Column) -> Column:
    """array<struct<op string, len long>>; an empty or `*` string gives an empty array."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("len")))


def total(ops: Column, kinds: str) -> Column:
    """Summed length of the ops of these kinds."""
    own = F.filter(ops, lambda x: x["op"].isin(*kinds))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_end(start: Column, ops: Column) -> Column:
    """Half-open end on the reference."""
    return start + total(ops, "DMXN=")


def clipped(ops: Column) -> Column:
    return total(ops, "HS")


def matched_or_soft(ops: Column) -> Column:
    return total(ops, "MS")


def not_matched(ops: Column) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"] != "M"), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def query_offsets(ops: Column, reverse: Column) -> Column:
    """struct<start, end, length>: the part of the read that aligns, in read direction; only a first op may be a leading clip."""
    directed = F.when(reverse, F.reverse(ops)).otherwise(ops)
    lead = F.when(F.element_at(directed, 1)["op"].isin("S", "H"), F.element_at(directed, 1)["len"]).otherwise(0)
    return F.when(
        F.size(ops) > 0,
        F.struct(lead.cast("long").alias("start"), (lead + total(ops, "MI")).cast("long").alias("end"), total(ops, "MISH=X").alias("length")),
    )


def text_total(cigar: Column, kinds: str) -> Column:
    """total() straight from the string: one pattern, and a fold over the lengths it finds."""
    lens = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def offsets(cigar: Column, reverse: Column) -> dict[str, Column]:
    """ra, qa, sclip, eclip, sqo: aligned lengths on reference and read, clips, and the offset in read direction, of a string."""
    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    lead, tail = clip(r"^(\d+)[SH]"), clip(r"[MIDNSHP=X](\d+)[SH]$")
    return {"ra": text_total(cigar, "MDN=X"), "qa": text_total(cigar, "MI=X"), "sclip": lead, "eclip": tail, "sqo": F.when(reverse, tail).otherwise(lead)}


def leading_clips(ops: Column) -> Column:
    """All clips before the first op that consumes the read."""
    step = lambda a, x: F.when(a["open"] & x["op"].isin("S", "H"), F.struct((a["n"] + x["len"]).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), (a["open"] & ~x["op"].isin("M", "I")).alias("open")))
    return F.aggregate(ops, F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("open")), step)["n"]
