"""Strings and types of calls."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_type(strand_l: Column, strand_r: Column) -> Column:
    return F.when(strand_l == strand_r, "INV").when(strand_l == "+", "DEL").otherwise("DUP")


def split_type(strand_l: Column, strand_r: Column, query_l: Column, query_r: Column) -> Column:
    """Null where a same-strand pair has equal query starts."""
    ahead = ((strand_l == "+") & (query_l < query_r)) | ((strand_l == "-") & (query_l > query_r))
    return F.when(strand_l != strand_r, "INV").when(query_l == query_r, F.lit(None)).when(ahead, "DEL").otherwise("DUP")


def breakend(strands: Column, chrom: Column, pos: Column, first: bool) -> Column:
    """ALT of one line of a breakend pair; `strands` are those of the first line, chrom and pos the mate's."""
    at = F.concat(chrom, F.lit(":"), pos.cast("string"))
    onward, back = F.concat(F.lit("N["), at, F.lit("[")), F.concat(F.lit("]"), at, F.lit("]N"))
    one, two = (onward, back) if first else (back, onward)
    return (
        F.when(strands == "++", F.concat(F.lit("N]"), at, F.lit("]")))
        .when(strands == "--", F.concat(F.lit("["), at, F.lit("[N")))
        .when(strands == "+-", one)
        .otherwise(two)
    )


def reported_type(chrom_l: Column, chrom_r: Column, kind: Column, has_pp: Column, has_mm: Column) -> Column:
    """BND between chromosomes; an inversion needs both orientations, else it is BND too."""
    return F.when(chrom_l != chrom_r, "BND").when(kind.isin("DEL", "DUP"), kind).when((kind == "INV") & has_pp & has_mm, "INV").otherwise("BND")


def length(kind: Column, pos_l: Column, pos_r: Column) -> Column:
    return F.when(kind == "DEL", pos_l - pos_r).when(kind == "BND", F.lit(None)).otherwise(pos_r - pos_l)
