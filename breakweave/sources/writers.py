"""Writers: DataFrames as lines of genomic text formats. Each gives a column `line`; write it with save()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.functions.calls import breakend

#: The INFO, FORMAT and ALT ids of a call file with number and type; those that the format itself reserves
#: (SVTYPE, SVLEN, END, IMPRECISE, CIPOS, CIEND, MATEID, EVENT, GT, the ALT ids) have its meaning.
INFO = [
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("SVLEN", ".", "Integer", "Difference in length between REF and ALT alleles"),
    ("END", "1", "Integer", "End position of the variant described in this record"),
    ("STRANDS", ".", "String", "Strand pairs of the members and how many have each"),
    ("IMPRECISE", "0", "Flag", "Imprecise structural variation"),
    ("CIPOS", "2", "Integer", "Confidence interval around POS for imprecise variants"),
    ("CIEND", "2", "Integer", "Confidence interval around END for imprecise variants"),
    ("CIPOS95", "2", "Integer", "Offsets from POS that hold 0.95 of its curve"),
    ("CIEND95", "2", "Integer", "Offsets from END that hold 0.95 of its curve"),
    ("MATEID", ".", "String", "ID of mate breakends"),
    ("EVENT", "1", "String", "ID of event associated to breakend"),
    ("SECONDARY", "0", "Flag", "Second line of a pair of breakends"),
    ("SU", ".", "Integer", "Members of the call in all samples"),
    ("PE", ".", "Integer", "Members that are read pairs"),
    ("SR", ".", "Integer", "Members that are split reads"),
    ("BD", ".", "Integer", "Members that are given intervals"),
    ("EV", ".", "String", "Kinds of members"),
    ("PRPOS", ".", "String", "Probabilities of the positions around POS"),
    ("PREND", ".", "String", "Probabilities of the positions around END"),
]
FORMAT = [
    ("GT", "String", "Genotype"),
    ("SU", "Integer", "Members of this sample"),
    ("PE", "Integer", "Read pairs of this sample"),
    ("SR", "Integer", "Split reads of this sample"),
    ("BD", "Integer", "Given intervals of this sample"),
]
ALT = [
    ("DEL", "Deletion"),
    ("DUP", "Duplication"),
    ("INV", "Inversion"),
    ("DUP:TANDEM", "Tandem duplication"),
    ("INS", "Insertion of novel sequence"),
    ("CNV", "Copy number variable region"),
]


def tabbed(*columns: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\t", *[F.coalesce(p.cast("string"), F.lit(".")) for p in parts])


def vcf_header(samples: list[str], source: str = "breakweave") -> list[str]:
    info = [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFO]
    alt = [f'##ALT=<ID={i},Description="{d}">' for i, d in ALT]
    form = [f'##FORMAT=<ID={i},Number=1,Type={t},Description="{d}">' for i, t, d in FORMAT]
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])
    return ["##fileformat=VCFv4.2", f"##source={source}", *info, *alt, *form, names]


def _entry(key: str, value: Column) -> Column:
    """`key=value`, null (which concat_ws leaves out) where the value is null."""
    return F.concat(F.lit(f"{key}="), value.cast("string"))


def _listed(value: Column) -> Column:
    return F.array_join(value.cast("array<string>"), ",")


def vcf_lines(calls: DataFrame, samples: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(call_id, part, line): one line for each call, two for a pair of breakends.

    calls has call_id, chrom_l, pos_l, chrom_r, pos_r, reported, strands (`++:n,--:m`), sv_len and SU. It may have cipos,
    ciend, cipos95 and ciend95 (arrays of two offsets), prpos and prend (arrays of probabilities), a count for each of
    `types`, and `support`, a map from sample to a struct of SU and these counts, for FORMAT and a column for each of
    `samples` (a sample that the map lacks has zeros). Without samples the records end at INFO.

    Positions name the base on the left of a breakpoint; of breakends, a side whose strand is - names the next one.
    """
    types = types or []
    lead, broken = F.substring("strands", 1, 2), F.col("reported") == "BND"
    # which strand pair decides on the positions, if a call has several
    order = F.when(F.col("strands").contains("--"), "--").when(F.col("strands").contains("-+"), "-+").when(F.col("strands").contains("++"), "++").otherwise("+-")
    bump = lambda k: F.when(broken & (F.substring(order, k, 1) == "-"), 1).otherwise(0)
    pos_l, pos_r = F.col("pos_l") + bump(1), F.col("pos_r") + bump(2)
    has = lambda name: F.col(name) if name in calls.columns else F.lit(None)
    listed = lambda name: _listed(F.col(name)) if name in calls.columns else F.lit(None).cast("string")
    moved = [F.exists(F.col(c), lambda x: x != 0) for c in ("cipos95", "ciend95") if c in calls.columns]
    imprecise = F.when(moved[0] | moved[-1], "IMPRECISE") if moved else F.lit(None).cast("string")
    counts = [_entry("SU", F.col("SU")), *[_entry(t, has(t)) for t in types]]
    # for the second line both sides change places
    flipped = F.array_join(F.transform(F.split("strands", ","), lambda s: F.concat(F.substring(s, 2, 1), F.substring(s, 1, 1), F.substring(s, 3, 20))), ",")

    def info(strands: Column, middle: list[Column], l: str, r: str) -> Column:
        ci = [_entry("CIPOS", listed(f"ci{l}")), _entry("CIEND", listed(f"ci{r}")), _entry("CIPOS95", listed(f"ci{l}95")), _entry("CIEND95", listed(f"ci{r}95"))]
        curves = [_entry("PRPOS", listed(f"pr{l}")), _entry("PREND", listed(f"pr{r}"))]
        return F.concat_ws(";", _entry("SVTYPE", F.col("reported")), _entry("STRANDS", strands), *middle, *ci, imprecise, *counts, *curves)

    name = lambda k: F.concat(F.col("call_id").cast("string"), F.lit(f"_{k}"))
    mate = lambda k: [_entry("EVENT", F.col("call_id")), _entry("MATEID", name(3 - k))]
    tail = []
    if samples:
        zero = F.array_join(F.array(*[F.lit("0")] * (1 + len(types))), ":")
        own = lambda s: F.concat_ws(":", *[F.col("support")[s][k].cast("string") for k in ("SU", *types)])
        tail = [F.lit(":".join(["GT", "SU", *types])), *[F.concat(F.lit("./.:"), F.when(F.col("support")[s].isNull(), zero).otherwise(own(s))) for s in samples]]
    dot = F.lit(".")
    plain = info(F.col("strands"), [_entry("SVLEN", F.col("sv_len")), _entry("END", F.col("pos_r"))], "pos", "end")
    one = tabbed("chrom_l", "pos_l", "call_id", F.lit("N"), F.concat(F.lit("<"), "reported", F.lit(">")), dot, dot, plain, *tail)
    alt = lambda chrom, pos, first: breakend(lead, F.col(chrom).cast("string"), pos, first)
    first = tabbed("chrom_l", pos_l, name(1), F.lit("N"), alt("chrom_r", pos_r, True), dot, dot, info(F.col("strands"), mate(1), "pos", "end"), *tail)
    second = tabbed("chrom_r", pos_r, name(2), F.lit("N"), alt("chrom_l", pos_l, False), dot, dot, info(flipped, [F.lit("SECONDARY"), *mate(2)], "end", "pos"), *tail)
    return calls.select("call_id", F.posexplode(F.when(broken, F.array(first, second)).otherwise(F.array(one))).alias("part", "line"))


def bedpe_lines(calls: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Closed intervals begin/finish of either side, as 0-based half-open ones."""
    more = [F.concat(F.lit(f"{c.upper()}:"), F.col(c).cast("string")) for c in extra or []]
    start = lambda s: F.greatest(F.lit(0), F.col(f"begin_{s}") - 1)
    return calls.select(tabbed("chrom_l", start("l"), "finish_l", "chrom_r", start("r"), "finish_r", "name", "score", "strand_l", "strand_r", *more).alias("line"))


def vcf_to_bedpe(pairs: DataFrame) -> DataFrame:
    """Stitched breakends (first, second) as intervals of a base."""
    at = lambda x: [F.col(f"{x}.chrom"), F.col(f"{x}.pos") - 1, F.col(f"{x}.pos")]
    return pairs.select(tabbed(*at("first"), *at("second"), F.col("first.id"), F.col("first.qual")).alias("line"))


def bedgraph_lines(curve: DataFrame, chrom: str = "chrom") -> DataFrame:
    return curve.select(tabbed(chrom, "pos", F.col("pos") + 1, "p").alias("line"))


def evidence_lines(members: DataFrame, call: str, fields: list[str]) -> DataFrame:
    return members.select(tabbed(call, *fields).alias("line"))


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname"), F.col("seq"), F.lit("+"), F.col("qual")).alias("line"))


def fasta_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), "qname", F.lit("\n"), "seq").alias("line"))


def sam_lines(df: DataFrame, bases: bool = True) -> DataFrame:
    """Alignments with their tags; a tag whose type is unknown is text. Without `bases`, sequence and qualities are `*`."""
    seq = ["seq", "qual"] if bases else [F.lit("*"), F.lit("*")]
    fixed = tabbed("qname", "flag", "rname", F.col("pos") + 1, "mapq", "cigar", "mate_rname", F.col("mate_pos") + 1, "isize", *seq)
    if "tags" not in df.columns:
        return df.select(fixed.alias("line"))
    kind = lambda k: F.coalesce(F.col("tag_types")[k], F.lit("Z")) if "tag_types" in df.columns else F.lit("Z")
    tags = F.transform(F.map_entries("tags"), lambda t: F.concat_ws(":", t["key"], kind(t["key"]), t["value"]))
    return df.select(F.concat_ws("\t", fixed, tags).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def yaml_lines(df: DataFrame, name: str) -> DataFrame:
    rest = [F.concat(F.lit(f"  {c}: "), F.col(c).cast("string")) for c in df.columns if c != name]
    return df.select(F.concat_ws("\n", F.concat(F.col(name), F.lit(":")), *rest).alias("line"))


def bed_lines(df: DataFrame) -> DataFrame:
    """Undoes the widening of zero-length intervals."""
    end = F.col("end") - F.col("zero_length").cast("int")
    return df.select(tabbed("chrom", F.when(F.col("zero_length"), end).otherwise(F.col("start")), end, "name", "score", "strand").alias("line"))


def save(lines: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Text files of the lines, numbered in the order of their partitions; header lines are the first file."""
    rows = lines.select("line")
    if header:
        # one partition, put before those of the lines by the union
        rows = lines.sparkSession.createDataFrame([("\n".join(header),)], "line string").coalesce(1).union(rows)
    rows.write.mode("append").text(path)


def split_by(df: DataFrame, path: str, column: str) -> None:
    """One folder for each value of a column, as Parquet."""
    df.write.mode("append").partitionBy(column).parquet(path)
