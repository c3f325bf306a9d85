"""Readers: genomic text formats as typed DataFrames.

Every reader goes through Spark's text and CSV sources, so compressed files, globs and remote stores work as they do there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = r"^(#|track|browser)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, fields) of the lines that are no comments."""
    return fielded(spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")))


def fielded(rows: DataFrame) -> DataFrame:
    """rows (line, ...) that are no comments, with their `fields`."""
    return rows.where(~F.col("line").rlike(SKIPPED) & (F.trim("line") != "")).withColumn("fields", F.split("line", "\t"))


def field(k: int, kind: str = "string") -> Column:
    return F.get("fields", F.lit(k)).cast(kind)


def sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_rows(spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("source")))


def sam_rows(text: DataFrame) -> DataFrame:
    """Alignments of (line, source), positions 0-based; tags as a map, and their types as another."""
    rows = text.where(~F.col("line").startswith("@")).withColumn("fields", F.split("line", "\t"))
    kinds = F.map_from_entries(F.transform(F.slice("fields", 12, 10_000), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1))))
    tags = F.map_from_entries(F.transform(F.slice("fields", 12, 10_000), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    return rows.select(
        field(0).alias("qname"), field(1, "int").alias("flag"), field(2).alias("rname"), (field(3, "long") - 1).alias("pos"), field(4, "int").alias("mapq"), field(5).alias("cigar"),
        F.when(field(6) == "=", field(2)).otherwise(field(6)).alias("mate_rname"), (field(7, "long") - 1).alias("mate_pos"), field(8, "long").alias("isize"), field(9).alias("seq"), field(10).alias("qual"), tags.alias("tags"), kinds.alias("tag_types"), "source",
    )


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags) of header lines, and with it reference names, lengths, read groups and samples."""
    rows = spark.read.text(path).where(F.col("value").startswith("@")).withColumn("fields", F.split("value", "\t"))
    tags = F.map_from_entries(F.transform(F.filter(F.slice("fields", 2, 10_000), lambda t: t.contains(":")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1 << 30))))
    return rows.select(F.substring(field(0), 2, 2).alias("kind"), tags.alias("tags"), F.col("value").alias("line"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    return bed_rows(lines(spark, path))


def bed_rows(text: DataFrame) -> DataFrame:
    """Intervals of fielded BED, VCF or GFF lines, told apart line by line; half-open, a zero-length one widened by a base
    on either side (not beyond 0; `zero_length` tells, and the writer takes the place from the end)."""
    rows = text.withColumn("n", F.size("fields"))
    number = lambda k: F.get("fields", F.lit(k)).rlike(r"^\d+$")
    is_bed, is_gff = (F.col("n") >= 3) & number(1) & number(2), (F.col("n") >= 8) & number(3) & number(4)
    kind = F.when(is_bed, "bed").when(is_gff, "gff").when((F.col("n") >= 8) & number(1), "vcf")
    start = F.when(F.col("kind") == "bed", field(1, "long")).when(F.col("kind") == "gff", field(3, "long") - 1).otherwise(field(1, "long") - 1)
    end = F.when(F.col("kind") == "bed", field(2, "long")).when(F.col("kind") == "gff", field(4, "long")).otherwise(start + F.length(field(3)))
    found = rows.withColumn("kind", kind).where("kind is not null").select(
        field(0).alias("chrom"), start.alias("start"), end.alias("end"), "kind", F.when(F.col("kind") == "gff", field(2)).when(F.col("kind") == "vcf", field(2)).otherwise(field(3)).alias("name"),
        F.when(F.col("kind") != "vcf", F.coalesce(F.when(F.col("kind") == "gff", field(5)).otherwise(field(4)), F.lit(""))).alias("score"), F.when(F.col("kind") == "gff", field(6)).when(F.col("kind") == "bed", field(5)).alias("strand"), "line",
    )
    empty = F.col("start") == F.col("end")
    return found.withColumns({"zero_length": empty, "start": F.when(empty, F.greatest(F.col("start") - 1, F.lit(0))).otherwise(F.col("start")), "end": F.when(empty, F.col("end") + 1).otherwise(F.col("end"))})


def bedpe(spark: SparkSession, path: str) -> DataFrame:
    return bedpe_rows(lines(spark, path))


def bedpe_rows(text: DataFrame) -> DataFrame:
    return text.where(F.size("fields") >= 6).select(
        field(0).alias("chrom_l"), field(1, "long").alias("start_l"), field(2, "long").alias("end_l"), field(3).alias("chrom_r"), field(4, "long").alias("start_r"), field(5, "long").alias("end_r"),
        field(6).alias("name"), field(7).alias("score"), field(8).alias("strand_l"), field(9).alias("strand_r"), F.slice("fields", 11, 10_000).alias("extra"),
    )


def bedpe_ends(df: DataFrame, key: str) -> DataFrame:
    """Two rows (key, side, chrom, start, end, strand) for each pair of intervals."""
    sides = [F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in ("chrom", "start", "end", "strand")]) for s in "lr"]
    return df.select(key, F.inline(F.array(*sides)))


def with_type(df: DataFrame) -> DataFrame:
    """Intervals read from BEDPE with the type that an extra field `TYPE:x` names; a row without one is an error."""
    tag = F.element_at(F.filter("extra", lambda x: x.startswith("TYPE:")), 1)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in {"DELETION": "DEL", "DUPLICATION": "DUP", "INVERSION": "INV", "INTERCHROM": "BND"}.items() for x in pair]), F.substring(tag, 6, 100))
    return df.withColumn("sv_type", F.when(kind.isNull(), F.raise_error(F.lit("evidence without a known TYPE"))).otherwise(kind))


def vcf(spark: SparkSession, path: str, sample_names: bool = False) -> DataFrame:
    """Records of VCF files; with sample_names, `sname` is the file's name."""
    found = vcf_rows(lines(spark, path))
    return found.withColumn("sname", F.regexp_extract("file", r"([^/]+)$", 1)) if sample_names else found


def vcf_rows(text: DataFrame) -> DataFrame:
    """Records without secondary lines; INFO as a map; breakends on one chromosome with equal strands become inversions."""
    rows = text.where(F.size("fields") >= 8)
    info = F.str_to_map(field(7), F.lit(";"), F.lit("="))
    found = rows.select(
        field(0).alias("chrom"), field(1, "long").alias("pos"), field(2).alias("id"), field(3).alias("ref"), field(4).alias("alt"), field(5).alias("qual"), field(6).alias("filter"), info.alias("info"),
        F.split(field(8), ":").alias("format"), F.transform(F.slice("fields", 10, 10_000), lambda s: F.split(s, ":")).alias("samples"), "file",
    ).where(~F.map_contains_key("info", "SECONDARY"))
    mate = F.regexp_extract("alt", r"[\[\]]([^\[\]:]+):(\d+)[\[\]]", 1)
    strands = F.substring(F.col("info")["STRANDS"], 1, 2)
    inverted = (F.col("info")["SVTYPE"] == "BND") & (mate == F.col("chrom")) & strands.isin("++", "--")
    return found.withColumn("sv_type", F.when(inverted, "INV").otherwise(F.col("info")["SVTYPE"]))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """Distinct header lines of all files but dates, in the order of a merged file."""
    rows = spark.read.text(path).where(F.col("value").startswith("#") & ~F.col("value").startswith("##fileDate")).distinct()
    order = F.expr("case " + " ".join(f"when value like '##{k}%' then {n}" for n, k in enumerate(("fileformat", "source", "INFO", "ALT", "FORMAT", "SAMPLE"))) + " when value like '#CHROM%' then 99 else 50 end")
    return rows.select("value", order.alias("place")).orderBy("place", "value")


def call_ends(df: DataFrame) -> DataFrame:
    """Both sides' coordinates of VCF records from POS, END or the ALT, widened by CIPOS and CIEND."""
    info = F.col("info")
    ci = lambda key, k: F.coalesce(F.split(info[key], ",")[k].cast("long"), F.lit(0))
    mate = [F.regexp_extract("alt", r"[\[\]]([^\[\]:]+):(\d+)[\[\]]", k) for k in (1, 2)]
    broken = F.col("alt").rlike(r"[\[\]]")
    chrom_r, pos_r = F.when(broken, mate[0]).otherwise(F.col("chrom")), F.when(broken, mate[1].cast("long")).otherwise(F.coalesce(info["END"].cast("long"), F.col("pos")))
    return df.withColumns({"chrom_l": F.col("chrom"), "chrom_r": chrom_r, "start_l": F.col("pos") + ci("CIPOS", 0), "end_l": F.col("pos") + ci("CIPOS", 1), "start_r": pos_r + ci("CIEND", 0), "end_r": pos_r + ci("CIEND", 1)})


def genome(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length, ordinal); a genome file is small and its order is that of its lines."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("fields", F.split("value", "\t")).where(F.size("fields") >= 2)
    return rows.coalesce(1).select(field(0).alias("chrom"), field(1, "long").alias("length"), F.monotonically_increasing_id().alias("ordinal"))


def histogram(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(field(0, "long").alias("bin"), field(1, "double").alias("freq"))


def bedgraph(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    return lines(spark, path).select(field(0).alias("chrom"), field(1, "long").alias("start"), field(2, "long").alias("end"), field(3, kind).alias("depth"))


def tab(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("fields")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, sv_type, log2) of copy-number segments: a table with a log2 column, or `type<TAB>chr:start-end` lines."""
    rows = lines(spark, path)
    table = rows.where((F.size("fields") >= 5) & field(1).rlike(r"^\d+$")).select(field(0).alias("chrom"), field(1, "long").alias("start"), field(2, "long").alias("end"), F.when(field(4, "double") < 0, "DEL").otherwise("DUP").alias("sv_type"), field(4, "double").alias("log2"))
    at = [F.regexp_extract(field(1), r"^(.+):(\d+)-(\d+)$", k) for k in (1, 2, 3)]
    listed = rows.where(field(1).rlike(r"^.+:\d+-\d+$")).select(at[0].alias("chrom"), at[1].cast("long").alias("start"), at[2].cast("long").alias("end"), F.when(field(0).startswith("del"), "DEL").otherwise("DUP").alias("sv_type"), F.lit(None).cast("double").alias("log2"))
    return table.unionByName(listed)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of each record."""
    # a record begins with > at the start of a line; one inside a header is part of the header
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.expr("substring(value, locate('\n', value) + 1)"), r"\s", "")
    return rows.select(F.split(head, r"\s+")[0].alias("name"), head.alias("description"), seq.alias("seq"))


def lengths(df: DataFrame) -> DataFrame:
    """(name, length) of sequences."""
    return df.select("name", F.length("seq").cast("long").alias("length"))


def starting_with(df: DataFrame, prefix: str) -> DataFrame:
    """The first sequence by name among those whose description begins with a prefix."""
    return df.where(F.col("description").startswith(prefix)).orderBy("description").limit(1)


def sub_sequence(df: DataFrame, start: int, size: int) -> DataFrame:
    return df.select("name", F.substring("seq", start + 1, size).alias("seq"))


