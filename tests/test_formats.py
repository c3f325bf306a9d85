"""Readers and writers on files, and streaming over them."""

import gzip

from pyspark.sql import functions as F

from breakweave.sources import readers, writers
from breakweave.streaming import passes


def put(tmp_path, name, text):
    path = tmp_path / name
    (gzip.open(path, "wt") if name.endswith("gz") else open(path, "w")).write(text)
    return f"file://{path}"


def test_intervals(spark, tmp_path):
    path = put(tmp_path, "a.bed.gz", "track x\n#c\nc1\t5\t9\tn\t3\t-\nc1\t7\t7\nc2\t10\trs\tACG\tT\t.\t.\t.\nc3\tsrc\tgene\t4\t8\t.\t+\t.\tid\n")
    got = [(r["chrom"], r["start"], r["end"], r["kind"], r["zero_length"]) for r in readers.bed(spark, path).collect()]
    assert got == [("c1", 5, 9, "bed", False), ("c1", 6, 8, "bed", True), ("c2", 9, 12, "vcf", False), ("c3", 3, 8, "gff", False)]
    assert writers.bed_lines(readers.bed(spark, path)).collect()[1]["line"].startswith("c1\t7\t7")


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tSO:coordinate\n@SQ\tSN:c1\tLN:99\nr1\t99\tc1\t11\t60\t5M\t=\t50\t44\tACGTA\tIIIII\tRG:Z:g1\tNM:i:0\n")
    r = readers.sam(spark, path).first()
    assert (r["pos"], r["mate_rname"], r["mate_pos"], r["tags"]["RG"], r["tags"]["NM"]) == (10, "c1", 49, "g1", "0")
    assert {h["kind"]: h["tags"] for h in readers.sam_header(spark, path).collect()}["SQ"] == {"SN": "c1", "LN": "99"}
    rows = readers.sam(spark, path)
    assert writers.fastq_lines(rows).first()["line"] == "@r1\nACGTA\n+\nIIIII"
    assert writers.sam_lines(rows).first()["line"].startswith("r1\t99\tc1\t11\t60\t5M\tc1\t50")


def test_calls_out_and_in(spark, tmp_path):
    calls = spark.createDataFrame(
        [(1, "c1", 100, "c1", 500, "DEL", "+-:4", -400, 4), (2, "c1", 100, "c2", 900, "BND", "--:3", None, 3)],
        "call_id long, chrom_l string, pos_l long, chrom_r string, pos_r long, reported string, strands string, sv_len long, SU long",
    )
    lines = writers.vcf_lines(calls)
    assert lines.count() == 3
    path = f"file://{tmp_path}/calls"
    writers.save(lines, path, writers.vcf_header(["S"]))
    back = readers.call_ends(readers.vcf(spark, path)).orderBy("id").collect()
    assert [(r["id"], r["chrom_l"], r["start_l"], r["chrom_r"], r["start_r"]) for r in back] == [("1", "c1", 100, "c1", 500), ("2_1", "c1", 101, "c2", 901)]
    assert readers.vcf_header(spark, path).first()["value"] == "##fileformat=VCFv4.2"


def test_zero_length_intervals_come_back(spark, tmp_path):
    path = put(tmp_path, "z.bed", "c1\t0\t0\tn\t1\t+\nc1\t7\t7\tm\t1\t+\nc1\t3\t9\to\t1\t-\n")
    assert [r["line"] for r in writers.bed_lines(readers.bed(spark, path)).collect()] == ["c1\t0\t0\tn\t1\t+", "c1\t7\t7\tm\t1\t+", "c1\t3\t9\to\t1\t-"]


def test_alignments_keep_their_tags(spark, tmp_path):
    line = "r1\t99\tc1\t11\t60\t5M\tc2\t50\t44\tACGTA\tIIIII\tRG:Z:g1\tNM:i:0\tSA:Z:c1,5,+,5M,60,0;"
    path = put(tmp_path, "t.sam", line + "\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    rows = readers.sam(spark, path)
    assert [r["line"] for r in writers.sam_lines(rows).collect()] == [line, "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI"]
    assert "\t*\t*\tRG:Z:g1" in writers.sam_lines(rows, bases=False).first()["line"]


def test_records_have_a_column_for_each_sample(spark, tmp_path):
    calls = spark.createDataFrame(
        [
            (1, "c1", 100, "c1", 500, "BND", "++:1,--:3", 4, 3, [-5, 6], [-7, 8], [-1, 0], [0, 0], {"A": (3, 3)}),
            (2, "c1", 90, "c1", 95, "DUP", "-+:2", 2, 2, [0, 0], [0, 1], [0, 0], [0, 0], {"A": (1, 1), "B": (1, 1)}),
        ],
        "call_id long, chrom_l string, pos_l long, chrom_r string, pos_r long, reported string, strands string, SU long, PE long, cipos array<long>,"
        " ciend array<long>, cipos95 array<long>, ciend95 array<long>, support map<string, struct<SU long, PE long>>",
    ).withColumn("sv_len", F.lit(5).cast("long"))
    lines = [r["line"].split("\t") for r in writers.vcf_lines(calls, ["A", "B"], ["PE"]).orderBy("call_id", "part").collect()]
    # -- decides on the positions, ++ on the shape of the ALT
    assert [(x[0], x[1], x[4]) for x in lines] == [("c1", "101", "N]c1:501]"), ("c1", "501", "N]c1:101]"), ("c1", "90", "<DUP>")]
    assert lines[0][7] == "SVTYPE=BND;STRANDS=++:1,--:3;EVENT=1;MATEID=1_2;CIPOS=-5,6;CIEND=-7,8;CIPOS95=-1,0;CIEND95=0,0;IMPRECISE;SU=4;PE=3"
    assert lines[1][7] == "SVTYPE=BND;STRANDS=++:1,--:3;SECONDARY;EVENT=1;MATEID=1_1;CIPOS=-7,8;CIEND=-5,6;CIPOS95=0,0;CIEND95=-1,0;IMPRECISE;SU=4;PE=3"
    assert lines[2][7] == "SVTYPE=DUP;STRANDS=-+:2;SVLEN=5;END=95;CIPOS=0,0;CIEND=0,1;CIPOS95=0,0;CIEND95=0,0;SU=2;PE=2"
    assert [x[8:] for x in lines] == [["GT:SU:PE", "./.:3:3", "./.:0:0"]] * 2 + [["GT:SU:PE", "./.:1:1", "./.:1:1"]]
    path = f"file://{tmp_path}/full"
    writers.save(writers.vcf_lines(calls, ["A", "B"], ["PE"]), path, writers.vcf_header(["A", "B"]))
    first = sorted(p for p in (tmp_path / "full").iterdir() if p.name.startswith("part-"))[0]
    assert first.read_text().startswith("##fileformat") and "#CHROM" in first.read_text()


def test_sequence_headers_may_hold_the_mark(spark, tmp_path):
    fa = readers.fasta(spark, put(tmp_path, "m.fa", ">s1 a>b\nAC\nGT\n>s2\nGG\n>s3\nT"))
    assert {r["name"]: (r["description"], r["seq"]) for r in fa.collect()} == {"s1": ("s1 a>b", "ACGT"), "s2": ("s2", "GG"), "s3": ("s3", "T")}
    assert {r["name"]: r["length"] for r in readers.lengths(fa).collect()} == {"s1": 4, "s2": 2, "s3": 1}
    assert readers.starting_with(fa, "s1 a").first()["seq"] == "ACGT"


def test_breakends_on_one_chromosome_become_inversions(spark, tmp_path):
    path = put(tmp_path, "b.vcf", "#CHROM\nc1\t5\ta\tN\tN]c1:90]\t.\t.\tSVTYPE=BND;STRANDS=++:3\nc1\t5\tb\tN\tN]c2:90]\t.\t.\tSVTYPE=BND;STRANDS=++:3\nc1\t5\tc\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SECONDARY\n")
    assert {r["id"]: r["sv_type"] for r in readers.vcf(spark, path).collect()} == {"a": "INV", "b": "BND"}


def test_small_formats(spark, tmp_path):
    assert [tuple(r) for r in readers.genome(spark, put(tmp_path, "g", "#x\nc2\t10\nc1\t20\textra\n")).orderBy("ordinal").select("chrom", "length").collect()] == [("c2", 10), ("c1", 20)]
    assert readers.histogram(spark, put(tmp_path, "h", "0\t0.25\n1\t0.75\n")).agg(F.sum("freq")).first()[0] == 1.0
    cns = readers.segments(spark, put(tmp_path, "s.cns", "chromosome\tstart\tend\tgene\tlog2\tprobes\tweight\nc1\t5\t50\tg\t-0.5\t3\t1\n"))
    assert [(r["chrom"], r["sv_type"], r["log2"]) for r in cns.collect()] == [("c1", "DEL", -0.5)]
    listed = readers.segments(spark, put(tmp_path, "s.txt", "duplication\tc1:5-50\t45\n"))
    assert [(r["start"], r["end"], r["sv_type"]) for r in listed.collect()] == [(5, 50, "DUP")]
    fa = readers.fasta(spark, put(tmp_path, "f.fa", ">s1 first\nACG\nT\n>s2\nGG\n"))
    assert {r["name"]: r["seq"] for r in fa.collect()} == {"s1": "ACGT", "s2": "GG"}
    assert {r["name"]: r["seq"] for r in readers.sub_sequence(fa, 1, 2).collect()}["s1"] == "CG"
    pe = readers.bedpe(spark, put(tmp_path, "p.bedpe", "c1\t1\t2\tc1\t8\t9\tn\t3\t+\t-\tTYPE:DELETION\n"))
    assert readers.with_type(pe).first()["sv_type"] == "DEL" and readers.bedpe_ends(pe, "name").count() == 2
    assert writers.json_lines(pe.select("name", "start_l")).first()["line"] == '{"name":"n","start_l":1}'


def test_streams_count_and_cluster(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-01 00:{k:02d}:00", "u", 100, 120, 500, 520) for k in range(10)], "k long, t string, kind string, begin_l long, finish_l long, begin_r long, finish_r long")
    rows = rows.select("*", F.to_timestamp("t").alias("ts")).drop("t")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = passes.tumbling(stream(), "kind", "ts", "5 minutes", late="1 minute").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("win").collect()) == [5, 5]
    q = passes.clustered_stream(stream(), ["kind"]).writeStream.format("memory").queryName("clu").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["clusters"], r["discarded"]) for r in spark.table("clu").collect()][-1] == (1, 0)
    batch = passes.tumbling(rows, "kind", "ts", "5 minutes").collect()
    assert sorted(r["n"] for r in batch) == [5, 5]
    assert passes.sliding(rows, "kind", "ts", "4 minutes", "2 minutes").count() == 6
