"""Rules of the operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.functions import calls, cigar, intervals, logspace, sequences
from breakweave.operators import calling, cluster, clusterwise, curves, evidence, islands, merge, overlap, pairing, predicates, splits, stats
from breakweave.plans.queries import QUERIES


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_log_space(spark):
    a, b, zero = (logspace.to_log(F.lit(x)) for x in (0.3, 0.2, 0.0))
    r = one(spark, add=logspace.to_p(logspace.add(a, b)), with_zero=logspace.to_p(logspace.add(a, zero)), times=logspace.to_p(logspace.multiply(a, zero)), by=logspace.to_p(logspace.divide(a, b)))
    assert (round(r["add"], 12), round(r["with_zero"], 12), r["times"], round(r["by"], 12)) == (0.5, 0.3, 0.0, 1.5)


def test_cigar(spark):
    ops = cigar.parse(F.lit("5H10S20M3I4D30M7S"))
    r = one(spark, end=cigar.reference_end(F.lit(100), ops), clip=cigar.clipped(ops), other=cigar.not_matched(ops), q=cigar.query_offsets(ops, F.lit(False)), back=cigar.query_offsets(ops, F.lit(True)), lead=cigar.leading_clips(ops), ms=cigar.matched_or_soft(ops), none=cigar.reference_end(F.lit(7), cigar.parse(F.lit("*"))))
    assert (r["end"], r["clip"], r["other"], r["lead"], r["ms"], r["none"]) == (154, 22, 29, 15, 67, 7)
    assert tuple(r["q"])[:2] == (5, 58) and tuple(r["back"])[:2] == (7, 60)


@pytest.mark.parametrize(("strands", "first", "second"), [("+-", "N[c:9[", "]c:9]N"), ("-+", "]c:9]N", "N[c:9["), ("++", "N]c:9]", "N]c:9]"), ("--", "[c:9[N", "[c:9[N")])
def test_breakends(spark, strands, first, second):
    r = one(spark, a=calls.breakend(F.lit(strands), F.lit("c"), F.lit(9), True), b=calls.breakend(F.lit(strands), F.lit("c"), F.lit(9), False))
    assert (r["a"], r["b"]) == (first, second)


def test_types(spark):
    t = lambda *a: calls.split_type(*map(F.lit, a))
    r = one(spark, a=t("+", "+", 1, 5), b=t("+", "+", 5, 1), c=t("-", "-", 5, 1), d=t("+", "-", 1, 5), e=t("+", "+", 3, 3))
    assert tuple(r) == ("DEL", "DUP", "DEL", "INV", None)
    k = lambda *a: calls.reported_type(*map(F.lit, a))
    r = one(spark, a=k(1, 2, "DEL", True, True), b=k(1, 1, "INV", True, False), c=k(1, 1, "INV", True, True), d=k(1, 1, "DUP", False, False))
    assert tuple(r) == ("BND", "BND", "INV", "DUP")


def test_sequences(spark):
    s = F.lit("ACGTacgtNß")
    r = one(spark, rc=sequences.reverse_complement(s), a=sequences.base_count(s, "A"), other=sequences.other_count(s), over=sequences.pattern_count(F.lit("aaaa"), "aa"), key=sequences.natural_key(F.lit("chr10x2")))
    assert (r["rc"], r["a"], r["other"], r["over"], r["key"]) == ("ßNacgtACGT", 2, 2, 3, "chr000000000010x000000000002")


def test_bins(spark):
    b = lambda s, e: intervals.bin_number(F.lit(s), F.lit(e))
    r = one(spark, a=b(0, 10), b=b(16380, 16390), c=b(20000, 20001))
    assert r["a"] == 37449 and r["c"] == 37450 and r["b"] == intervals.level_offset(1)


A4 = [
    ("+", "+", 1, 5, "DEL", "+", "-", "end", "start"), ("-", "-", 5, 1, "DEL", "+", "-", "end", "start"), ("+", "+", 5, 1, "DUP", "-", "+", "start", "end"),
    ("-", "+", 1, 5, "INV", "-", "-", "start", "start"), ("+", "-", 5, 1, "INV", "-", "-", "start", "start"), ("+", "-", 1, 5, "INV", "+", "+", "end", "end"), ("-", "+", 5, 1, "INV", "+", "+", "end", "end"),
]


@pytest.mark.parametrize(("sl", "sr", "ql", "qr", "kind", "ol", "orr", "al", "ar"), A4)
def test_split_anchors(spark, sl, sr, ql, qr, kind, ol, orr, al, ar):
    row = {"chrom_l": 1, "chrom_r": 1, "start_l": 1000, "end_l": 1100, "start_r": 5000, "end_r": 5100, "strand_l": sl, "strand_r": sr, "query_l": ql, "query_r": qr}
    r = evidence.split_intervals(spark.createDataFrame([row]), evidence.SplitSource(back=10)).first()
    assert (r["sv_type"], r["strand_l"], r["strand_r"]) == (kind, ol, orr)
    assert (r["begin_l"], r["begin_r"]) == (row[f"{al}_l"] - 10, row[f"{ar}_r"] - 10)


def test_ambiguous_split_is_dropped(spark):
    row = {"chrom_l": 1, "chrom_r": 1, "start_l": 1, "end_l": 2, "start_r": 5, "end_r": 6, "strand_l": "+", "strand_r": "-", "query_l": 3, "query_r": 3}
    assert evidence.split_intervals(spark.createDataFrame([row]), evidence.SplitSource(back=1)).count() == 0


def test_pair_intervals_are_bounded_and_clipped(spark):
    row = {"chrom_l": 1, "chrom_r": 1, "start_l": 5, "end_l": 55, "start_r": 120, "end_r": 170, "strand_l": "-", "strand_r": "-"}
    r = evidence.pair_intervals(spark.createDataFrame([row]), evidence.PairSource(300, 20, 4, back=10, reach=100)).first()
    assert (r["begin_l"], r["finish_l"], r["clip_l"]) == (0, 15, 84)
    assert (r["begin_r"], r["finish_r"], r["clip_r"]) == (56, 130, 25)


def brute(a, b, closed):
    return {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and (x[2] <= y[3] and y[2] <= x[3] if closed else x[2] < y[3] and y[2] < x[3])}


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_against_all_pairs(spark, closed):
    rng = random.Random(1)
    make = lambda n: [(k, rng.randrange(3), s, s + rng.randrange(1, 300)) for k in range(n) for s in [rng.randrange(5000)]]
    a, b = make(120), make(90)
    da, db = (spark.createDataFrame(x, "id long, chrom long, start long, end long") for x in (a, b))
    got = [(r["a"]["id"], r["b"]["id"]) for r in overlap.pairs(da, db, closed=closed, width=64).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, b, closed)
    with_hit = {x for x, _ in brute(a, b, closed)}
    assert {r["id"] for r in overlap.semi(da, db, ["id"], closed=closed).collect()} == with_hit
    assert {r["id"] for r in overlap.semi(da, db, ["id"], anti=True, closed=closed).collect()} == {x[0] for x in a} - with_hit


def test_coverage_against_bases(spark):
    rng = random.Random(2)
    rows = [(0, s, s + rng.randrange(1, 40)) for s in (rng.randrange(300) for _ in range(60))]
    df = spark.createDataFrame(rows, "chrom long, start long, end long")
    depth = np.zeros(400, int)
    for _, s, e in rows:
        depth[s:e] += 1
    got = np.zeros(400, int)
    for r in islands.coverage_runs(df, ["chrom"]).collect():
        got[r["start"] : r["end"]] = r["depth"]
    assert (got == depth).all()
    assert {r["pos"]: r["depth"] for r in islands.depth(df, ["chrom"]).collect()} == {k: d for k, d in enumerate(depth.tolist()) if d}


def test_toggle_and_gate(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("c", 1, True)]
    df = spark.createDataFrame(rows, "name string, at long, clip boolean")
    assert {(r["name"], r["first"]["at"], r["second"]["at"]) for r in pairing.toggled(df, ["name"], ["at"]).collect()} == {("a", 1, 2), ("b", 1, 2)}
    assert {(r["name"], r["first"]["at"], r["second"]["at"]) for r in pairing.gated(df, ["name"], ["at"], F.col("clip")).collect()} == {("a", 1, 2), ("b", 2, 3)}


def test_routing_prefers_the_group(spark):
    records = spark.createDataFrame([("f", "g"), ("f", "h"), ("z", "g")], "file string, grp string")
    sources = spark.createDataFrame([("f", "g", 1, 10), ("f", "", 2, 20), ("f", "g", 3, 30)], "file string, grp string, seq int, ev_id int")
    assert {(r["file"], r["grp"], r["ev_id"]) for r in pairing.routed(records, sources).collect()} == {("f", "g", 30), ("f", "h", 20)}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, 10, 50, 60), (5, 15, 55, 65)], [0, 0]),
        ([(0, 10, 50, 60), (20, 30, 50, 60), (8, 22, 52, 58)], [0, 1, None]),  # meets two
        ([(0, 10, 50, 60), (5, 15, 60, 70)], [0, None]),  # right sides touch
        ([(0, 10, 50, 60), (10, 20, 55, 65)], [0, 1]),  # left sides touch
        ([(0, 10, 50, 60), (1, 12, 51, 63), (11, 20, 55, 60)], [0, 0, 2]),  # means are whole numbers
    ],
)
def test_greedy_steps(rows, want):
    assert cluster.replay(rows) == want


def test_clusters_by_island_equal_the_whole(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        left, right = rng.randrange(600), 1000 + rng.randrange(600)
        rows.append((0, 0, "DEL", left, left + rng.randrange(5, 60), right, right + rng.randrange(5, 60), k))
    df = spark.createDataFrame(rows, "chrom_l long, chrom_r long, sv_type string, begin_l long, finish_l long, begin_r long, finish_r long, k long")
    for window in (None, 1200):
        want = cluster.replay([r[3:7] for r in rows], None)
        if window is None:
            got = {r["k"]: r["cluster"] for r in cluster.cluster(df, ["k"]).collect()}
            assert got == {k: None if w is None else str(w) for k, w in enumerate(want)}
    assert any(w is None for w in want)


def test_curves(spark):
    pair = curves.pair_curve(5, [0.5, 0.5, 0.0])
    assert len(pair) == 7 and math.exp(pair[0]) == pytest.approx(1e-4) and math.exp(pair[5]) == pytest.approx(1) and math.exp(pair[6]) == pytest.approx(0.5)
    assert curves.split_curve(3)[3] == 0 and curves.split_curve(3)[0] == pytest.approx(math.log(1e-4))
    arrays = spark.createDataFrame([(1, [0.05, 0.1, 0.5, 0.3, 0.05]), (2, [1.0]), (3, [0.2] * 5)], "k int, p array<double>").withColumn("first", F.lit(100))
    got = {r["k"]: (r["start"], r["stop"]) for r in curves.trimmed(arrays, 0.2).collect()}
    assert got == {1: (101, 102), 2: (100, 100), 3: (100, 102)}
    assert {r["k"]: (r["low"], r["high"]) for r in curves.interval95(arrays).collect()} == {1: (-2, 2), 2: (0, 0), 3: (0, 4)}


def test_deepest_sets_and_cliques():
    rows = [(0, 10, 100, 110), (5, 15, 105, 115), (8, 9, 108, 109), (14, 20, 90, 120), (50, 60, 100, 110)]
    assert [sorted(s) for s in merge.deepest_sets(rows)] == [[0, 1, 2], [3], [4]]
    assert merge.maximal_cliques({0: {1, 2}, 1: {0, 2}, 2: {0, 1, 3}, 3: {2}}) == [{0, 1, 2}, {2, 3}]
    assert merge.symmetric95([0.1, 0.2, 0.4, 0.2, 0.1], 2) == (0, 4)


def test_predicates(spark):
    df = spark.createDataFrame([(99, 60, 300, "chr1", "readA"), (83, 10, 900, "chr2", "xb"), (4, 0, 0, "*", "readC")], "flag int, mapq int, isize long, rname string, qname string")
    pick = lambda s: [r["qname"] for r in predicates.select(df, s).collect()]
    assert pick({"isMapped": "false"}) == ["readC"]
    assert pick({"name": "read*", "mapQuality": ">=60"}) == ["readA"]
    assert pick({"filters": [{"id": "a", "insertSize": ">500"}, {"id": "b", "name": "*C"}], "rule": "!(a | b)"}) == ["readA"]
    assert pick({"filters": [{"reference": "!chr1"}, {"mapQuality": "60"}]}) == ["readA", "xb", "readC"]
    with pytest.raises(ValueError):
        predicates.compiled({"filters": [{"id": "a", "isPaired": "true"}], "rule": "(a"})


def test_split_filter_bounds(spark):
    rows = [("c", 100, 0, "30M30S", "c,500,+,30S30M,60,0;"), ("c", 100, 0, "30M30S", "c,500,+,30S30M,60,0;d,1,+,60M,0,0;"), ("c", 100, 0, "41M19S", "c,900,+,41S19M,60,0;"), ("c", 100, 0, "30M30S", "c,131,+,30S30M,60,0;")]
    df = spark.createDataFrame(rows, "rname string, pos long, flag int, cigar string, sa string")
    got = splits.split_reads(df).collect()
    assert [(r["mno"], r["desert"]) for r in got] == [(30, 0)] and abs(got[0]["ins"]) >= 50


def test_stats_and_calls(spark):
    df = spark.createDataFrame([("s", v) for v in (1, 2, 2, 3, 9)], "g string, v long")
    r = stats.column_summary(df, "g", "v").first()
    assert (r["total"], r["median"], r["mode"], r["antimode"], r["n_distinct"], r["distinct_values"]) == (17, 2.0, 2, 1, 4, "1,2,3,9")
    assert stats.frequencies(df, "g", "v").first()["falling"] == "2:2,1:1,3:1,9:1"
    c = spark.createDataFrame([(2, 5), (1, 7), (1, 3)], "chrom_l long, pos long")
    assert [(r["chrom_l"], r["pos"], r["call_id"]) for r in calling.numbered(c, ["pos"]).orderBy("call_id").collect()] == [(1, 3, 1), (1, 7, 2), (2, 5, 3)]


def test_curves_are_padded_and_compared(spark):
    rows = spark.createDataFrame([(1, 1, [0.5, 0.25, 0.25]), (2, 2, [1.0])], "id long, first long, p array<double>")
    wide = {r["id"]: r for r in curves.padded(rows, 0.0, 2).collect()}
    # two places on either side, one of them cut off below 0
    assert (wide[1]["first"], len(wide[1]["p"])) == (0, 6) and abs(sum(wide[1]["p"]) - 1) < 1e-12
    assert (wide[2]["first"], wide[2]["p"]) == (0, [1e-100, 1e-100, 1.0, 1e-100, 1e-100])
    pair = rows.where("id = 1").crossJoin(spark.createDataFrame([(2, [0.5, 0.1]), (9, [1.0])], "at long, q array<double>"))
    got = {r["at"]: r["m"] for r in pair.select("at", curves.shared_mass(F.col("first"), F.col("p"), F.col("at"), F.col("q")).alias("m")).collect()}
    assert abs(got[2] - 0.35) < 1e-12 and got[9] == 0.0


def test_pairs_take_the_curve_of_their_source(spark):
    sources = spark.createDataFrame([(7, [-1.0, -2.0, -3.0])], "ev_id long, curve array<double>")
    rows = spark.createDataFrame([(1, 7, 10, 12, 0, "+", 20, 21, 1, "-")], "id long, ev_id long, begin_l long, finish_l long, clip_l long, strand_l string, begin_r long, finish_r long, clip_r long, strand_r string")
    got = {(r["side"], r["pos"]): r["logp"] for r in curves.pair_curves(rows, sources).collect()}
    assert got == {("l", 10): -1.0, ("l", 11): -2.0, ("l", 12): -3.0, ("r", 20): -2.0, ("r", 21): -1.0}


def plain_products(rows, back):
    """{(key, side): (first, n_used, logps)} by dictionaries."""
    curve = lambda b, f, clip: {b + k: v - math.log(sum(math.exp(x) for x in raw)) for raw in [[math.log(1e-4) / back * abs(k + clip - back) for k in range(f - b + 1)]] for k, v in enumerate(raw)}
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        there = {"l": [r[2:5] for r in own if r[3] >= r[2]], "r": [r[5:8] for r in own if r[6] >= r[5]]}
        common = {s: (max(m[0] for m in x), min(m[1] for m in x)) for s, x in there.items() if x}
        if len(common) < 2 or any(a >= b for a, b in common.values()):
            modes = {}
            for s, x in there.items():
                mixed = {}
                for m in x:
                    for pos, v in curve(*m).items():
                        mixed[pos] = mixed.get(pos, 0) + math.exp(v)
                modes[s] = min(mixed, key=lambda p: (-round(math.log(mixed[p]), 9), p)) if mixed else None
            held = [r for r in own if sum(x[1] == r[1] for x in own) == 1 and None not in modes.values() and r[2] <= modes["l"] <= r[3] and r[5] <= modes["r"] <= r[6]]
            there = {"l": [r[2:5] for r in held], "r": [r[5:8] for r in held]}
        for s, x in there.items():
            if x:
                a, b = max(m[0] for m in x), min(m[1] for m in x)
                sums = [sum(curve(*m)[p] for m in x) for p in range(a, b + 1)]
                whole = max(sums) + math.log(sum(math.exp(v - max(sums)) for v in sums))
                out[key, s] = (a, len(x), [v - whole for v in sums])
    return out


def test_products_of_whole_clusters(spark, monkeypatch):
    """Members that come twice, sides that are missing, clusters over batch ends, gaps in hulls, clips."""
    rng = random.Random(7)
    rows = []
    for key in [None, *range(40)]:
        for _ in range(rng.choice([1, 2, 5, 9])):
            b, c, far = rng.randrange(12), rng.randrange(12), 100 * (rng.random() < 0.2)
            rows.append((key, rng.randrange(30), b, b + rng.choice([-1, 8, 14, 20, 20]), rng.randrange(3), c + far, c + far + rng.choice([-1, 8, 14, 20, 20]), 0))
    want = plain_products(rows, 10)
    df = spark.createDataFrame(rows, "key long, m long, begin_l long, finish_l long, clip_l long, begin_r long, finish_r long, clip_r long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        both = clusterwise.product_or_mode(df, ["key"], ["m"], lambda k, clip: math.log(1e-4) / 10 * np.abs(k + clip - 10))
        got = {(r["key"], r["side"]): (r["first"], r["n_used"], r["logps"]) for r in clusterwise.by_side(both, ["key"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and {k[0] for k in got} != {r[0] for r in rows}
    for k, (first, n, logs) in want.items():
        assert got[k][:2] == (first, n) and got[k][2] == pytest.approx(logs)
    whole = clusterwise._summed(9, np.array([0, 2, 4]), np.arange(20.0), np.array([1, 5, 7]), np.array([4, 5, 5]))
    monkeypatch.setattr(clusterwise, "PLACES", 1)
    assert clusterwise._summed(9, np.array([0, 2, 4]), np.arange(20.0), np.array([1, 5, 7]), np.array([4, 5, 5])).tolist() == whole.tolist()


@pytest.mark.parametrize("name", ["curve_product", "curve_mode", "curve_score", "curve_trim", "curve_ci95", "vcf_merge_sum", "vcf_merge_product"])
def test_curves_are_not_shuffled_by_position(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
    # places are made after the last shuffle
    assert "Generate" not in plan[plan.index("MapInArrow") :]
