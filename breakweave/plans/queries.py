"""Registered queries: each runs one operator over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakweave.functions import calls, cigar, intervals, logspace, sequences
from breakweave.operators import calling, cluster, clusterwise, curves, evidence, islands, merge, overlap, pairing, predicates, splits, stats
from breakweave.plans.fixtures import ORDER, view, windows
from breakweave.streaming import passes

PAIRS = evidence.PairSource(mean=1500.0, stdev=250.0, z=4, back=10, reach=100, min_mapq=20)
SPLITS = evidence.SplitSource(back=15, min_mapq=20)
KEYS = ["chrom_l", "chrom_r", "sv_type", "island_r", "island_l"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its islands, which serve as clusters where the ordered replay does not matter."""
    return cluster.islands(windows(view(spark, sf_dir, "evidence")))


def evidence_interval_pairs(spark, sf_dir):
    found = evidence.pair_intervals(view(spark, sf_dir, "evidence"), PAIRS)
    return found.select(*ORDER, "sv_type", "begin_l", "finish_l", "clip_l", "begin_r", "finish_r", "clip_r")


def split_interval_pairs(spark, sf_dir):
    found = evidence.split_intervals(evidence.sane_splits(view(spark, sf_dir, "evidence"), SPLITS), SPLITS)
    return found.select(*ORDER, "sv_type", "strand_l", "strand_r", "begin_l", "finish_l", "begin_r", "finish_r")


def pair_sanity_filter(spark, sf_dir):
    return evidence.sane_pairs(view(spark, sf_dir, "evidence"), PAIRS).select(*ORDER, "mapq", "end_l", "start_r")


def pair_aberrant_filter(spark, sf_dir):
    found = evidence.aberrant_pairs(view(spark, sf_dir, "evidence"), PAIRS)
    return found.select(*ORDER, "strand_l", "strand_r", (F.col("end_r") - F.col("start_l")).alias("span"))


def source_routing(spark, sf_dir):
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k1"), (F.col("l_suppkey") % 7).alias("file"), F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("g"), F.col("l_linenumber").cast("string"))).otherwise("g9").alias("grp"))
    sources = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 6).alias("file"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("s_suppkey") % 4).cast("string"))).alias("grp"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("ev_id"))
    return pairing.routed(records, sources).groupBy("file", "grp", "ev_id").agg(F.count("*").alias("n"))


def mate_pairing_toggle(spark, sf_dir):
    found = pairing.toggled(view(spark, sf_dir, "evidence").select("k1", "k2", "k3", "k4", "k5", "start_l"), ["k1"], ORDER)
    return found.select("k1", F.col("first.k2").alias("first_k2"), F.col("first.k3").alias("first_k3"), F.col("second.k2").alias("second_k2"), F.col("second.k3").alias("second_k3"))


def split_pairing_gated(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence").select(*ORDER, "query_l")
    found = pairing.gated(rows, ["k1"], ["k2", "k3", "k4", "k5"], F.col("query_l") >= 20)
    return found.select("k1", F.col("first.k2").alias("first_k2"), F.col("first.k3").alias("first_k3"), F.col("second.k2").alias("second_k2"), F.col("second.k3").alias("second_k3"))


def exclude_region_anti(spark, sf_dir):
    rows = view(spark, sf_dir, "intervals_a")
    return overlap.semi(rows, view(spark, sf_dir, "intervals_b"), ["id"], anti=True, closed=True).select("id", "chrom", "start", "end")


def overlap_join(spark, sf_dir):
    found = overlap.pairs(view(spark, sf_dir, "intervals_a"), view(spark, sf_dir, "intervals_b"))
    return found.select(F.col("a.id").alias("id"), F.col("b.pid").alias("pid"), intervals.overlap_half_open(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")).alias("bases"))


def overlap_semi(spark, sf_dir):
    return overlap.semi(view(spark, sf_dir, "intervals_a"), view(spark, sf_dir, "intervals_b"), ["id"]).select("id", "chrom", "start", "end")


def overlap_fraction_reciprocal(spark, sf_dir):
    found = overlap.hits(view(spark, sf_dir, "intervals_a"), view(spark, sf_dir, "intervals_b"), 0.3, reciprocal=True, same_strand=True)
    return found.select(F.col("a.id").alias("id"), F.col("b.pid").alias("pid"))


def overlap_left_hits(spark, sf_dir):
    found = overlap.left_hits(view(spark, sf_dir, "intervals_a"), view(spark, sf_dir, "intervals_b"), ["id"], "pid")
    return found.select("id", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


def count_hits(spark, sf_dir):
    return overlap.count_hits(view(spark, sf_dir, "intervals_b"), view(spark, sf_dir, "intervals_a"), ["pid"]).select("pid", "n_hits")


def _ends(df: DataFrame, key: str, reach: int) -> DataFrame:
    return df.select(key, F.col("chrom").alias("chrom_l"), F.col("chrom").alias("chrom_r"), F.col("start").alias("start_l"), (F.col("start") + 40).alias("end_l"), (F.col("end") + reach).alias("start_r"), (F.col("end") + reach + 400).alias("end_r"))


def pair_to_pair_both(spark, sf_dir):
    found = overlap.pair_to_pair(_ends(view(spark, sf_dir, "intervals_a"), "id", 100), _ends(view(spark, sf_dir, "intervals_b"), "pid", 50), ["id"])
    return found.select("id", "chrom_l", "start_l", "start_r")


def pair_to_pair_notboth(spark, sf_dir):
    found = overlap.pair_to_pair(_ends(view(spark, sf_dir, "intervals_a"), "id", 100), _ends(view(spark, sf_dir, "intervals_b"), "pid", 50), ["id"], both=False)
    return found.select("id", "chrom_l", "start_l", "start_r")


def bnd_mate_stitch(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").select(F.concat((F.col("o_orderkey") / 2).cast("long").cast("string"), F.lit("_"), (F.col("o_orderkey") % 2).cast("string")).alias("id"), F.concat((F.col("o_orderkey") / 2).cast("long").cast("string"), F.lit("_"), F.when(F.col("o_custkey") % 5 == 0, F.lit("9")).otherwise((1 - F.col("o_orderkey") % 2).cast("string"))).alias("mate_id"), (F.col("o_custkey") % 20).alias("chrom"), F.col("o_orderkey").alias("pos"))
    found, _ = pairing.mates(ends)
    return found.select(F.col("first.id").alias("id_1"), F.col("second.id").alias("id_2"), F.col("first.chrom").alias("chrom_1"), F.col("second.chrom").alias("chrom_2"), F.col("second.pos").alias("pos_2"))


def interval_merge_gap50(spark, sf_dir):
    return islands.merged(view(spark, sf_dir, "intervals_a"), ["chrom"], gap=50)


def genome_coverage_runs(spark, sf_dir):
    return islands.coverage_runs(view(spark, sf_dir, "intervals_a"), ["chrom"])


def coverage_summary(spark, sf_dir):
    return islands.coverage_summary(islands.coverage_runs(view(spark, sf_dir, "intervals_a"), ["chrom"]))


def deep_regions(spark, sf_dir):
    return islands.too_deep(islands.coverage_runs(view(spark, sf_dir, "intervals_a"), ["chrom"]), ["chrom"], 2)


def per_base_depth(spark, sf_dir):
    return islands.depth(view(spark, sf_dir, "intervals_b"), ["chrom"]).groupBy("chrom", "depth").agg(F.count("*").alias("bases"), F.sum("pos").alias("pos_sum"))


def island_cluster_lr(spark, sf_dir):
    return members(spark, sf_dir).groupBy(*KEYS[:3], "island_r", "island_l").agg(F.count("*").alias("n"), F.min("begin_l").alias("begin_l"), F.max("finish_l").alias("finish_l"), F.min("begin_r").alias("begin_r"), F.max("finish_r").alias("finish_r"))


def greedy_cluster(spark, sf_dir):
    return cluster.summed(cluster.cluster(windows(view(spark, sf_dir, "evidence")), ORDER))


def greedy_cluster_windowed(spark, sf_dir):
    return cluster.summed(cluster.cluster(windows(view(spark, sf_dir, "evidence")), ORDER, window=1_000_000))


def cluster_support_by_sample(spark, sf_dir):
    return calling.support(members(spark, sf_dir), KEYS)


def strand_histogram(spark, sf_dir):
    return calling.strand_counts(members(spark, sf_dir), KEYS)


def call_thresholds(spark, sf_dir):
    return calling.passing(members(spark, sf_dir), KEYS, min_weight=6, min_sample_weight=4)


def _shape(begin, pos, clip):
    return curves.two_sided(begin, pos, clip, 20)


def _sided(spark, sf_dir) -> DataFrame:
    """The intervals of all members of all clusters."""
    return curves.sided(members(spark, sf_dir), [*KEYS, *ORDER])


def _shape_at(offset, clip):
    return curves.two_sided_at(offset, clip, 20)


def _product(spark, sf_dir) -> DataFrame:
    return clusterwise.product_or_mode(members(spark, sf_dir), KEYS, ORDER, _shape_at)


def _arrays(spark, sf_dir) -> DataFrame:
    """Curves as arrays of probabilities; those whose logarithms are equal to nine places are, in whatever order members were added up."""
    p = F.transform("logps", lambda x: logspace.to_p(logspace.rounded(x, 9)))
    return clusterwise.by_side(_product(spark, sf_dir), KEYS).select(*KEYS, "side", "first", p.alias("p"))


def curve_product(spark, sf_dir):
    found = clusterwise.by_position(clusterwise.by_side(_product(spark, sf_dir), KEYS), "logps", "logp")
    return found.select(*KEYS, "side", "pos", logspace.rounded(F.col("logp"), 6).alias("logp"), "n_used")


def curve_mixture(spark, sf_dir):
    return curves.mixture(curves.by_position(curves.with_curves(_sided(spark, sf_dir), _shape)), KEYS).withColumn("logp", F.round("logp", 6))


def curve_mode(spark, sf_dir):
    found = clusterwise.modes(clusterwise.by_side(_product(spark, sf_dir), KEYS), KEYS, 6)
    return found.withColumn("max_logp", logspace.rounded(F.col("max_logp"), 6))


def curve_score(spark, sf_dir):
    return clusterwise.scores(_product(spark, sf_dir), KEYS).withColumn("score", logspace.rounded(F.col("score"), 9))


def curve_trim(spark, sf_dir):
    return curves.trimmed(_arrays(spark, sf_dir), 1e-3)


def curve_ci95(spark, sf_dir):
    return curves.interval95(_arrays(spark, sf_dir))


def log_space_algebra(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_discount").alias("p"), F.col("l_tax").alias("q"))
    a, b = logspace.to_log(F.col("p")), logspace.to_log(F.col("q"))
    r = lambda c: F.round(logspace.to_p(c), 9)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), r(logspace.multiply(a, b)).alias("times"), r(logspace.add(a, b)).alias("plus"))


def insert_size_stats(spark, sf_dir):
    return stats.insert_stats(view(spark, sf_dir, "cigars"), "isize").select("median", "upper_mad", "kept", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


def insert_size_histogram(spark, sf_dir):
    return stats.insert_histogram(view(spark, sf_dir, "cigars"), "isize", 100, 600).withColumn("freq", F.round("freq", 9))


def survival_curve(spark, sf_dir):
    found = stats.survival(stats.insert_histogram(view(spark, sf_dir, "cigars"), "isize", 100, 600))
    return found.select("bin", F.round("freq", 9).alias("freq"), F.round("survival", 9).alias("survival"))


def svtype_alt_strings(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence")
    s = F.concat("strand_l", "strand_r")
    alt = lambda c, p, first: calls.breakend(s, F.concat(F.lit("chr"), F.col(c).cast("string")), F.col(p), first)
    return rows.select(*ORDER, alt("chrom_r", "start_r", True).alias("alt_1"), alt("chrom_l", "end_l", False).alias("alt_2"))


def svlen_ci(spark, sf_dir):
    own = members(spark, sf_dir)
    pos = own.groupBy(*KEYS).agg(F.floor(F.sum("end_l") / F.count("*")).cast("long").alias("pos_l"), F.floor(F.sum("start_r") / F.count("*")).cast("long").alias("pos_r"), F.min("begin_l").alias("begin_l"), F.max("finish_l").alias("finish_l"))
    found = calling.typed(pos.join(calling.strand_counts(own, KEYS), KEYS))
    return found.select(*KEYS, "reported", F.coalesce("sv_len", F.lit(0)).alias("sv_len"), (F.col("begin_l") - F.col("pos_l")).alias("ci_low"), (F.col("finish_l") - F.col("pos_l")).alias("ci_high"))


def cigar_query_offsets(spark, sf_dir):
    rows = view(spark, sf_dir, "cigars").withColumn("ops", cigar.parse(F.col("cigar")))
    found = rows.withColumn("o", cigar.query_offsets(F.col("ops"), stats.has(F.col("flag"), "reverse")))
    return found.select(*ORDER, F.col("o.start").alias("query_start"), F.col("o.end").alias("query_end"), F.col("o.length").alias("query_length"))


def cigar_ref_end(spark, sf_dir):
    rows = view(spark, sf_dir, "cigars").withColumn("ops", cigar.parse(F.col("cigar")))
    ops = F.col("ops")
    return rows.select(*ORDER, cigar.reference_end(F.col("pos"), ops).alias("ref_end"), cigar.clipped(ops).alias("clipped"), cigar.not_matched(ops).alias("not_matched"), cigar.leading_clips(ops).alias("leading"))


def sa_split_filter(spark, sf_dir):
    found = splits.split_reads(splits.usable(view(spark, sf_dir, "cigars")))
    return found.select(*ORDER, "mno", "ins", "desert")


def discordant_filter(spark, sf_dir):
    return splits.discordant(splits.usable(view(spark, sf_dir, "cigars"))).select(*ORDER, "flag")


def block_expansion(spark, sf_dir):
    return splits.blocks(view(spark, sf_dir, "cigars")).select(*ORDER, "block_start", "block_end")


def flag_stats(spark, sf_dir):
    return stats.flag_stats(view(spark, sf_dir, "cigars")).withColumn("mean_insert", F.round("mean_insert", 6))


def library_orientation(spark, sf_dir):
    rows = view(spark, sf_dir, "cigars").select((F.col("k4") % 4).alias("grp"), stats.orientation(F.col("flag"), F.col("pos"), F.col("pos") + F.col("isize") - 350).alias("model"), "isize")
    return stats.library_model(rows, "grp", "model", "isize").select("grp", "models", F.round("ambiguity", 9).alias("ambiguity"), "n", F.round("low", 6).alias("low"), "median", F.round("high", 6).alias("high"))


def column_summaries(spark, sf_dir):
    found = stats.column_summary(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").cast("long").alias("v")), "grp", "v")
    return found.select("grp", "total", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "sstdev")], "median", "least", "most", "n", "mode", "antimode", "n_distinct", "distinct_values")


def value_frequencies(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_type").alias("v")), "grp", "v")


def sequence_composition(spark, sf_dir):
    seq = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[sequences.base_count(seq, b).alias(b.lower()) for b in "ACGT"], sequences.other_count(seq).alias("other"))


def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sequences.reverse_complement(F.col("text"))).alias("rc_md5"), F.substring(sequences.reverse_complement(F.col("text")), 1, 40).alias("rc_head"))


def pattern_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sequences.pattern_count(F.col("text"), "th").alias("th"), sequences.pattern_count(F.col("text"), "ee").alias("ee"))


def info_map_parse(spark, sf_dir):
    info = F.str_to_map(F.concat(F.lit("SVTYPE="), F.col("event_type"), F.lit(";END="), F.col("user_id").cast("string"), F.lit(";IMPRECISE")), F.lit(";"), F.lit("="))
    rows = table(spark, sf_dir, "events").select("event_id", info.alias("info"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.select("event_id", F.col("info")["SVTYPE"].alias("sv_type"), F.col("info")["END"].cast("long").alias("stop"), F.map_contains_key("info", "IMPRECISE").alias("imprecise"), "k")


def record_json(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pos"), F.col("o_orderstatus").alias("kind"))
    return rows.select("o_orderkey", F.to_json(F.struct("o_orderkey", "pos", "kind")).alias("line"))


SCRIPT = {"filters": [{"id": "good", "mapQuality": ">=30", "isProperPair": "true"}, {"id": "far", "insertSize": ">500"}, {"id": "odd", "reference": "chr1*"}], "rule": "(good | far) & !odd"}


def predicate_language(spark, sf_dir):
    rows = view(spark, sf_dir, "cigars").withColumn("mapq", (F.col("k4") % 61).cast("long"))
    return predicates.select(rows, SCRIPT).select(*ORDER, "flag", "isize", "rname")


def region_predicate(spark, sf_dir):
    rows = view(spark, sf_dir, "cigars")
    return rows.where(predicates.region("chr2:5000..chr2:90000")).select(*ORDER, "rname", "pos")


def sort_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") * 100).cast("long").alias("v"))
    return stats.unsorted(rows, ["user_id"], ["event_id"], "v")


def multi_key_sort(spark, sf_dir):
    """Sorted within types and chromosomes; the place is part of the row, so the order can be checked."""
    rows = windows(view(spark, sf_dir, "evidence"))
    place = F.row_number().over(Window.partitionBy("sv_type", "chrom_l", "chrom_r").orderBy("strand_l", "strand_r", "begin_l", "finish_l", "begin_r", "finish_r", *ORDER))
    return rows.select("sv_type", "chrom_l", "chrom_r", *ORDER, place.cast("long").alias("place"))


def genome_offset_lookup(spark, sf_dir):
    genome = table(spark, sf_dir, "nation").select(F.col("n_name").alias("chrom"), (F.col("n_nationkey") * 1000 + 5000).cast("long").alias("length"), F.col("n_nationkey").alias("ordinal"))
    offsets = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 425000).alias("at"))
    return overlap.on_genome(offsets, genome, "at")


def genome_bins(spark, sf_dir):
    return view(spark, sf_dir, "intervals_a").select("id", intervals.bin_number(F.col("start"), F.col("end")).alias("bin"))


def site_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("chrom"), (F.col("o_orderkey") % 13).alias("pos"), F.col("o_orderkey").alias("line"), "o_orderstatus")
    return merge.site_dedup(rows, ["chrom", "pos"], "line").select("chrom", "pos", "line", "o_orderstatus", "first_seen")


def _samples(spark, sf_dir) -> DataFrame:
    rows = windows(view(spark, sf_dir, "evidence"), 30).select("sv_type", "chrom_l", "chrom_r", F.col("begin_l").alias("start_l"), F.col("finish_l").alias("end_l"), F.col("begin_r").alias("start_r"), F.col("finish_r").alias("end_r"), *ORDER)
    return merge.sets(rows, ORDER)


def cross_sample_sets(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy(*merge.KEYS, "merged").agg(F.count("*").alias("n"), F.min("start_l").alias("start_l"), F.max("end_l").alias("end_l"), F.min("start_r").alias("start_r"), F.max("end_r").alias("end_r"))


def vcf_merge_sum(spark, sf_dir):
    found = clusterwise.by_position(clusterwise.summed(members(spark, sf_dir), KEYS, ORDER, _shape_at), "p", "p")
    return found.where("p > 0").withColumn("p", logspace.rounded(F.col("p"), 9))


def vcf_merge_product(spark, sf_dir):
    both = clusterwise.multiplied(members(spark, sf_dir), KEYS, ORDER, _shape_at)
    found = clusterwise.by_position(clusterwise.by_side(both, KEYS).drop("n_used"), "logps", "logp")
    return found.where(F.col("logp") > float("-inf")).withColumn("logp", logspace.rounded(F.col("logp"), 6))


def cnv_to_intervals(spark, sf_dir):
    rows = view(spark, sf_dir, "segments").where(F.abs("log2") >= 0.2)
    around = lambda c: (F.greatest(F.lit(1), F.col(c) - 500).cast("long"), (F.col(c) + 500).cast("long"))
    (a, b), (c, d) = around("start"), around("end")
    return rows.select("pid", "chrom", F.when(F.col("log2") < 0, "DEL").otherwise("DUP").alias("sv_type"), a.alias("start_l"), b.alias("end_l"), c.alias("start_r"), d.alias("end_r"))


def window_passes(spark, sf_dir):
    return passes.with_pass(view(spark, sf_dir, "evidence"), "start_r", 100_000).groupBy("chrom_r", "pass_k").agg(F.count("*").alias("n"), F.max("start_r").alias("last"))


def gap_sessions(spark, sf_dir):
    return passes.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("user_id", "session", "n", "seconds")


def coverage_by_hour(spark, sf_dir):
    return passes.tumbling(table(spark, sf_dir, "events"), "event_type", "ts", "1 hour").select("event_type", F.unix_timestamp("window_start").alias("start"), "n")


def interval_union_types(spark, sf_dir):
    """All sources as one evidence table, counted by source and type."""
    rows = windows(view(spark, sf_dir, "evidence"))
    pairs = evidence.aberrant_pairs(evidence.sane_pairs(rows.where("ev_type = 'PE'"), PAIRS), PAIRS).select("ev_type", "sv_type", "sample")
    split = evidence.split_intervals(evidence.sane_splits(rows.where("ev_type = 'SR'"), SPLITS), SPLITS).select("ev_type", "sv_type", "sample")
    given = evidence.given_intervals(rows.where("ev_type = 'BD'")).select("ev_type", "sv_type", "sample")
    return pairs.unionByName(split).unionByName(given).groupBy("ev_type", "sv_type", "sample").agg(F.count("*").alias("n"))


def call_pipeline(spark, sf_dir):
    """Evidence to typed calls: sane aberrant pairs, islands, support, thresholds, types and lengths."""
    rows = evidence.aberrant_pairs(evidence.sane_pairs(view(spark, sf_dir, "evidence"), PAIRS), PAIRS)
    own = cluster.islands(windows(rows))
    pos = own.groupBy(*KEYS).agg(F.floor(F.sum("end_l") / F.count("*")).cast("long").alias("pos_l"), F.floor(F.sum("start_r") / F.count("*")).cast("long").alias("pos_r"), *[F.count_if(F.col("ev_type") == t).alias(t) for t in calling.TYPES])
    kept = calling.passing(own, KEYS, 4, 2)
    found = calling.typed(pos.join(kept, KEYS).join(calling.strand_counts(own, KEYS), KEYS))
    return found.select(*KEYS, "pos_l", "pos_r", "reported", F.coalesce("sv_len", F.lit(0)).alias("sv_len"), "strands", "weight", *calling.TYPES)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_interval_pairs, split_interval_pairs, pair_sanity_filter, pair_aberrant_filter, source_routing, mate_pairing_toggle, split_pairing_gated, exclude_region_anti, overlap_join, overlap_semi,
        overlap_fraction_reciprocal, overlap_left_hits, count_hits, pair_to_pair_both, pair_to_pair_notboth, bnd_mate_stitch, interval_merge_gap50, genome_coverage_runs, coverage_summary, deep_regions, per_base_depth,
        island_cluster_lr, greedy_cluster, greedy_cluster_windowed, cluster_support_by_sample, strand_histogram, call_thresholds, curve_product, curve_mixture, curve_mode, curve_score, curve_trim, curve_ci95, log_space_algebra,
        insert_size_stats, insert_size_histogram, survival_curve, svtype_alt_strings, svlen_ci, cigar_query_offsets, cigar_ref_end, sa_split_filter, discordant_filter, block_expansion, flag_stats, library_orientation,
        column_summaries, value_frequencies, sequence_composition, reverse_complement, pattern_count, info_map_parse, record_json, predicate_language, region_predicate, sort_check, multi_key_sort, genome_offset_lookup,
        genome_bins, site_dedup, cross_sample_sets, vcf_merge_sum, vcf_merge_product, cnv_to_intervals, window_passes, gap_sessions, coverage_by_hour, interval_union_types, call_pipeline,
    )
}
