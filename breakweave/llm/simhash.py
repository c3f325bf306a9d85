"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints of SEGMENTS segments on a ring that differ in at most d bits have a start from which, for every length l,
the first l consecutive segments differ in at most floor(l * d / SEGMENTS) bits together. With 8 segments and d = 2 the
budgets are 0, 0, 0, 1, 1, 1, 1, 2: three equal segments, then four that differ in one bit at most, so the first two or
the last two of those are equal. That gives 16 keys of 40 bits a fingerprint, of which a linked pair shares at least one.
Pairs that share a key are pruned by the budgets of their chain before the full Hamming check.

A key that many fingerprints share leaves 24 bits free. Its members are not paired: each is dealt to the 25 points within
one free bit of it, members of one point differ in two bits at most, and all pairs within two bits meet in some point; so
a link from each member to the point's least member keeps every component whole. A point has at most 25 members.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null doc_id is carried and
never the smallest, so a component of null ids alone has a null component_id; repeated rows link to each other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import slices, stage, text_bytes
from breakweave.llm.components import components

SEGMENTS = 8
DISTANCE = 2
#: Fingerprints that share a key up to which they are paired directly.
PAIRED = 32


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """Of UTF-8 bytes; signed 64 bits."""
    found = data.lower().split()
    if not found:
        return 0
    if len(found) < words:
        spans = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1]
        spans = [joined[a:b] for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in spans], ">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(spans)).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches):
        for part in slices(batches):
            prints = [fingerprint(x or b"", words) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return text_bytes(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def rotated(bits: Column, segments: int) -> Column:
    by = 64 // SEGMENTS * segments
    return bits if not by else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def ring_keys(fp: Column) -> Column:
    """The 16 keys: four bits for start and half, then 40 bits of the fingerprint."""
    keys = []
    for start in range(SEGMENTS):
        ring = rotated(fp, start)
        head = F.shiftleft(F.shiftrightunsigned(ring, 40), 16)
        for half, by in enumerate((24, 8)):
            tail = F.shiftrightunsigned(ring, by).bitwiseAND(F.lit(0xFFFF).cast("long"))
            keys.append(head.bitwiseOR(tail).bitwiseOR(F.lit((2 * start + half) << 40).cast("long")))
    return F.array(*keys)


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(u, v) links between distinct fingerprints `fp` that connect exactly what pairs within two bits connect."""
    keyed = prints.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= paired)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key").where("u > v")
    # the chain's own budgets first, then the full check
    differ = "(u ^ v)"
    start = "cast(shiftrightunsigned(key, 41) as int) * 8"
    ring = f"(case when {start} = 0 then {differ} else shiftleft({differ}, {start}) | shiftrightunsigned({differ}, 64 - {start}) end)"
    chained = pairs.where(f"bit_count(shiftrightunsigned({ring}, 32)) <= 1 and bit_count(shiftrightunsigned({ring}, 8)) <= 1")
    near = chained.where(f"bit_count({differ}) <= {DISTANCE}").select("u", "v").distinct()
    return near.unionByName(_crowded(met.where(F.col("n") > paired)))


def _crowded(met: DataFrame) -> DataFrame:
    half = F.shiftrightunsigned("key", 40).bitwiseAND(F.lit(1).cast("long"))
    start = F.expr("cast(shiftrightunsigned(key, 41) as int) * 8")
    ring = F.expr("case when shift = 0 then fp else shiftleft(fp, shift) | shiftrightunsigned(fp, 64 - shift) end")
    free = {0: [*range(24)], 1: [*range(8), *range(24, 40)]}
    points = [F.array(F.col("ring"), *[F.col("ring").bitwiseXOR(F.lit(1 << b).cast("long")) for b in free[h]]) for h in (0, 1)]
    dealt = met.select("key", "fp", half.alias("half"), start.alias("shift")).withColumn("ring", ring)
    dealt = dealt.select("key", "fp", F.explode(F.when(F.col("half") == 0, points[0]).otherwise(points[1])).alias("point"))
    least = F.min("fp").over(Window.partitionBy("key", "point"))
    return dealt.select(F.col("fp").alias("u"), least.alias("v")).where("u > v").distinct()


def near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = stage(fingerprints(df, words, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    linked = roots.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(of_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
