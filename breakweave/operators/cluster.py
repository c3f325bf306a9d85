"""Greedy clustering of interval pairs, in parallel and exactly.

The greedy rule works through evidence in order: an incoming pair that meets no live cluster starts one, one that meets
exactly one joins it (the cluster's intervals become the integer means of its members'), any other is discarded. A cluster
lies inside the hull of its members, so whatever an incoming pair can meet is in its own island of left intervals within
its own island of right intervals. Islands come from running windows; only islands with more than one member go through
the ordered replay, each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.operators.islands import island
from breakweave.operators.ordered import labelled

KEYS = ["chrom_l", "chrom_r", "sv_type"]
SIDES = ["begin_l", "finish_l", "begin_r", "finish_r"]


def window_pass(pos: int, window: int | None) -> int:
    """Number of the doubling window [0, w), [w, 2w), [2w, 4w) ... that a position is in."""
    return 0 if not window or pos < window else int(math.floor(math.log2(pos / window))) + 1


def replay(rows: list[tuple], window: int | None = None) -> list[int | None]:
    """The cluster (number of its first member) of each (begin_l, finish_l, begin_r, finish_r) in order; None if discarded."""
    live: dict[int, list] = {}
    out: list[int | None] = []
    now = 0
    for n, (bl, fl, br, fr) in enumerate(rows):
        later = window_pass(br, window)
        while now < later:
            # clusters whose right side begins before the window's end are called and leave
            edge = window * (1 << now)
            live = {k: c for k, c in live.items() if c[2] >= edge}
            now += 1
        met = [k for k, c in live.items() if min(c[3], fr) - max(c[2], br) >= 0 and bl < c[1] and fl > c[0]]
        if not met:
            live[n] = [bl, fl, br, fr, [(bl, fl, br, fr)]]
            out.append(n)
        elif len(met) == 1 and br < live[met[0]][3] and fr > live[met[0]][2]:
            own = live[met[0]]
            own[4].append((bl, fl, br, fr))
            own[:4] = [sum(m[k] for m in own[4]) // len(own[4]) for k in range(4)]
            out.append(met[0])
        else:
            out.append(None)
    return out


def islands(df: DataFrame) -> DataFrame:
    """Closed islands of right intervals, then of left ones within."""
    right = island(df, KEYS, "begin_r", "finish_r", "island_r")
    return island(right, [*KEYS, "island_r"], "begin_l", "finish_l", "island_l")


def cluster(df: DataFrame, order: list[str], window: int | None = None) -> DataFrame:
    """df with `cluster`, the order columns (joined by `:`) of its cluster's first member; null if discarded."""
    whole = [*KEYS, "island_r", "island_l"]
    label = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    found = islands(df).withColumn("__label", label).withColumn("__n", F.count("*").over(Window.partitionBy(*whole)))
    alone = found.where("__n = 1").withColumn("cluster", F.col("__label"))

    done = labelled(found.where("__n > 1"), whole, order, SIDES, "__label", "cluster", lambda rows: replay(rows, window)).unionByName(alone)
    return done.drop("island_l", "island_r", "__label", "__n")


def summed(clustered: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each cluster: members, weight, integer means of the intervals, counts by evidence type."""
    means = [F.floor(F.sum(c) / F.count("*")).cast("long").alias(c) for c in SIDES]
    return clustered.where("cluster is not null").groupBy(*KEYS, *(by or []), "cluster").agg(F.count("*").alias("n_evidence"), *means)
