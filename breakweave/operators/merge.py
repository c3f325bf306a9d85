"""Merging calls across samples.

Calls of one type and chromosome pair form islands of left and then right intervals. Within an island the deepest set of
calls that all overlap on both sides is taken out again and again; clusterwise.py sums the curves of each set position by
position, or multiplies them where every member is non-zero at both modes of the sum.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.operators.islands import two_level
from breakweave.operators.ordered import labelled

KEYS = ["sv_type", "chrom_l", "chrom_r"]


def _sweep(rows: list[tuple[int, int, int]]) -> list[list[int]]:
    """States of a sweep over closed (start, end, number): the numbers that are open after each start, by their ends."""
    heap: list[tuple[int, int]] = []
    states = []
    for start, end, n in sorted(rows, key=lambda r: r[0]):
        while heap and heap[0][0] < start:
            heapq.heappop(heap)
        heapq.heappush(heap, (end, n))
        states.append([k for _, k in heap])
    return states


def deepest_sets(rows: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Partition (start_l, end_l, start_r, end_r) rows into mutually overlapping sets, the largest (first found) first."""
    left = set(range(len(rows)))
    out = []
    while left:
        best: list[int] = []
        for state in _sweep([(rows[k][0], rows[k][1], k) for k in sorted(left)]):
            for inner in _sweep([(rows[k][2], rows[k][3], k) for k in state]):
                if len(inner) > len(best):
                    best = inner
        out.append(best)
        left -= set(best)
    return out


def maximal_cliques(links: dict[int, set[int]]) -> list[set[int]]:
    """Of an undirected graph, with pivots."""
    out = []

    def grow(own: set[int], maybe: set[int], done: set[int]) -> None:
        if not maybe and not done:
            out.append(own)
            return
        pivot = max(maybe | done, key=lambda v: (len(links[v] & maybe), -v))
        for v in sorted(maybe - links[pivot]):
            grow(own | {v}, maybe & links[v], done & links[v])
            maybe = maybe - {v}
            done = done | {v}

    grow(set(), set(links), set())
    return sorted(out, key=sorted)


def sets(calls: DataFrame, order: list[str]) -> DataFrame:
    """calls with `merged`, the order columns (joined by `:`) of the first member of their set."""
    found = two_level(calls, KEYS, ("start_l", "end_l"), ("start_r", "end_r")).withColumn("__label", F.concat_ws(":", *[F.col(c).cast("string") for c in order]))

    def work(rows: list[tuple]) -> list[int]:
        out = [0] * len(rows)
        for own in deepest_sets(rows):
            for k in own:
                out[k] = min(own)
        return out

    done = labelled(found, [*KEYS, "island_l", "island_r"], ["start_l", *order], ["start_l", "end_l", "start_r", "end_r"], "__label", "merged", work)
    return done.drop("island_l", "island_r", "__label")


def symmetric95(p: list[float], mode: int, share: float = 0.95) -> tuple[int, int]:
    """Grow by one to either side at a time until the share is reached."""
    low = high = mode
    total = p[mode]
    while total < share and (low > 0 or high < len(p) - 1):
        if low > 0:
            low -= 1
            total += p[low]
        if high < len(p) - 1:
            high += 1
            total += p[high]
    return low, high


def site_dedup(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last line of each site, with the place `first_seen` where the site came up first."""
    row = F.struct(*[c for c in lines.columns if c not in key])
    return lines.groupBy(*key).agg(F.max_by(row, order).alias("r"), F.min(order).alias("first_seen")).select(*key, "r.*", "first_seen")
