"""Curves of whole clusters, worked out in arrays.

All members of a cluster come to one task, once, as intervals. There their curves are laid out, summed or multiplied, many
clusters together, and what leaves is a cluster's curve as an array: no place of a member's curve becomes a row or is shuffled.
Batches stream through; only the members of the cluster at a batch's end are held back, and of a crowded cluster about
PLACES places of its members are laid out at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("l", "r")
PLACES = 1 << 21
#: The log-probabilities behind an interval's begin, from offsets and the clip.
Shape = Callable[[np.ndarray, int], np.ndarray]


class Members:
    """The members of some clusters: `of`, the number of each one's cluster (in order), and begin, finish and clip by side."""

    def __init__(self, table: pa.Table, of: np.ndarray):
        self.of, self.n = of, int(of[-1]) + 1
        self.begin, self.finish, self.clip = ({s: table.column(f"{c}_{s}").to_numpy() for s in SIDES} for c in ("begin", "finish", "clip"))
        self.there = {s: self.finish[s] >= self.begin[s] for s in SIDES}
        order = np.lexsort((member := table.column("__member").to_numpy(), of))
        again = (of[order][1:] == of[order][:-1]) & (member[order][1:] == member[order][:-1])
        #: members that come more than once in their cluster
        self.twice = np.zeros(len(of), bool)
        self.twice[order[1:][again]] = self.twice[order[:-1][again]] = True

    def each(self, who: np.ndarray, values: np.ndarray, least: bool) -> np.ndarray:
        """The least or the largest value of each cluster that has members in `who` (others: 0)."""
        out, of = np.zeros(self.n, np.int64), self.of[who]
        if len(who):
            starts = _starts(of)
            out[of[starts]] = (np.minimum if least else np.maximum).reduceat(values[who], starts)
        return out


class Curves:
    """Curves of the members `who` on a side; those of one width and clip are made once. Each starts at `start` in `log` and `p`."""

    def __init__(self, members: Members, side: str, who: np.ndarray, shape: Shape, normal: bool):
        width, clip = (members.finish[side] - members.begin[side] + 1)[who], members.clip[side][who]
        top = int(clip.max(initial=0)) + 1
        kinds, kind = np.unique(width * top + clip, return_inverse=True)
        made = [np.asarray(shape(np.arange(k // top), k % top), float) for k in kinds.tolist()]
        if normal:
            made = [x - x.max() - np.log(np.exp(x - x.max()).sum()) for x in made]
        self.width, self.start = width, np.cumsum([0, *map(len, made)])[kind]
        log = np.concatenate([np.zeros(0), *made])
        self.p = np.exp(log)
        self.log = log if normal else np.where(self.p > 0, log, -np.inf)


def _starts(of: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, `size` of them."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _summed(total: int, at: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of size values of the table from start on, laid out from `at` on."""
    out, ends, a = np.zeros(total), np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, side="right")))
        out += np.bincount(_spread(at[a:b], size[a:b]), table[_spread(start[a:b], size[a:b])], minlength=total)
        a = b
    return out


class Hull:
    """The places that members `who` of each cluster have on a side, in runs: of (cluster), first, base (where it lies), size."""

    def __init__(self, members: Members, side: str, who: np.ndarray):
        of, begin, finish = members.of[who], members.begin[side][who], members.finish[side][who]
        order = np.lexsort((begin, of))
        span, low = int(finish.max() - begin.min()) + 3, int(begin.min())
        b, f = ((x[order] - low) + of[order] * span for x in (begin, finish))
        opens = np.concatenate([[True], b[1:] > np.maximum.accumulate(f)[:-1] + 1])
        heads, run = np.nonzero(opens)[0], np.cumsum(opens) - 1
        self.size = np.maximum.reduceat(f, heads) - b[heads] + 1
        self.base = np.cumsum(self.size) - self.size
        self.total, self.of, self.first = int(self.size.sum()), of[order][heads], begin[order][heads]
        #: where each member lies
        self.at = np.empty(len(who), np.int64)
        self.at[order] = self.base[run] + b - b[heads][run]
        self.clusters = _starts(self.of)

    def whole(self, values: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
        """ufunc over each cluster's places, at each place."""
        starts = self.base[self.clusters]
        return np.repeat(ufunc.reduceat(values, starts), np.diff([*starts, self.total]))

    def modes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The clusters and the first position of the largest value of each."""
        best = np.where(values == self.whole(values, np.maximum), np.arange(self.total), self.total)
        at = np.minimum.reduceat(best, self.base[self.clusters])
        run = np.searchsorted(self.base, at, side="right") - 1
        return self.of[self.clusters], self.first[run] + at - self.base[run]


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(values))


def _products(members: Members, used: dict[str, np.ndarray], shape: Shape, normal: bool) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """For each cluster the product of the curves of the members `used`, over what they all have; those that are used on one side are on both."""
    columns, of = [], None
    for s in SIDES:
        who = np.nonzero(used[s])[0]
        if not len(who):
            return
        curves, starts = Curves(members, s, who, shape, normal), _starts(members.of[who])
        of, times = members.of[who][starts], np.diff([*starts, len(who)])
        a = np.maximum.reduceat(members.begin[s][who], starts)
        size = np.minimum.reduceat(members.finish[s][who], starts) - a + 1
        base = np.cumsum(size) - size
        own = lambda x: np.repeat(x, times)  # noqa: B023, E731
        logs = _summed(int(size.sum()), own(base), curves.log, curves.start + own(a) - members.begin[s][who], own(size))
        logs -= np.repeat(np.maximum.reduceat(logs, base), size)
        logs -= np.repeat(np.log(np.add.reduceat(np.exp(logs), base)), size)
        columns += [pa.array(a), pa.array(times), _listed(logs, size)]
    yield of, columns


#: Of _products(): a cluster's curves on both sides.
BOTH = ", ".join(f"first_{s} long, n_used_{s} long, logps_{s} array<double>" for s in SIDES)


def _product_or_mode(shape: Shape):
    def work(members: Members) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        of, meets = members.of, np.ones(members.n, bool)
        for s in SIDES:
            who = np.nonzero(members.there[s])[0]
            meets &= members.each(who, members.begin[s], False) < members.each(who, members.finish[s], True)
            meets &= np.bincount(of[who], minlength=members.n) > 0
        covering = ~meets[of] & ~members.twice
        for s in SIDES:
            who = np.nonzero(~meets[of] & members.there[s])[0]
            mode, known = np.zeros(members.n, np.int64), np.zeros(members.n, bool)
            if len(who):
                curves, hull = Curves(members, s, who, shape, True), Hull(members, s, who)
                sums = _summed(hull.total, hull.at, curves.p, curves.start, curves.width)
                with np.errstate(divide="ignore"):
                    logs = np.log(sums)
                if not sums.all():  # where all members are too small for a double the largest stands for the sum
                    most = np.full(hull.total, -np.inf)
                    np.maximum.at(most, _spread(hull.at, curves.width), curves.log[_spread(curves.start, curves.width)])
                    logs = np.where(sums > 0, logs, most)
                found, at = hull.modes(np.round(logs, 9))
                mode[found], known[found] = at, True
            covering &= members.there[s] & known[of] & (members.begin[s] <= mode[of]) & (mode[of] <= members.finish[s])
        yield from _products(members, {s: members.there[s] & meets[of] | covering for s in SIDES}, shape, True)

    return work


def _sums(members: Members, side: str, shape: Shape) -> tuple[Curves, Hull, np.ndarray, np.ndarray] | None:
    """Curves that are not normalised, their hull and their sums, made to sum to 1 in each cluster."""
    who = np.nonzero(members.there[side])[0]
    if not len(who):
        return None
    curves, hull = Curves(members, side, who, shape, False), Hull(members, side, who)
    sums = _summed(hull.total, hull.at, curves.p, curves.start, curves.width)
    return curves, hull, sums / hull.whole(sums, np.add), who


def _summed_curves(shape: Shape):
    def work(members: Members) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for s in SIDES:
            if found := _sums(members, s, shape):
                _, hull, sums, _ = found
                yield hull.of, [pa.array([s] * len(hull.of)), pa.array(hull.first), _listed(sums, hull.size)]

    return work


def _multiplied_curves(shape: Shape):
    def work(members: Members) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        of = members.of
        counted = members.there["l"] | members.there["r"]
        good = np.bincount(of[counted & members.twice], minlength=members.n) == 0
        for s in SIDES:
            hit = np.zeros(len(of), bool)
            if found := _sums(members, s, shape):
                curves, hull, sums, who = found
                mode = np.zeros(members.n, np.int64)
                clusters, at = hull.modes(np.round(sums, 12))
                mode[clusters] = at
                over = mode[of[who]] - members.begin[s][who]
                inside = (over >= 0) & (over < curves.width)
                hit[who] = inside & (curves.p[curves.start + np.where(inside, over, 0)] > 0)
            good &= np.bincount(of[counted & ~hit], minlength=members.n) == 0
        yield from _products(members, {s: counted & good[of] for s in SIDES}, shape, False)

    return work


def _whole_clusters(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole clusters, whose members come one after another, and the number of each row's cluster."""
    held: list[pa.Table] = []

    def opens(table: pa.Table) -> np.ndarray:
        codes = [table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
        return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])

    def numbered() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held).combine_chunks()
        return table, np.cumsum(opens(table)) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        joined = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]) if held else table
        last = int(np.nonzero(opens(joined))[0][-1]) - bool(held)
        if last > 0 or last == 0 and held:
            held.append(table.slice(0, last))
            yield numbered()
            held = [table.slice(last)]
        else:
            held.append(table)
    if held:
        yield numbered()


def _by_cluster(rows: DataFrame, keys: list[str], member: list[str], work, columns: str) -> DataFrame:
    """(keys, columns): what work() gives for the clusters of a batch, by their numbers."""
    begin, clip = ({s: F.coalesce(F.col(f"{c}_{s}").cast("long"), F.lit(0).cast("long")) for s in SIDES} for c in ("begin", "clip"))
    finish = {s: F.coalesce(F.when(F.col(f"begin_{s}").isNotNull(), F.col(f"finish_{s}").cast("long")), begin[s] - 1) for s in SIDES}
    intervals = [of[s].alias(f"{c}_{s}") for c, of in (("begin", begin), ("finish", finish), ("clip", clip)) for s in SIDES]
    dealt = rows.select(*keys, *intervals, F.xxhash64(*member).alias("__member"))
    schema = T.StructType(dealt.select(*keys).schema.fields + T.StructType.fromDDL(columns).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, of in _whole_clusters(batches, keys):
            heads = _starts(of)
            for found, arrays in work(Members(table, of)):
                own = [pc.take(table.column(k).combine_chunks(), pa.array(heads[found])) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=schema.names)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def product_or_mode(rows: DataFrame, keys: list[str], member: list[str], shape: Shape) -> DataFrame:
    """(keys, BOTH) of members with an interval on each side: the product of their curves over a cluster's common interval or,
    where its members have none of more than a base on either side, of those members alone that cover the modes of the
    mixture on both sides. A cluster whose modes no single member covers has no row. `member` names a cluster's members: one that
    comes more than once does not stand in.
    """
    return _by_cluster(rows, keys, member, _product_or_mode(shape), BOTH)


def multiplied(rows: DataFrame, keys: list[str], member: list[str], shape: Shape) -> DataFrame:
    """(keys, BOTH): normalised products, of the clusters whose members are all non-zero at both modes of the sum; places where
    one is zero are minus infinity."""
    return _by_cluster(rows, keys, member, _multiplied_curves(shape), BOTH)


def summed(rows: DataFrame, keys: list[str], member: list[str], shape: Shape) -> DataFrame:
    """(keys, side, first, p: array): members' probabilities summed over each run of places and made to sum to 1 on a side."""
    return _by_cluster(rows, keys, member, _summed_curves(shape), "side string, first long, p array<double>")


def by_side(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, first, n_used, logps) of BOTH."""
    sides = [F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in ("first", "n_used", "logps")]) for s in SIDES]
    return both.select(*keys, F.inline(F.array(*sides)))


def by_position(arrays: DataFrame, values: str, name: str) -> DataFrame:
    """A row (pos, name) for each of the values, the first of which stands at `first`."""
    rest = [c for c in arrays.columns if c not in ("first", values)]
    return arrays.select(*rest, "first", F.posexplode(values).alias("__k", name)).select(*rest, (F.col("first") + F.col("__k")).alias("pos"), name)


def modes(sides: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """curves.modes() of by_side()."""
    values = F.transform("logps", lambda x: F.rint(x * 10.0**digits))
    at = sides.withColumn("__v", values).withColumn("mode", F.col("first") + F.array_position("__v", F.array_max("__v")) - 1)
    return at.select(*keys, "side", "mode", F.array_max("logps").alias("max_logp"), "first", F.size("logps").cast("long").alias("size"))


def scores(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): the largest probability over the width, summed over both sides."""
    of = [F.exp(F.array_max(f"logps_{s}")) / F.size(f"logps_{s}") for s in SIDES]
    return both.select(*keys, (of[0] + of[1]).alias("score"))
