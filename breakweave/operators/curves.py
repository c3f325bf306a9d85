"""Probability curves over positions, as rows (cluster, side, pos, logp)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.functions.logspace import to_p
from breakweave.functions.rows import once

EDGE = 1e-4


def pair_curve(back: int, histogram: list[float]) -> list[float]:
    """Log-probabilities behind a read's end: rising over `back` bases, then the share of inserts at least that long."""
    rate = -math.log(EDGE) / back
    survival = np.cumsum(np.asarray(histogram, float)[::-1])[::-1]
    values = np.concatenate([np.exp(-rate * (back - np.arange(back))), survival])
    zeros = np.nonzero(values <= 0)[0]
    return np.log(values[: zeros[0]] if len(zeros) else values).tolist()


def split_curve(back: int) -> list[float]:
    rate = -math.log(EDGE) / back
    return [-rate * abs(j - back) for j in range(2 * back + 1)]


def even_curve(size: int) -> list[float]:
    return [-math.log(size)] * size


def two_sided_at(offset: np.ndarray, clip: int, back: int) -> np.ndarray:
    """two_sided() at offsets from an interval's begin."""
    return math.log(EDGE) / back * np.abs(offset + clip - back)


def two_sided(begin: Column, pos: Column, clip: Column, back: int) -> Column:
    """split_curve() as an expression."""
    return -F.lit(-math.log(EDGE) / back) * F.abs(pos - begin + clip - back)


def sided(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, begin, finish, clip): a row for either interval."""
    sides = [F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in ("begin", "finish", "clip")]) for s in "lr"]
    return df.select(*keys, F.inline(F.array(*sides))).where("finish >= begin")


def with_curves(rows: DataFrame, shape: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """rows with `logps`, the normalised curve of the interval as an array, made without a shuffle.

    shape gives the log-probability from an interval's begin, a position and the clip.
    """
    raw = rows.select("*", once(__raw=F.transform(F.sequence("begin", "finish"), lambda pos: shape(F.col("begin"), pos, F.col("clip")))))
    top = raw.select("*", once(__top=F.array_max("__raw")))
    whole = top.select("*", once(__log=F.col("__top") + F.log(F.aggregate("__raw", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))))
    return whole.select(*rows.columns, F.transform("__raw", lambda x: x - F.col("__log")).alias("logps"))


def by_position(rows: DataFrame, first: str = "begin") -> DataFrame:
    """with_curves() as rows (..., pos, logp)."""
    rest = [c for c in rows.columns if c not in ("begin", "finish", "clip", "logps", first)]
    return rows.select(*rest, F.col(first).alias("__first"), F.posexplode("logps").alias("__k", "logp")).select(*rest, (F.col("__first") + F.col("__k")).alias("pos"), "logp")


def padded(arrays: DataFrame, share: float, fixed: int, floor: float = 1e-100) -> DataFrame:
    """Curves (first, p) with max(share of the distance between their ends, fixed) places of `floor` on either side, cut at
    0 and made to sum to 1."""
    size = F.greatest(F.lit(share) * (F.size("p") - 1), F.lit(float(fixed))).cast("int")
    wide = arrays.withColumn("__n", size).withColumn("__p", F.concat(F.array_repeat(F.lit(floor), F.col("__n")), "p", F.array_repeat(F.lit(floor), F.col("__n"))))
    over = F.greatest(F.lit(0), F.col("__n") - F.col("first")).cast("int")
    cut = wide.withColumn("p", F.slice("__p", over + 1, F.size("__p"))).withColumn("first", F.greatest(F.lit(0), F.col("first") - F.col("__n")).cast("long"))
    whole = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return cut.withColumn("__sum", whole).withColumn("p", F.transform("p", lambda x: x / F.col("__sum"))).drop("__n", "__p", "__sum")


def shared_mass(first_a: Column, a: Column, first_b: Column, b: Column) -> Column:
    """Sum of the smaller of two curves' values over the places that both have; 0 if there are none."""
    start, stop = F.greatest(first_a, first_b), F.least(first_a + F.size(a), first_b + F.size(b))
    n = F.greatest(F.lit(0), stop - start).cast("int")
    cut = lambda v, first: F.slice(v, F.when(n > 0, start - first + 1).otherwise(1).cast("int"), n)
    return F.aggregate(F.zip_with(cut(a, first_a), cut(b, first_b), lambda x, y: F.least(x, y)), F.lit(0.0), lambda t, x: t + x)


def pair_curves(evidence: DataFrame, sources: DataFrame, key: str = "ev_id") -> DataFrame:
    """(evidence's columns, side, pos, logp): the curve of each side's strand out of its source's curve.

    sources has a row (key, curve: array of log-probabilities behind a read's end) for each source of evidence. A curve runs
    onwards from a + side and backwards, mirrored, from a - side; `clip` places are cut from its start where an interval was
    cut, and it ends with the interval.
    """
    found = evidence.join(sources.select(key, "curve"), key)
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"begin_{s}").alias("begin"), F.col(f"finish_{s}").alias("finish"), F.col(f"clip_{s}").alias("clip"), F.col(f"strand_{s}").alias("strand")) for s in "lr"]
    each = found.withColumn("s", F.explode(F.array(*sides)))
    curve = F.when(F.col("s.strand") == "-", F.reverse("curve")).otherwise(F.col("curve"))
    size = F.greatest(F.lit(0), F.col("s.finish") - F.col("s.begin") + 1).cast("int")
    placed = each.select(*evidence.columns, F.col("s.side").alias("side"), F.col("s.begin").alias("__b"), F.posexplode(F.slice(curve, F.col("s.clip").cast("int") + 1, size)).alias("__k", "logp"))
    return placed.select(*evidence.columns, "side", (F.col("__b") + F.col("__k")).alias("pos"), "logp")


def mixture(curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, pos, logp): the log of the members' summed probabilities, over the hull. Plain sums, so that they combine
    before the shuffle; where all members are too small for a double the largest stands for the sum."""
    summed = curves.groupBy(*keys, "side", "pos").agg(F.max("logp").alias("__top"), F.sum(F.exp("logp")).alias("__sum"))
    return summed.select(*keys, "side", "pos", F.when(F.col("__sum") > 0, F.log("__sum")).otherwise(F.col("__top")).alias("logp"))


def modes(curve: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """The first position of the largest value (values equal to `digits` places tie)."""
    best = F.struct(F.round("logp", digits).alias("v"), (-F.col("pos")).alias("p"))
    return curve.groupBy(*keys, "side").agg((-F.max(best)["p"]).alias("mode"), F.max("logp").alias("max_logp"), F.min("pos").alias("first"), F.count("*").alias("size"))


def as_arrays(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, first, p): the curve as an array of probabilities from its first position on."""
    item = F.array_sort(F.collect_list(F.struct("pos", "logp")))
    return curve.groupBy(*keys, "side").agg(item.alias("v")).select(*keys, "side", F.col("v")[0]["pos"].alias("first"), F.transform("v", lambda x: to_p(x["logp"])).alias("p"))


def _grown(p: str, mode: str, upto: float, step: str) -> Column:
    """Fold the growth step over as many rounds as the array has places."""
    return F.expr(
        f"aggregate(sequence(1, size({p})), named_struct('l', {mode}, 'r', {mode}, 't', element_at({p}, {mode} + 1)), (a, k) -> case when (a.l = 0 and a.r = size({p}) - 1) or a.t >= {upto!r}D then a {step.format(p=p)} end)"
    )


def trimmed(arrays: DataFrame, threshold: float) -> DataFrame:
    """start and stop around the mode that hold at least 1 - threshold: grown to the left where its value at the left end
    exceeds the next one on the right, else to the right; the last grown base is not reported."""
    at = F.array_position("p", F.array_max("p")).cast("int") - 1
    left = "named_struct('l', a.l - 1, 'r', a.r, 't', a.t + element_at({p}, a.l))"
    right = "named_struct('l', a.l, 'r', a.r + 1, 't', a.t + element_at({p}, a.r + 2))"
    step = f"when a.l = 0 then {right} when a.r = size({{p}}) - 1 then {left} when element_at({{p}}, a.l + 1) > element_at({{p}}, a.r + 2) then {left} else {right}"
    grown = arrays.withColumn("mode", at).withColumn("g", _grown("p", "mode", 1 - threshold, step))
    r = F.when(F.col("g.l") == F.col("g.r"), F.col("g.r") + 1).otherwise(F.col("g.r"))
    return grown.select(*[c for c in arrays.columns if c != "p"], "mode", (F.col("first") + F.col("g.l")).alias("start"), (F.col("first") + r - 1).alias("stop"))


def interval95(arrays: DataFrame, share: float = 0.95) -> DataFrame:
    """Offsets from the mode that hold `share`: grown to the larger neighbour, to both if they are equal."""
    at = F.array_position("p", F.array_max("p")).cast("int") - 1
    left = "named_struct('l', a.l - 1, 'r', a.r, 't', a.t + element_at({p}, a.l))"
    right = "named_struct('l', a.l, 'r', a.r + 1, 't', a.t + element_at({p}, a.r + 2))"
    both = "named_struct('l', a.l - 1, 'r', a.r + 1, 't', a.t + element_at({p}, a.l) + element_at({p}, a.r + 2))"
    step = (
        f"when a.l = 0 then {right} when a.r = size({{p}}) - 1 then {left} when element_at({{p}}, a.l) = element_at({{p}}, a.r + 2) then {both} "
        f"when element_at({{p}}, a.l) > element_at({{p}}, a.r + 2) then {left} else {right}"
    )
    grown = arrays.withColumn("mode", at).withColumn("g", _grown("p", "mode", share, step))
    return grown.select(*[c for c in arrays.columns if c != "p"], "mode", (F.col("g.l") - F.col("mode")).alias("low"), (F.col("g.r") - F.col("mode")).alias("high"))
