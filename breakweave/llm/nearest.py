"""Largest inner products by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Inner products become distances by one more coordinate: with M the largest norm, x goes to (x, sqrt(M^2 - |x|^2)) and a
query to (q, 0), and then |x' - q'|^2 = |q|^2 + M^2 - 2 q.x. Vectors are projected to DIMS Gaussian (2-stable) directions, so
a projected squared distance over the true one is chi-square with DIMS degrees of freedom.

The splits of a kd-tree over the projections are fitted on a bounded sample (SAMPLE rows, those with the smallest hash);
every distinct vector is put into its leaf. A query first meets the leaf it falls into, which bounds its K-th distance; a
neighbour whose projected distance is beyond that bound times the CONFIDENCE quantile would stop the search, so it
then meets every leaf whose box comes nearer than that. In a leaf it takes the projected neighbours by cells of the tree,
nearest first, verifies them exactly and skips what the chi-square test already rules out against its own K-th distance.
Queries go to leaves in blocks of bounded size.

Equal vectors are searched once: of each only the K + 1 smallest ids can be among the K nearest of anything, ties going to
the smaller id, and a query that is one of them leaves itself out at the end.

Defined results: null vectors, zero vectors, vectors with a null or non-finite component and rows with a null id take no
part; a vector of another length than the most frequent (ties: the shorter) takes no part; with no valid row the result is
empty; repeated rows count once, and a query leaves out every row of its own id; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import stage

DIMS = 12
K = 20
CONFIDENCE = 0.97
SAMPLE = 20_000
LEAF_ROWS = 4_096
#: Projected neighbours that are verified at a time: a cell of the tree within a leaf.
CELL_ROWS = 256
#: Queries of a leaf that are handled at a time, and that are sent to a task.
BLOCK, QUERY_BLOCK = 512, 20_000


@lru_cache
def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection on the series of the regularised lower incomplete gamma function."""

    def below(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * dims + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(size: int, dims: int = DIMS, seed: int = 20) -> np.ndarray:
    """Gaussian directions for vectors of `size` components and the added one."""
    return np.random.default_rng(seed).standard_normal((size + 1, dims))


def lifted(x: np.ndarray, norm: float | None) -> np.ndarray:
    """x with the added coordinate; norm is None for queries."""
    extra = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))
    return np.concatenate([x, extra[:, None]], axis=1)


class Tree:
    """Splits of a kd-tree in a heap's order; a leaf's number is the path to it."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.dims = depth, points.shape[1]
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: points}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.at[node] = axis, at
            left = own[:, axis] < at
            parts[2 * node], parts[2 * node + 1] = own[left], own[~left]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)

    def near(self, point: np.ndarray, radius2: float) -> list[int]:
        """Leaves whose box comes within the radius, by descent; a box is known by the splits above it."""
        found, todo = [], [(1, np.zeros(self.dims))]
        while todo:
            node, gaps = todo.pop()
            if node >= 1 << self.depth:
                found.append(node - (1 << self.depth))
                continue
            axis, step = self.axis[node], point[self.axis[node]] - self.at[node]
            closer = 2 * node + (step >= 0)
            todo.append((closer, gaps))
            over = gaps.copy()
            over[axis] = max(over[axis], step * step)
            if over.sum() <= radius2:
                todo.append((closer ^ 1, over))
        return found


def cells(points: np.ndarray, rows: int = CELL_ROWS) -> list[np.ndarray]:
    """Row numbers of kd-tree cells of at most `rows` points, split at the median of the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        cut = np.argpartition(points[own, axis], len(own) // 2)
        todo += [own[cut[: len(own) // 2]], own[cut[len(own) // 2 :]]]
    return out


def search_leaf(base: np.ndarray, base_low: np.ndarray, queries: np.ndarray, queries_low: np.ndarray, k: int, norm: float, quantile: float, bound: np.ndarray, rows_per_cell: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of each query's k best in one leaf that reach its bound, -1 where it has fewer.

    Cells come nearest first. A query verifies a cell unless the chi-square test already holds for the nearest point that
    the cell's box could have.
    """
    parts = cells(base_low, rows_per_cell)
    low, high = (np.array([f(base_low[own], axis=0) for own in parts]) for f in (np.min, np.max))
    away = np.zeros((len(queries), len(parts)))
    for axis in range(base_low.shape[1]):
        at = queries_low[:, axis, None]
        away += np.maximum(0, np.maximum(low[None, :, axis] - at, at - high[None, :, axis])) ** 2
    constant = (queries**2).sum(axis=1) + norm * norm
    best = np.full((len(queries), k), -np.inf)
    rows = np.full((len(queries), k), -1, np.int64)
    for cell in np.argsort(away.mean(axis=0)):
        worst = constant - 2 * np.maximum(best.min(axis=1), bound)
        alive = np.nonzero(away[:, cell] <= quantile * np.maximum(worst, 0))[0]
        if not len(alive):
            continue
        own = parts[cell]
        exact = queries[alive] @ base[own].T
        better = (exact > best[alive].min(axis=1)[:, None]).any(axis=1)
        alive, exact = alive[better], exact[better]
        both = np.concatenate([best[alive], exact], axis=1)
        which = np.concatenate([rows[alive], np.broadcast_to(own, (len(alive), len(own)))], axis=1)
        top = np.argpartition(-both, k - 1, axis=1)[:, :k]
        best[alive], rows[alive] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
    rows[best < bound[:, None]] = -1
    return rows, best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(whole)


def search(df: DataFrame, every: int = 20, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = valid(df, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return empty
    size = size[0]["n"]
    rows = rows.where(F.size("vector") == size).withColumn("vkey", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))
    # equal vectors: the smallest ids; k + 1 of them are all that any answer can hold
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    base = stage(ranked.groupBy("vkey").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids")))
    asked = stage(rows.where(F.col("vec_id") % every == 0).select("vkey", F.col("vec_id").alias("query_id")).distinct())
    count, norm = base.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    plane = directions(size, dims)
    quantile = chi_square_quantile(confidence, dims)
    seen = base.select("vector", F.xxhash64("vkey").alias("h")).orderBy("h").limit(sample).select("vector").toPandas()
    depth = max(0, math.ceil(math.log2(max(1, count / leaf_rows))))
    tree = Tree(lifted(_matrix(seen["vector"]), norm) @ plane, depth)

    def place(batches):
        for pdf in batches:
            low = lifted(_matrix(pdf["vector"]), norm) @ plane if len(pdf) else np.zeros((0, dims))
            yield pdf.assign(leaf=tree.leaves(low))

    def asks(batches):
        for pdf in batches:
            low = lifted(_matrix(pdf["vector"]), None) @ plane if len(pdf) else np.zeros((0, dims))
            yield pdf.assign(leaf=tree.leaves(low), bound=-np.inf)

    def spread(batches):
        for pdf in batches:
            x = _matrix(pdf["vector"])
            if not len(pdf):
                continue
            low = lifted(x, None) @ plane
            radius2 = quantile * np.maximum(0, (x * x).sum(axis=1) + norm * norm - 2 * pdf["bound"].to_numpy())
            own = tree.leaves(low)
            at = [[leaf for leaf in tree.near(p, r) if leaf != home] for p, r, home in zip(low, radius2, own, strict=True)]
            yield pdf.assign(leaf=at).explode("leaf").dropna(subset=["leaf"]).astype({"leaf": "int64"})

    def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        x, parts = _matrix(left["vector"]), []
        x_low, keys, qkeys = lifted(x, norm) @ plane, left["vkey"].to_numpy(), right["vkey"].to_numpy()
        for at in range(0, len(right), BLOCK):
            q = _matrix(right["vector"].iloc[at : at + BLOCK])
            found, _ = search_leaf(x, x_low, q, lifted(q, None) @ plane, k + 1, norm, quantile, right["bound"].to_numpy()[at : at + BLOCK])
            which, nth = np.nonzero(found >= 0)
            row = found[which, nth]
            # one order of summation for every pair, so that equal pairs score alike
            parts.append(pd.DataFrame({"qkey": qkeys[at + which], "vkey": keys[row], "score": (q[which] * x[row]).sum(axis=1)}))
        out = pd.concat(parts)
        return out if len(out) else pd.DataFrame()

    vectors = "vkey string, vector array<double>, leaf long"
    placed = base.select("vkey", "vector").mapInPandas(place, vectors)
    queries = base.select("vkey", "vector").join(asked.select("vkey").distinct(), "vkey")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    found_schema = "qkey string, vkey string, score double"
    first = stage(placed.groupBy("leaf").cogroup(queries.mapInPandas(asks, vectors + ", bound double").groupBy("leaf")).applyInPandas(answer, found_schema))
    # the K-th best so far; with equal vectors it is at least this good
    bounds = first.groupBy("qkey").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("qkey").alias("vkey"), F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf")).alias("bound"))
    wider = queries.join(bounds, "vkey", "left").select("vkey", "vector", F.lit(0).cast("long").alias("leaf"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    asking = wider.mapInPandas(spread, vectors + ", bound double").withColumn("block", F.pmod(F.xxhash64("vkey"), F.lit(blocks)))
    asked_of = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    second = asked_of.groupBy("leaf", "block").cogroup(asking.groupBy("leaf", "block")).applyInPandas(answer, found_schema)
    # k + 1 distinct vectors hold k rows besides the query's own
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), F.col("ids")[0])
    merged = first.unionByName(second).join(base.select("vkey", "ids"), "vkey")
    listed = stage(merged.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select(F.col("qkey").alias("vkey"), "score", F.explode("ids").alias("vec_id")))
    last = Window.partitionBy("vkey").orderBy(F.desc("score"), "vec_id")
    top = listed.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= k + 1).select("vkey", "score", "vec_id", "nth")
    # of its own copies a query passes over itself, wherever it stands among the k + 1
    answers = asked.join(top, "vkey").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "vkey").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
