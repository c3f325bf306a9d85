"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or neither on each text, or have nothing to judge. Expectation-maximisation over the
counts of all vote patterns (at most 4 to the number of labellers, whatever the input) estimates each labeller's accuracy
for either class and the share of good texts, and so a posterior for each pattern. A belief about labellers (BELIEF, of a
tenth of the texts' weight) anchors the classes; accuracies are free. The posteriors are the labels that train a logistic
scorer over hashed byte trigrams and hashed style cells. It is trained on a bounded sample: SAMPLE distinct rows, those with the
smallest hash of id and text. Every row is scored; a row is kept when its score is at least KEEP.

Defined results: a null or empty text gets no vote; with no text at all nothing is trained and every row scores 0.5 and is
kept; a null doc_id is carried; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import decoded, slices, stage, text_bytes

SAMPLE = 3_000
BUCKETS = 4_096
KEEP = 0.5
#: Fewer words than this say nothing about shares of words.
FEW = 8

#: name, and what is measured: a value under `good` votes good, one over `bad` votes bad
LABELLERS = [
    ("symbols", 0.10, 0.20),  # share of ASCII punctuation among the bytes that are not white space
    ("capitals", 0.25, 0.50),  # share of capitals among the ASCII letters
    ("shouts", 0.10, 0.30),  # share of words that end in an exclamation mark
    ("marks", 0.05, 0.15),  # share of words without a letter or digit
    ("repeats", 0.17, 0.30),  # share of the most frequent word
    ("lines", 0.10, 0.40),  # share of lines that came before
    ("endings", 0.25, 0.45),  # share of words that end in punctuation
    ("phrases", 0.10, 0.30),  # share of three-word runs that came before
    ("stutter", 0.05, 0.20),  # share of words that equal the word before
]


def measures(text: str) -> np.ndarray:
    """A value for each labeller; NaN where the text says nothing."""
    out = np.full(len(LABELLERS), np.nan)
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return out
    counts = np.bincount(data, minlength=256)
    ink = len(data) - counts[[9, 10, 11, 12, 13, 32]].sum()
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    if ink:
        out[0] = (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / ink
    if upper + lower:
        out[1] = upper / (upper + lower)
    words = text.split()
    if len(words) >= FEW:
        ends = Counter(w[-1] for w in words)
        out[2] = ends["!"] / len(words)
        seen = Counter(words)
        out[3] = sum(n for w, n in seen.items() if len(w) < 4 and not any(map(str.isalnum, w))) / len(words)
        out[4] = max(seen.values()) / len(words)
        out[6] = sum(n for c, n in ends.items() if not c.isalnum()) / len(words)
        out[8] = sum(map(str.__eq__, words, words[1:])) / len(words)
        out[7] = 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2)
    lines = [x for x in text.split("\n") if x]
    if len(lines) >= 3:
        out[5] = 1 - len(set(lines)) / len(lines)
    return out


#: What a labeller is believed to do before the data is seen: shares of bad, neutral and good votes on bad and on good texts;
#: and the weight of that belief, as a share of the texts. It says which class is which and binds no labeller.
BELIEF = np.array([[0.3, 0.2, 0.5], [0.0, 0.02, 0.98]])
BELIEF_WEIGHT = 0.1
#: How the votes -1, 0, 1 and 2 are written in a pattern.
VOTES = "-0+."
GOOD, BAD = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))


def votes(values: np.ndarray) -> np.ndarray:
    """1 for good, -1 for bad, 0 for neither, 2 where there is nothing to judge."""
    return np.where(np.isnan(values), 2, (values < GOOD).astype(np.int8) - (values > BAD))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(shares of the votes -1, 0 and 1 of each labeller on bad and on good texts, posterior of good for each pattern, share of good).

    It starts from the view that a text is good unless some labeller objects.
    """
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
    shares, prior = np.zeros((2, patterns.shape[1], 3)), 0.0
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior]) * counts
        # an imagined text of each class for each vote keeps every share above 0
        shares = np.einsum("cp,pjv->cjv", weight, cast) + 1
        shares += BELIEF_WEIGHT * weight.sum(axis=1)[:, None, None] * BELIEF[:, None, :]
        shares /= shares.sum(axis=2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        logs = np.einsum("pjv,cjv->cp", cast, np.log(shares))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -500, 500)))
    return shares, posterior, prior


def accuracies(shares: np.ndarray) -> np.ndarray:
    """(2, labellers): how often a vote is right on bad and on good texts."""
    return np.stack([shares[0, :, 0] / (shares[0, :, 0] + shares[0, :, 2]), shares[1, :, 2] / (shares[1, :, 0] + shares[1, :, 2])])


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed byte trigrams and style cells, each half of length 1."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    half = buckets // 2
    out = np.zeros(buckets, np.float32)
    if len(data) >= 3:
        grams = ((data[:-2] * np.uint32(2654435761)) ^ (data[1:-1] * np.uint32(40503)) ^ (data[2:] * np.uint32(69069))) >> np.uint32(7)
        counts = np.sqrt(np.bincount(grams % half, minlength=half))
        out[:half] = counts / np.linalg.norm(counts)
    values = measures(text)
    for k, v in enumerate(values):
        cell = 64 if np.isnan(v) else int(min(63, v * 64))
        out[half + (k * 65 + cell) * 7 % half] += len(values) ** -0.5
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 20.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer by full gradient steps; classes weigh alike. The last column of x is the constant."""
    share = np.array([(1 - y).sum(), y.sum()]).clip(1)
    weight = (y / share[1] + (1 - y) / share[0]) / 2
    w = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= (rate * (x.T @ ((p - y) * weight) + decay * w)).astype(np.float32)
    return w


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = text_bytes(df, id_col, text_col)
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))


def weak_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, float], dict[str, tuple[float, float]]]:
    """(rows h and pattern, posterior of each pattern, accuracies of each labeller on bad and on good texts)."""

    def run(batches):
        for part in slices(batches):
            texts = [decoded(x) for x in part.column(1).to_pylist()]
            patterns = ["".join(VOTES[v + 1] for v in votes(measures(x))) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(patterns, pa.string())], names=["h", "pattern"])

    voted = stage(_keyed(df, id_col, text_col).mapInArrow(run, "h long, pattern string"))
    found = voted.groupBy("pattern").count().orderBy("pattern").collect()
    if not found:
        return voted, {}, {}
    patterns = np.array([[VOTES.index(c) - 1 for c in r["pattern"]] for r in found])
    shares, posterior, _ = fit_labels(patterns, np.array([r["count"] for r in found], float))
    by_name = {name: (float(a), float(b)) for (name, _, _), a, b in zip(LABELLERS, *accuracies(shares), strict=True)}
    return voted, {r["pattern"]: float(p) for r, p in zip(found, posterior, strict=True)}, by_name


def classify(df: DataFrame, keep: float = KEEP, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row for each row of df: doc_id, score (probability of good), kept; or the columns `carry`, __score and __kept."""
    voted, posterior, _ = weak_labels(df, id_col, text_col)
    least = voted.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    weights = np.zeros(BUCKETS + 1, np.float32)
    if least is not None:

        def sampled(batches):
            for part in slices(batches):
                rows = [features(decoded(x)).astype("<f2").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(rows, pa.binary())], names=["h", "x"])

        chosen = _keyed(df, id_col, text_col).where(F.col("h") <= least).mapInArrow(sampled, "h long, x binary")
        labels = voted.where(F.col("h") <= least).groupBy("h").agg(F.min("pattern").alias("pattern"))
        rows = chosen.dropDuplicates(["h"]).join(labels, "h").orderBy("h")
        # one array on the driver, filled row by row; its last column is the constant
        x, y = np.ones((sample, BUCKETS + 1), np.float32), []
        for r in rows.coalesce(4).toLocalIterator():
            x[len(y), :-1] = np.frombuffer(r["x"], "<f2")
            y.append(posterior[r["pattern"]])
        if y:
            weights = train(x[: len(y)], np.array(y))
        del x
    passed = [F.col(id_col).cast("long").alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    mark = "" if carry is None else "__"
    schema = df.select(*passed, F.lit(0.0).alias(f"{mark}score"), F.lit(True).alias(f"{mark}kept")).schema

    def score(batches):
        for part in slices(batches):
            x = np.stack([features(decoded(t)) for t in part.column(part.num_columns - 1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip((x @ weights[:-1]).astype(np.float64) + float(weights[-1]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array(p >= keep)], names=schema.names)

    source = df.select(*passed, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("__text"))
    return source.mapInArrow(score, schema)


def kept(df: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that classify() keeps."""
    return classify(df, keep, id_col=id_col, text_col=text_col, carry=df.columns).where("__kept").drop("__score", "__kept")
