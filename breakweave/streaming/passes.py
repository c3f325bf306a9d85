"""Ordered evaluation over positions or time: doubling windows, sessions, tumbling windows, and a stateful clusterer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.operators.cluster import replay


def with_pass(df: DataFrame, pos: str, window: int) -> DataFrame:
    """df with `pass_k`: the window [0, w), [w, 2w), [2w, 4w) ... of its position."""
    n = F.floor(F.col(pos) / window).cast("long")
    # as many doublings as the quotient has binary digits
    return df.withColumn("pass_k", F.when(n <= 0, 0).otherwise(F.length(F.bin(n))).cast("long"))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, n, seconds) of runs without a gap of more than gap_seconds."""
    ordered = Window.partitionBy(key).orderBy("__t")
    timed = df.withColumn("__t", F.unix_timestamp(ts))
    opens = F.coalesce(F.col("__t") - F.lag("__t").over(ordered) > gap_seconds, F.lit(True))
    marked = timed.withColumn("__o", opens.cast("int")).withColumn("session", F.sum("__o").over(ordered).cast("long"))
    return marked.groupBy(key, "session").agg(F.count("*").alias("n"), (F.max("__t") - F.min("__t")).alias("seconds"))


def tumbling(df: DataFrame, key: str, ts: str, width: str, late: str | None = None) -> DataFrame:
    """Counts by window, on a table or (with `late`, the watermark) on a stream."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def sliding(df: DataFrame, key: str, ts: str, width: str, every: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.window(ts, width, every), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def clustered_stream(df: DataFrame, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Evidence on a stream (with event time `ts` and begin/finish of either side), clustered greedily by group.

    State holds a group's evidence that may still meet new evidence; every micro-batch replays it in event order and emits
    the running number of clusters and discarded rows.
    """
    names = ["begin_l", "finish_l", "begin_r", "finish_r"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        fresh = [[int(x) for x in row] for pdf in parts for row in pdf.sort_values("ts")[names].to_numpy()]
        rows = [*[held[k : k + 4] for k in range(0, len(held), 4)], *fresh]
        state.update(([x for row in rows for x in row],))
        found = replay([tuple(r) for r in rows])
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "clusters": [len({c for c in found if c is not None})], "discarded": [sum(c is None for c in found)]})

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(step, f"{schema}, clusters long, discarded long", "rows array<long>", "update", "NoTimeout")
