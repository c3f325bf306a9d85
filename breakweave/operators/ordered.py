"""Ordered work on many small groups without a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], label: str, name: str, work: Callable[[list[tuple]], list[int | None]]) -> DataFrame:
    """df with `name`: work() takes a group's `inputs` in order and says for each row whose `label` it gets (None: null).

    Groups are dealt by their keys and sorted within partitions, and batches stream through; only the rows of the group at
    a batch's end are held back.
    """
    schema = df.withColumn(name, F.lit(None).cast("string")).schema

    def done(pdf: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        rows, labels, out = list(pdf[inputs].itertuples(index=False, name=None)), pdf[label].tolist(), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out += [None if k is None else labels[a + k] for k in work(rows[a:b])]
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True)
            opens = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            starts = np.nonzero(opens)[0].tolist()
            last = starts[-1]
            if last:
                yield done(pdf.iloc[:last], starts)
            held = [pdf.iloc[last:]]
        if held:
            rest = held[0].reset_index(drop=True)
            yield done(rest, [0, len(rest)])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
