"""Byte-level BPE by overlapping chunks.

A long text is cut into windows that overlap. Windows are rows, dealt to all tasks, and each is pre-tokenised on its own: it
gives the boundaries of its head (what it shares with the window before) and of its tail (what it shares with the next).
Two neighbours are stitched at the first boundary that both have: the pattern looks ahead by one character and never
behind, so from a common boundary on both windows split alike. Each window then encodes its own pieces from stitch to
stitch, again in parallel, and a text's ids are put together in order. Ids decode by concatenating their bytes.

A text of one window is encoded as it is. A text with two neighbours that share no boundary (a pre-token longer than the
overlap, or digits out of step) is stitched one window after another, with overlaps that widen until there is one.

Defined results: a null text is an empty one (no ids, no bytes); a null doc_id is carried as null; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import per_document, slices, stage, text_bytes

#: Characters of a window and of its overlap with the next.
WINDOW, OVERLAP = 1 << 14, 1 << 9
#: Distinct pre-tokens whose ids a worker remembers; it then starts afresh.
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    by_rank = ranks(path)
    table = [b""] * (max(by_rank.values(), default=-1) + 1)
    for token, rank in by_rank.items():
        table[rank] = token
    return table


def pre_tokens(text: str, pattern: regex.Pattern, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """Lists of pre-tokens that together are those of the whole text."""
    start = 0
    while len(text) - start > window + overlap:
        pieces, ends = _spans(text, pattern, start, start + window + overlap)
        wide = overlap
        while True:
            upto = start + window + wide
            if upto >= len(text):
                yield pattern.findall(text[start:])
                return
            # the last pre-token of a window may go on behind it, so its end is no boundary
            ours = ends[:-1]
            _, theirs = _spans(text, pattern, start + window, upto + overlap)
            common = np.intersect1d(ours[ours > start + window], theirs[:-1], assume_unique=True)
            if len(common):
                break
            wide *= 4
            pieces, ends = _spans(text, pattern, start, start + window + wide)
        stop = int(common[0])
        yield pieces[: int(np.searchsorted(ends, stop)) + 1]
        start = stop
    yield pattern.findall(text[start:]) if start else pattern.findall(text)


def _spans(text: str, pattern: regex.Pattern, start: int, stop: int) -> tuple[list[str], np.ndarray]:
    pieces = pattern.findall(text[start:stop])
    return pieces, start + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))


class PieceIds:
    """Ids (as bytes) of pre-tokens, remembered."""

    def __init__(self, path: str, pattern: str):
        self.library, self.known = encoding(path, pattern), {}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in set(pieces):
                if p not in known:
                    known[p] = np.array(self.library.encode_ordinary(p), np.int32).tobytes()
            return [known[p] for p in pieces]


def encoder(path: str, pattern: str, window: int = WINDOW, overlap: int = OVERLAP):
    """A function from a text to its ids, one window after another."""
    split, ids = regex.compile(pattern), PieceIds(path, pattern)

    def encode(text: str) -> np.ndarray:
        return np.frombuffer(b"".join([x for pieces in pre_tokens(text, split, window, overlap) for x in ids(pieces)]), np.int32)

    return encode


def boundaries(text: str, pattern: regex.Pattern, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pre-tokens in a window's head and, counted from the next window's start, in its tail."""
    # the last pre-token may go on behind the window, so its end is no boundary
    ends = np.cumsum(np.fromiter(map(len, pattern.findall(text)), np.int64))[:-1]
    return ends[ends <= overlap], ends[ends > window] - window


def between(text: str, start: int, stop: int | None, pattern: regex.Pattern) -> list[str]:
    """A window's pre-tokens between two of its boundaries, with what stands behind in view; without a stop, all from start on."""
    found = pattern.findall(text[start:])
    if stop is None:
        return found
    ends = np.cumsum(np.fromiter(map(len, found), np.int64))
    return found[: int(np.searchsorted(ends, stop - start)) + 1]


def _windows(df: DataFrame, window: int, overlap: int) -> DataFrame:
    """(row, doc_id, k, last, text): the windows of texts that have several."""

    def cut(batches):
        for part in slices(batches):
            for row, doc_id, data in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                n = -(-(len(data) - overlap) // window)
                for a in range(0, n, 64):
                    ks = range(a, min(n, a + 64))
                    pieces = [data[k * window : (k + 1) * window + overlap] for k in ks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(ks), pa.int64()), pa.array([doc_id] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array([k == n - 1 for k in ks]), pa.array(pieces, pa.string())],
                        names=["row", "doc_id", "k", "last", "text"],
                    )

    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # staged, so that rows keep their numbers if a task is run again
    return stage(rows.mapInArrow(cut, "row long, doc_id long, k int, last boolean, text string").repartition("row", "k"))


def _encode_long(df: DataFrame, path: str, pattern: str, window: int, overlap: int) -> DataFrame:
    windows = _windows(df, window, overlap)

    def mark(batches):
        split = regex.compile(pattern)
        for part in slices(batches):
            found = [boundaries(x, split, window, overlap) for x in part.column(3).to_pylist()]
            sides = [pa.array([x[side].astype(np.int32) for x in found], pa.list_(pa.int32())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *sides], names=["row", "k", "last", "head", "tail"])

    marked = windows.select("row", "k", "last", "text").mapInArrow(mark, "row long, k int, last boolean, head array<int>, tail array<int>")
    in_order = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))
    stitched = marked.select("row", "k", "last", common.alias("stop"))
    stitched = stage(stitched.select("row", "k", F.when(~F.col("last"), F.col("stop")).alias("stop"), "last", F.coalesce(F.lag("stop").over(in_order), F.lit(0)).alias("start")))
    apart = stitched.where("not last and stop is null").select("row").distinct()
    whole = stitched.join(apart, "row", "left_anti")

    def pieces(batches):
        split, ids = regex.compile(pattern), PieceIds(path, pattern)
        for part in slices(batches):
            out = []
            for text, start, stop in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                # from a common boundary on, this window splits like the text
                own = between(text, start, None if stop is None else window + stop, split)
                out.append(np.frombuffer(b"".join(ids(own)), np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["row", "doc_id", "k", "ids"])

    texts = windows.join(whole.select("row", "k", "start", "stop"), ["row", "k"]).select("row", "doc_id", "k", "text", "start", "stop")
    encoded = texts.mapInArrow(pieces, "row long, doc_id long, k int, ids array<int>")
    in_parts = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    own_part = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, window))
    rest = windows.join(apart, "row").select("row", "doc_id", "k", own_part.alias("text"))
    rest = rest.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("parts"))
    rest = rest.select("doc_id", F.array_join("parts.text", "").cast("binary").alias("text"))
    return in_parts.select("doc_id", F.flatten("parts.ids").alias("ids")).unionByName(_encode_each(rest, path, pattern, window, overlap))


def _encode_each(rows: DataFrame, path: str, pattern: str, window: int, overlap: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work():
        to_ids = encoder(path, pattern, window, overlap)

        def each(doc_id, text):
            ids = to_ids(text)
            return (doc_id, ids), ids.nbytes + 64

        return each

    return rows.mapInArrow(per_document(schema, work), "doc_id long, ids array<int>")


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of df, ids as the tiktoken library gives them for the whole text."""
    one = F.coalesce(F.length(text_col) <= window + overlap, F.lit(True))
    short = _encode_each(text_bytes(df.where(one), id_col, text_col), path, pattern, window, overlap)
    long = df.where(~one).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return short.unionByName(_encode_long(long, path, pattern, window, overlap))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded` (binary): the ids' bytes, concatenated. Null ids decode to no bytes."""
    names = df.columns
    schema = df.select("*", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches):
        table = np.array(byte_table(path), object)
        for part in slices(batches):
            column = part.column(names.index(ids_col))
            flat = np.asarray(column.flatten())
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array([len(x) if x.is_valid else 0 for x in column], np.int64)))]).astype(int)
            tokens = table[flat]
            texts = [b"".join(tokens[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def joined_ids(ids: Column) -> Column:
    """The decimal ids with a blank between two."""
    return F.array_join(ids.cast("array<string>"), " ")


__all__ = ["byte_table", "decode", "encode", "encoder", "encoding", "joined_ids", "pre_tokens", "ranks"]
