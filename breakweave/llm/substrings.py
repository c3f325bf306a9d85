"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text (each byte shifts it left by one and adds its entry of a fixed table; 16 bits of
it are used, so it forgets after 16 bytes). A chunk ends where five of those bits are zero, at least MIN_CHUNK and at most
MAX_CHUNK bytes after the last end and never within a character. Ends depend on content alone, so an insertion moves the
chunks around it and leaves the others as they are. Chunks are compared by their 128-bit digests over the whole corpus.
A chunk is repeated if several documents have it; it stays in the one with the smallest doc_id, however often it has it.
Neighbouring repeated chunks join to spans; spans of at least `min_bytes` count.

Defined results: a null or empty text has no chunks; a null doc_id sorts after all others; rows that repeat an id, or have
none, are one document to each other and lose only what documents before them have; other columns are not read by spans() and are kept by dedup(). A
byte run without any end (one repeated character) is cut every MAX_CHUNK bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakweave.llm.common import slices, stage

MIN_CHUNK, MAX_CHUNK = 24, 256
#: The bits of the gear hash that are zero at a chunk's end; 32 bytes lie between two such places on average.
END_MASK = 0xF800
#: About fifteen words: enough of a passage of fifty, whose first and last chunk are mixed with what surrounds it.
MIN_BYTES = 96
#: A row of random bits for each byte value.
GEAR = np.random.default_rng(1).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window."""
    h = gear[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_ends(text: bytes, gear: np.ndarray, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> list[int]:
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, np.uint8)
    ends, last = [], 0
    # a place is an end only if the next byte starts a character
    marked = (gear_hash(data, gear)[:-1] & np.uint16(END_MASK)) == 0
    marked &= (data[1:] & 0xC0) != 0x80
    for place in [*(np.nonzero(marked)[0] + 1).tolist(), n]:
        while place - last > high:
            last += high
            while last < n and data[last] & 0xC0 == 0x80:
                last += 1
            ends.append(last)
        if place - last >= low or (place == n and last < n):
            ends.append(place)
            last = place
    return ends


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(more, ord, uid, text): the id with nulls last, and a key of id and text."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1).cast("long"))
    return df.select(*more, ord_.alias("ord"), F.xxhash64(F.col(id_col).cast("long"), text).alias("uid"), text.alias("text"))


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, uid, pos int, len int, hi long, lo long): a row for each chunk."""
    gear = GEAR

    def run(batches):
        for part in slices(batches):
            ords, uids = part.column(0).to_numpy(), part.column(1).to_numpy()
            counts, starts, sizes, digests = [], [], [], []
            for text in part.column(2).to_pylist():
                ends = chunk_ends(text, gear)
                at = [0, *ends[:-1]] if ends else []
                counts.append(len(ends))
                starts += at
                sizes += [b - a for a, b in zip(at, ends, strict=True)]
                digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(at, ends, strict=True)]
            words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [np.repeat(ords, counts), np.repeat(uids, counts), np.array(starts, np.int32), np.array(sizes, np.int32), words[:, 0].copy(), words[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ord", "uid", "pos", "len", "hi", "lo"])

    return keyed(df, id_col, text_col).mapInArrow(run, "ord long, uid long, pos int, len int, hi long, lo long")


def spans(df: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, uid, start, stop, first_ord, kept): runs of repeated chunks, in bytes. kept: the run is the first occurrence."""
    found = stage(chunks(df, id_col, text_col))
    repeated = found.groupBy("hi", "lo").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).where("first_ord <> last_ord").drop("last_ord")
    met = found.join(repeated, ["hi", "lo"]).select("ord", "uid", "pos", "len", "first_ord", (F.col("ord") == F.col("first_ord")).alias("kept"))
    # rows that repeat id and text give the same chunks again
    met = met.groupBy("ord", "uid", "pos").agg(F.min("len").alias("len"), F.min("first_ord").alias("first_ord"), F.min("kept").alias("kept"))
    doc = Window.partitionBy("ord", "uid").orderBy("pos")
    before = F.lag(F.struct((F.col("pos") + F.col("len")).alias("stop"), "kept")).over(doc)
    opens = F.coalesce(before != F.struct(F.col("pos").alias("stop"), "kept"), F.lit(True))
    runs = met.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(doc))
    return (
        runs.groupBy("ord", "uid", "run")
        .agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("stop"), F.min("first_ord").alias("first_ord"), F.first("kept").alias("kept"))
        .where(F.col("stop") - F.col("start") >= min_bytes)
        .drop("run")
    )


def named(found: DataFrame) -> DataFrame:
    """spans() with doc_id and first_doc_id in place of the sorting ids."""
    last = F.lit((1 << 63) - 1)
    ids = [F.when(F.col(c) != last, F.col(c)).alias(n) for c, n in (("ord", "doc_id"), ("first_ord", "first_doc_id"))]
    return found.select(ids[0], F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), ids[1], "kept")


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the spans. A span gives way to the word that it starts or ends in, and keeps no double blank."""
    out, at = [], 0
    for start, stop in cuts:
        while start < stop and start and not text[start - 1 : start].isspace():
            start += 1
        while stop > start and stop < len(text) and not text[stop : stop + 1].isspace() and not text[stop - 1 : stop].isspace():
            stop -= 1
        out.append(text[at:start])
        at = max(at, stop)
    return b"".join([*out, text[at:]])


def dedup(df: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with all spans cut from its texts that are not first occurrences; length_col gets the new length in characters."""
    cuts = (
        spans(df, min_bytes, id_col, text_col)
        .where("not kept")
        .groupBy("ord", "uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
        .select(F.col("ord").alias("__ord"), F.col("uid").alias("__uid"), "__cuts")
    )
    names = df.columns
    rows = df.withColumns(
        {
            "__ord": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1).cast("long")),
            "__uid": F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))),
        }
    )
    joined = rows.join(cuts, ["__ord", "__uid"], "left").select(*names, "__cuts")
    schema = T.StructType(df.schema.fields)

    def cut(batches):
        for part in slices(batches):
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            texts, lengths = columns[text_col].to_pylist(), columns[length_col].to_pylist() if length_col else None
            for k, found in enumerate(columns["__cuts"].to_pylist()):
                if found:
                    texts[k] = without(texts[k].encode(), [(x["start"], x["stop"]) for x in found]).decode()
                    if lengths:
                        lengths[k] = len(texts[k])
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if lengths:
                columns[length_col] = pa.array(lengths, columns[length_col].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.mapInArrow(cut, schema)
