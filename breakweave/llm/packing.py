"""Harmonic packing of documents into fixed-size sequences.

Pieces belong to reciprocal-capacity classes: a piece of class m is at most capacity // m long and a bin of that class
takes exactly m of them. A document is cut into full sequences (class 1), then into halves, quarters and so on down to
pieces of 64, and what is left goes whole into the class with the largest m that still holds it. Only
these last pieces pad, by less than one slot step each.

Every worker numbers the pieces of its own bucket within a class; prefix sums over the small (class, bucket) counts make
the numbers global, so that at most one bin of a class stays unfilled. The pieces of those unfilled bins, fewer than the
sum of all m at any size of the input, are packed first-fit decreasing in one task.

Defined results: a null text is empty and has only its end id; a special token's text in a document has that token's id, as in
the tokenizer; a document without any id (no end id asked for, empty text)
has no piece; a null doc_id is carried as null; repeated rows are packed as often as they come; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from breakweave.llm.common import per_document, stage, text_bytes

#: Distinct words whose ids a worker remembers; it then starts afresh.
REMEMBERED = 1_000_000
END_OF_WORD = b"\xff"


def tail_classes(capacity: int, smallest: int) -> list[int]:
    """Classes for pieces shorter than `smallest`: each slot about four fifths of the one before."""
    classes, slot = [], smallest
    while slot >= 1:
        classes.append(capacity // slot)
        slot = min(slot - 1, slot * 4 // 5)
    return classes


def cut(total: int, capacity: int, smallest: int, tails: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of `total` ids."""
    out = [(at, capacity, 1) for at in range(0, total - total % capacity, capacity)]
    at, rest, half, cls = total - total % capacity, total % capacity, capacity // 2, 2
    while half >= smallest:
        if rest >= half:
            out.append((at, half, cls))
            at, rest = at + half, rest - half
        half, cls = half // 2, cls * 2
    if rest:
        out.append((at, rest, next(m for m in reversed(tails) if capacity // m >= rest)))
    return out


class WordIds(dict):
    """Ids (little-endian) of stretches of text between blanks and line feeds, encoded when first asked for.

    The tokenizer drops blanks and line feeds and joins nothing across them, so each stretch can be encoded alone. One of
    printable ASCII and precomposed Latin-1 characters is only lower-cased and split here; its parts are merged by the
    tokenizer's own ranks, the end of a word being one more byte that no UTF-8 text has. Any other goes to the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile(r"[!-~\xc0-\xff]+")
        as_byte = {c: bytes([b]) for b, c in _byte_characters().items()}
        suffix, special = spec["model"]["end_of_word_suffix"], {t["content"] for t in spec["added_tokens"]}
        #: Special tokens are taken out of the raw text, wherever they stand.
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                whole = token.endswith(suffix)
                ranks[b"".join(as_byte[c] for c in token.removesuffix(suffix)) + END_OF_WORD * whole] = rank
        self.merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if self.plain.fullmatch(word) and not (self.special and self.special.fullmatch(word)):
            found = b"".join([self.parts.get(p) or self._part(p) for p in self.split.findall(word.lower())])
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        found = self.parts[part] = array("I", self.merges._encode_single_piece(part.encode() + END_OF_WORD)).tobytes()
        return found


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def word_encoder(path: str, end_id: int | None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, then end_id."""
    known = WordIds(path)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def encode(text: str) -> np.ndarray:
        # a special token is a word of its own, which the tokenizer knows
        pieces = known.special.split(text) if known.special and known.special.search(text) else [text]
        found = []
        for k, piece in enumerate(pieces):
            found += [known[piece]] if k % 2 else [known[w] for w in piece.replace("\n", " ").split(" ")]
        found.append(end)
        return np.frombuffer(b"".join(found), "<u4")

    return encode


def pieces(df: DataFrame, path: str, end_id: int | None, capacity: int = 2048, smallest: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, cls, and ids (null unless asked for)."""
    tails = tail_classes(capacity, smallest)
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("cls", pa.list_(pa.int64())), ("ids_crc32", pa.list_(pa.int64())), ("ids", pa.list_(pa.binary()))])

    def work():
        encode = word_encoder(path, end_id)

        def each(doc_id, text):
            ids = encode(text)
            found = cut(len(ids), capacity, smallest, tails)
            data = [ids[a : a + n].tobytes() for a, n, _ in found]
            return (doc_id, len(ids), [a for a, _, _ in found], [n for _, n, _ in found], [m for _, _, m in found], [zlib.crc32(x) for x in data], data if with_ids else [None] * len(data)), ids.nbytes * with_ids + 40 * len(data) + 64

        return each

    packed = text_bytes(df, id_col, text_col).mapInArrow(per_document(schema, work), "doc_id long, doc_tokens long, start array<long>, length array<long>, cls array<long>, ids_crc32 array<long>, ids array<binary>")
    return packed.select("doc_id", "doc_tokens", F.inline(F.arrays_zip("start", "length", "cls", "ids_crc32", "ids")))


def first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """bin and offset for each row, longest first, each into the first bin with room."""
    room, bins, offsets = [], [], []
    rows = rows.sort_values(["length", "cls", "n"], ascending=[False, True, True])
    for length in rows["length"]:
        k = next((k for k, free in enumerate(room) if free >= length), len(room))
        if k == len(room):
            room.append(capacity)
        bins.append(k)
        offsets.append(capacity - room[k])
        room[k] -= length
    return rows.assign(bin=bins, at=offsets)


def assign(cut_pieces: DataFrame, capacity: int = 2048, smallest: int = 64) -> DataFrame:
    """cut_pieces (doc_id, start, length, ids_crc32, doc_tokens, cls) with sequence_id and offset. It is read more than once."""
    spark = cut_pieces.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["cls", "bucket"]
    dealt = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy(key).agg(F.count("*").alias("here"))
    by_class = Window.partitionBy("cls").orderBy("bucket")
    before = counts.select(
        *key,
        (F.sum("here").over(by_class) - F.col("here")).alias("before"),
        F.sum("here").over(Window.partitionBy("cls")).alias("in_class"),
    )
    per_class = counts.groupBy("cls").agg(F.expr("sum(here) div cls").alias("bins"))
    # a row for each class, a few dozen at any size
    base = per_class.select("cls", (F.sum("bins").over(Window.orderBy("cls")) - F.col("bins")).alias("base"), F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("all_bins"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens"))
    numbered = (
        dealt.withColumn("n", own - 1)
        .join(before, key)
        .join(F.broadcast(base), "cls")
        .withColumn("n", F.col("n") + F.col("before"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    in_full = F.col("n") < F.col("in_class") - F.col("in_class") % F.col("cls")
    full = numbered.where(in_full).withColumn("sequence_id", F.expr("base + n div cls"))
    # pieces above the smallest fill their slots; the shorter ones of a bin lie one after another, at most 2048 of them
    exact = full.where(F.col("cls") * smallest < capacity).withColumn("offset", (F.col("n") % F.col("cls") * F.col("length")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("n")
    short = full.where(F.col("cls") * smallest >= capacity).withColumn("offset", (F.sum("length").over(inside) - F.col("length")).cast("long"))

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        found = first_fit(rows, capacity)
        return found.assign(sequence_id=found["all_bins"] + found["bin"], offset=found["at"])[columns]

    rest = numbered.where(~in_full).select(*columns[:5], "cls", "n", "all_bins").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(last, ", ".join(f"{c} long" for c in columns))
    return exact.select(columns).unionByName(short.select(columns)).unionByName(rest)


def pack(df: DataFrame, path: str, end_id: int | None = 1, capacity: int = 2048, smallest: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian)."""
    found = pieces(df, path, end_id, capacity, smallest, id_col, text_col, with_ids)
    if not with_ids:
        return assign(stage(found.drop("ids")), capacity, smallest)
    found = stage(found)
    # a null id equals another
    key = [F.col("doc_id").eqNullSafe(F.col("__doc_id")), F.col("start") == F.col("__start"), F.col("ids_crc32") == F.col("__crc")]
    ids = found.select(F.col("doc_id").alias("__doc_id"), F.col("start").alias("__start"), F.col("ids_crc32").alias("__crc"), "ids").distinct()
    return assign(found, capacity, smallest).join(ids, key).drop("__doc_id", "__start", "__crc")
