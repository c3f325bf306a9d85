"""Language-model scores by logistic context mixing.

A text is its tokens (white-space separated words, A-Z lower-cased) and one end. mixing.py says how tokens become binary
events, which predictors each event has, how gated weights mix their log-odds, how an adaptive map refines the mixture, and
how all of these move online within a text.

All learning texts count, in sums that are merged block by block: how often each word came; how often each symbol of the
alphabet came after each frequent word; how often repeats went on; and, once for each word, what followed after its letters.
The alphabet is the most frequent words (at most ALPHABET, each seen twice or more); any other word is spelled. The weights
that a text starts with are Newton steps on the gradient and curvature of these counts, so all learning texts and words have
their part in them; a sighting is left out of the counts that predict it. Tables have a size that alphabet, classes and slots set, whatever the
input; the word counts grow with it and stay in a table, which the base score joins.

A text's own state starts afresh after PART_BYTES, so that memory is bounded; a single word takes memory in its own proportion.

Defined results: a null or empty text is its end alone; a null doc_id is learnt from and carried; repeated rows are learnt
from as often as they come, and equal texts score alike; other columns are not read. Without learning texts, every event is
even but for what a text teaches itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm import mixing
from breakweave.llm.common import slices, sparing, stage, text_bytes

#: Most words of the alphabet, and frequent words that serve as contexts.
ALPHABET, CLASSES = 1 << 16, 128
#: Most words whose counts are broadcast for the base score; all others are joined.
COMMON = 1 << 18
#: Bytes of the texts that are worked on together, and after which a text's own state starts afresh.
BATCH_BYTES, PART_BYTES = 512 << 10, 2 << 20
#: What a text's own state counts for in these.
TEXT_BYTES = 1 << 10
#: Words that are spelled together; most texts, and about how many of their bytes, whose words are counted together.
SPELLED, COUNTED_ROWS, COUNTED_BYTES = 4_000, 10_000, 24 << 20
#: Cells of the blocks in which sums travel.
BLOCK = 1 << 14
END = b" "
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The tokens, END last, in lists of about PART_BYTES at most."""
    at = 0
    while len(text) - at > PART_BYTES and (gap := _SPACE.search(text, at + PART_BYTES)):
        yield text[at : gap.start()].lower().split()
        at = gap.start()
    yield [*text[at:].lower().split(), END]


def batched(batches) -> Iterator[tuple[list, list[int], list[list[bytes]]]]:
    """(doc_ids, document of each part, parts) of documents of about BATCH_BYTES together."""
    ids, of, found, size = [], [], [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py() or b""
            for tokens in parts(data):
                of.append(len(ids))
                found.append(tokens)
            ids.append(doc_id.as_py())
            size += len(data) + TEXT_BYTES
            if size >= BATCH_BYTES:
                yield ids, of, found
                ids, of, found, size = [], [], [], 0
    if ids:
        yield ids, of, found


def together(batches) -> Iterator[list[pa.Array]]:
    """Texts of several batches, of at most about COUNTED_ROWS rows and COUNTED_BYTES."""
    held, rows, size = [], 0, 0
    for batch in slices(batches, COUNTED_ROWS, COUNTED_BYTES):
        texts = pc.fill_null(batch.column(1), b"")
        many = pc.sum(pc.binary_length(texts)).as_py() or 0
        if held and (rows + len(texts) > COUNTED_ROWS or size + many > COUNTED_BYTES):
            yield held
            held, rows, size = [], 0, 0
        held.append(texts)
        rows, size = rows + len(texts), size + many
    if held:
        yield held


def count_words(batches) -> Iterator[pa.RecordBatch]:
    """How often each token came in some of the texts; a word may come out several times."""
    for texts in together(batches):
        # bytes that need not be UTF-8: these functions look at ASCII alone
        words = [pc.ascii_split_whitespace(pc.ascii_lower(x.view(pa.string()))).flatten() for x in texts]
        counts = pc.value_counts(pa.chunked_array(words))
        words, n = counts.field("values").view(pa.binary()), counts.field("counts")
        some = pc.greater(pc.binary_length(words), 0)
        yield pa.RecordBatch.from_arrays([words.filter(some), n.filter(some)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([sum(map(len, texts))], pa.int64())], names=["word", "n"])


def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's sums that are not all zero."""
    pack = zstandard.ZstdCompressor(level=1)
    found = [(k, pack.compress(own.astype("<u4").tobytes())) for k in range(0, len(counts), BLOCK) if (own := counts[k : k + BLOCK]).any()]
    for a in range(0, len(found), 64):
        keys, packed = zip(*found[a : a + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "block"])


def merge(batches) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of each key; a task holds one block of each of its keys."""
    total: dict[int, np.ndarray] = {}
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(unpack.decompress(block.as_py()), "<u4")
            total[key] = total[key] + counts if key in total else counts.astype("<u8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([pack.compress(x.tobytes()) for x in total.values()], pa.binary())], names=["key", "block"])


def summed(df: DataFrame, work, size: int, kind: type = np.int64) -> np.ndarray:
    """The sums over all rows of df of what work(counts, batches) adds to counts."""

    def run(batches):
        counts = np.zeros(size, np.uint32)
        work(counts, batches)
        yield from blocks(counts)

    out, unpack = np.zeros(size, kind), zstandard.ZstdDecompressor()
    for row in df.mapInArrow(run, "key long, block binary").repartition("key").mapInArrow(merge, "key long, block binary").toLocalIterator():
        own = np.frombuffer(unpack.decompress(row["block"]), "<u8")
        out[row["key"] : row["key"] + len(own)] = own
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def most_frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words that came more often than some bound, at most `most` of them, the most frequent first."""
    step = F.floor(16 * F.log2("n"))
    total, bound = 0, 0
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > most:
            bound = row["step"] + 1
            break
    found = words.where(step >= bound).toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def vocabulary(words: DataFrame, alphabet: int, common: int) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """(id of each word of the alphabet, how often each common word came)."""
    found = most_frequent(words, common)
    times = dict(found)
    if END not in times:  # always in the alphabet
        times[END] = sum(r["n"] for r in words.where(F.col("word") == F.lit(END)).collect())
    twice = [w for w, n in found if n > 1 and w != END]
    # of words that came as often as the first one left out, none is in
    edge = times[twice[alphabet - 1]] if len(twice) >= alphabet else 1
    own = sorted([*(w for w in twice if times[w] > edge), END], key=lambda w: (-times[w], w))
    return {w: k for k, w in enumerate(own)}, times


def learnt(learning: DataFrame, words: DataFrame, ids: dict[bytes, int]) -> mixing.Model:
    """The model of all learning texts and of their counted words; ids: of the alphabet."""
    size = len(ids)
    sc = learning.sparkSession.sparkContext
    shared = sc.broadcast(ids)

    def each(batches):
        for batch in batches:
            found, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(found), SPELLED):
                yield found[a : a + SPELLED], times[a : a + SPELLED]

    def in_texts(counts, batches):
        for _, _, found in batched(batches):
            mixing.add_situations(counts, found, shared.value, CLASSES)

    def letters(counts, batches):
        for found, _ in each(batches):
            counts += mixing.letter_frequencies([w for w in found if w != END]).astype(np.uint32)

    model = mixing.Model(size, CLASSES, summed(learning, in_texts, mixing.situations(size, CLASSES)))
    tree = mixing.Tree(summed(words, letters, 256))

    shape = (mixing.ORDERS, 1 << mixing.SLOT_BITS, 2)

    def spelling(counts, batches):
        own = counts.reshape(shape)
        for found, _ in each(batches):
            mixing.add_letters(own, tree, [w for w in found if w != END])

    counts = summed(words, spelling, math.prod(shape), np.uint32).reshape(shape)
    start = mixing.starting_weights(mixing.ORDERS)
    given = sc.broadcast((tree, counts))

    def slopes(batches):
        tree, counts = given.value
        slope, bend = np.zeros(start.shape), np.zeros((*start.shape, start.shape[1]))
        for found, times in each(batches):
            far = [k for k, w in enumerate(found) if w not in shared.value]
            if far:
                own = mixing.newton_sums(start, mixing.letter_events(tree, counts, [found[k] for k in far], times[far]))
                slope, bend = slope + own[0], bend + own[1]
        flat = np.concatenate([slope.ravel(), bend.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "x"])

    flat = np.zeros(start.size * (start.shape[1] + 1))
    for row in words.mapInArrow(slopes, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        flat[row["k"]] = row["x"]
    weights = mixing.newton_step(start, flat[: start.size].reshape(start.shape), flat[start.size :].reshape(*start.shape, -1), start)
    given.destroy()
    model.with_letters(tree, counts, weights)
    return model


SCORED = "row long, doc_id long, n_tokens long, bytes long, bits double, known long, base double, rare array<binary>, times array<long>"


def score_batches(model: mixing.Model, known: dict[bytes, int], times: np.ndarray, batches) -> Iterator[pa.RecordBatch]:
    """known: numbers of the common words, as mixing.flattened() takes them; times: how often each came; any other word of a text goes into `rare`."""
    size = model.other
    # spelled words are judged below
    seen, far_seen = np.append(times[:size], 0), times[size:]
    logs, far_logs = np.log10(seen + 1.0), np.log10(far_seen + 1.0)
    row = TaskContext.get().partitionId() << 33
    for doc_ids, of, found in batched(batches):
        flat = model.flat(found, known)
        of, n = np.array(of), len(doc_ids)
        bits = np.bincount(of, model.costs(flat), n)
        own = np.repeat(of, flat["sizes"])
        base = np.bincount(own, logs[flat["symbol"]], n)
        n_known = np.bincount(own, seen[flat["symbol"]] > 0, n)
        n_tokens = np.bincount(own, minlength=n)
        bytes_ = np.bincount(of, [sum(map(len, x)) + len(x) for x in found], n)
        # each spelled word of a document once
        far = flat["far"]
        key, at, many = np.unique(own[far] << 32 | flat["word"][far], return_index=True, return_counts=True)
        doc, word = key >> 32, key & 0xFFFFFFFF
        met = word < len(far_seen)
        base += np.bincount(doc[met], many[met] * far_logs[word[met]], n)
        n_known += np.bincount(doc[met], many[met] * (far_seen[word[met]] > 0), n)
        rare = pa.array(map(flat["tokens"].__getitem__, far[at[~met]].tolist()), pa.binary())
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~met], minlength=n))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (rare, pa.array(many[~met], pa.int64()))]
        columns = [np.arange(row, row + n), pa.array(doc_ids, pa.int64()), n_tokens, bytes_.astype(np.int64), bits, n_known.astype(np.int64), base, *lists]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in SCORED.split(", ")])
        row += n


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alphabet: int = ALPHABET, common: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): a row for each row of df."""
    spark = df.sparkSession
    learning = text_bytes(df.where(~held_out(F.col(id_col))), id_col, text_col)
    with sparing(spark):
        words = stage(learning.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
        n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        ids, times = vocabulary(words, alphabet, common)
        known = ids | {w: len(ids) + 1 + k for k, w in enumerate(w for w in times if w not in ids)}
        ready = spark.sparkContext.broadcast((learnt(learning, words, ids), known, np.array([times[w] for w in known], np.int64)))
        scored = stage(text_bytes(df, id_col, text_col), work=lambda batches: score_batches(*ready.value, batches), schema=SCORED)
        ready.unpersist()
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base"))
    zero = F.lit(0.0)
    return scored.join(found, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("bits") * -math.log10(2)).alias("score"),
        (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
