"""Near-copies by SimHash fingerprints and by prefix filtering on five-word shingles with an exact check.

Two texts are near-copies if their sets of WORDS-word shingles have a Jaccard similarity of at least SIMILARITY. Links are
sought between distinct texts, as copies of one text are found by their digest. With `fingerprints`, texts whose SimHash
fingerprints are linked (simhash.py: pigeonring, two bits) are near-copies too; these links come first, and what they
connect is not held against each other again.

Candidates are complete: in whatever order shingles stand, two sets of n and m shingles with a similarity of at least s
share at least s * max(n, m) of them, so the first n - ceil(s * n) + 1 of the one and the first m - ceil(s * m) + 1 of the
other have one in common. Each text gives these first shingles as its keys. The order is that of frequency in a sample of
the texts, rare ones first, then of the hash. What the sample holds has no bearing on the result, only on how many texts share
a key.

A pair is judged only where its first common key leaves room for enough common shingles behind it (both texts' keys stand in
the one order, so their places say how many), where the sizes allow the similarity, and where parity sketches do: two sets
differ in at least as many shingles as their sketches in bits. A text has a short sketch, which goes with each of its keys,
and one with a bit or more for each shingle, so that long texts are told apart without being read. First, each member of a
key is held against the key's least; then, members of a key that are not yet in one component are held against each other,
one pair in SHARE before the others. So every two members are compared, connected or ruled out by places, sizes or sketches.

Keys are worked on in slices of about SLICE_KEYS and pairs in slices of PAIRS and TEXT_PAIRS, whatever the input, and what a
slice staged goes with it: disks hold the texts' keys, those that are shared, and the work of one slice.

Defined results: null and empty texts are copies of each other; texts of fewer words than a shingle have one shingle, all
their words; a null doc_id is carried and never a group's smallest; repeated rows are copies.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm import simhash
from breakweave.llm.common import scratch, slices, sparing, stage
from breakweave.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: About how many rows the order of shingles is taken from, how many of them have a shingle that counts as frequent, and
#: how many shingles do, which bounds the broadcast.
ORDER_ROWS, OFTEN, OFTEN_MOST = 20_000, 3, 1 << 18
#: One in so many pairs of members that are still apart is judged before the others.
SHARE = 16
#: 64-bit words of a text's short sketch.
SKETCH = 8
#: About how many keys are dealt at a time, and pairs that are held against each other by long sketches and by texts.
SLICE_KEYS, PAIRS, TEXT_PAIRS = 1 << 23, 1 << 20, 1 << 17
#: For comparisons of rounded numbers.
SLACK = 1e-9


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    found = data.lower().split()
    spans = [found] if len(found) < words else zip(*(found[k:] for k in range(words)), strict=False)
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(x)) for x in spans], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(own: np.ndarray, often: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """As many of a text's sorted shingles as need to be keys, those first that are not in `often` (sorted), then by `times`."""
    size = len(own) - math.ceil(similarity * len(own) - SLACK) + 1
    if not len(often):
        return own[:size]
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    return own[np.lexsort((own, np.where(often[at] == own, times[at], 0)))[:size]]


def sketch(own: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity bits: of the shingles, one bit each is flipped. Two sketches differ in at most as many bits as the sets do in shingles."""
    bits = np.bincount((own % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def long_words(n: int) -> int:
    """Words of the long sketch of n shingles: a power of two with a bit or more for each, and no less than the short one."""
    return max(SKETCH, 1 << max(0, math.ceil(n / 64) - 1).bit_length())


def listed(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, how often) of those that several of a sample of texts have."""
    every = max(1, rows.count() // ORDER_ROWS)

    def hashed(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, words) for x in part.column(0).to_pylist()]).view(np.int64))], names=["key"])

    sample = rows.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).dropDuplicates(["node"]).select("text")
    counted = sample.mapInArrow(hashed, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "key").limit(OFTEN_MOST).toArrow()
    keys, times = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, fingerprints: bool = False) -> DataFrame:
    """(digest, least, grp): each distinct text by its digest, its smallest id, and what stands for its group."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))

    order = df.sparkSession.sparkContext.broadcast(frequent(rows, words))

    def prints(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            found = [shingles(x, words) for x in texts]
            keys = [prefix(x, *order.value, similarity).tobytes() for x in found]
            fps = [simhash.fingerprint(x) if fingerprints else None for x in texts]
            long = [sketch(x, n) if (n := long_words(len(x))) > SKETCH else np.zeros(0, np.int64) for x in found]
            columns = [pa.array(keys, pa.binary()), pa.array([len(x) for x in found], pa.int32()), listed([sketch(x) for x in found]), listed(long), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["node", "keys", "size", "sketch", "long", "fp"])

    printed = rows.select("node", "text").mapInArrow(prints, "node long, keys binary, size int, sketch array<long>, long array<long>, fp long")
    printed = stage(printed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("keys", "size", "sketch", "long", "fp")]))
    roots = _roots(printed, rows, words, similarity, _fingerprinted(printed) if fingerprints else None)
    linked = roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    # the texts themselves stay where they are: copies meet by digest and id alone
    distinct = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("least"), F.min("node").alias("node"))
    grouped = distinct.join(linked, "node", "left")
    return grouped.select("digest", "least", F.coalesce(F.col("root").cast("string"), "digest").alias("grp"))


def _fingerprinted(printed: DataFrame) -> DataFrame:
    """(u, v) links that connect all texts whose fingerprints are equal or linked."""
    with scratch(printed.sparkSession):
        first = stage(printed.groupBy("fp").agg(F.min("node").alias("least")))
        equal = printed.join(first, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        near = simhash.links(first.select("fp"))
        for c in "uv":
            near = near.join(first.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")), c)
        return stage(equal.unionByName(near.select(F.col("least_u").alias("u"), F.col("least_v").alias("v"))), lasting=True)


def _dealt(k: int, slices_of: int):
    """A row for each key of a text in slice k; at: how many shingles the text has, and below them in 32 bits the key's place."""

    def run(batches):
        for part in slices(batches):
            found = [np.frombuffer(x, "<u8") for x in part.column(1).to_pylist()]
            counts = [len(x) for x in found]
            keys, place = np.concatenate(found), np.concatenate([np.arange(n) for n in counts])
            columns = [np.repeat(part.column(0).to_numpy(), counts), np.repeat(part.column(2).to_numpy().astype(np.int64) << 32, counts) | place, keys.view(np.int64)]
            own = (keys >> np.uint64(32)) % np.uint64(slices_of) == k
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], names=["node", "at", "key"])

    return run


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _roots(printed: DataFrame, rows: DataFrame, words: int, similarity: float, given: DataFrame | None = None) -> DataFrame:
    """components() of the links between all texts that share a key, and of those given."""
    spark = printed.sparkSession
    sketches = printed.select("node", "sketch")
    parts = math.ceil((printed.agg(F.sum(F.length("keys"))).first()[0] or 1) / 8 / SLICE_KEYS)
    met, near = [], []
    for k in range(parts):
        keyed = printed.select("node", "keys", "size").mapInArrow(_dealt(k, parts), "node long, at long, key long")
        shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "at")).alias("least")).where("n > 1").drop("n")
        met.append(stage(keyed.join(shared, "key")))
        first = met[-1].select(*_side(F.col("least.node"), F.col("least.at"), "a"), *_side(F.col("node"), F.col("at"), "b"))
        first = first.where("a <> b").where(_possible(similarity)).groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
        for c in "ab":
            first = first.join(sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")), c)
        near.append(stage(first.where(_alike(similarity)).select("a", "b")))
    judged = _judged(_all(near).distinct(), printed, rows, words, similarity)
    links = judged.where(F.col("j") >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    hub = F.col("least.node")
    linked = links.select(F.col("u").alias("hub"), F.col("v").alias("other"))
    links = links if given is None else links.unionByName(given)
    for share in (SHARE, 1):
        # of each key, whatever is not known to be in one component; a share of these pairs first, which connects most of a large group
        roots, near = components(links) if share == 1 else None, []
        for own in met:
            if share > 1:
                with_hub = own.join(linked, (hub == F.col("hub")) & (F.col("node") == F.col("other")), "left")
                root = F.when(F.col("other").isNotNull(), hub).otherwise(F.col("node"))
            else:
                with_hub = own.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
                root = F.coalesce("root", "node")
            with scratch(spark):
                placed = stage(with_hub.select("key", "node", "at", root.alias("root")))
                split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
                apart = stage(placed.join(split, "key").join(sketches, "node"))
                one, two = (apart.select("key", F.col("root").alias(f"root_{c}"), F.col("sketch").alias(f"sketch_{c}"), *_side(F.col("node"), F.col("at"), c)) for c in "ab")
                chosen = F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0
                rest = one.join(two, "key").where("a < b and root_a <> root_b").where(chosen & _possible(similarity) & _alike(similarity)).select("a", "b").distinct()
                near.append(stage(rest, lasting=True))
        rest = _all(near).distinct().join(judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        more = _judged(rest, printed, rows, words, similarity)
        found = more.where(F.col("j") >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links, judged = links.unionByName(found), judged.unionByName(more)
    return roots if found.isEmpty() else components(links)


def _side(node: Column, at: Column, c: str) -> list[Column]:
    place = at.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    return [node.alias(c), F.shiftright(at, 32).alias(f"size_{c}"), place.alias(f"place_{c}")]


def _possible(similarity: float) -> Column:
    """Whether two texts can be similar whose first common key stands at these places: it and what follows must be enough."""
    enough = (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - SLACK
    sized = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - SLACK
    return sized & (F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= enough)


def _alike(similarity: float) -> Column:
    """Whether sketches allow the similarity: sets that differ in more shingles than this are less alike."""
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH)), F.lit(0))
    return differ <= (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + SLACK


def _long_alike(similarity: float) -> Column:
    """_alike() by long sketches (empty: none). The longer one is folded: bits that are one in half the places are added up."""
    a, b = F.col("long_a"), F.col("long_b")
    both = F.least(F.size(a), F.size(b))
    half = lambda v: F.when(F.size(v) == 2 * both, F.zip_with(F.slice(v, 1, both), F.slice(v, both + 1, both), lambda x, y: x.bitwiseXOR(y))).otherwise(v)
    differ = F.aggregate(F.zip_with(half(a), half(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # null where sizes are further apart: not ruled out
    return F.coalesce((both == 0) | (differ <= (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + SLACK), F.lit(True))


def _sliced(pairs: DataFrame, most: int, n: int) -> list[DataFrame]:
    """The n pairs in slices of about `most`."""
    parts = max(1, math.ceil(n / most))
    return [pairs.where(F.pmod(F.xxhash64("b", "a"), F.lit(parts)) == k) if parts > 1 else pairs for k in range(parts)]


def _judged(pairs: DataFrame, printed: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, j): the Jaccard similarities of those pairs that long sketches do not rule out."""
    with scratch(pairs.sparkSession):
        pairs = stage(pairs)
        long, likely = printed.select("node", "size", "long"), []
        for own in _sliced(pairs, PAIRS, pairs.count()):
            for c in "ab":
                own = own.join(long.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("long").alias(f"long_{c}")), c)
            likely.append(stage(own.where(_long_alike(similarity)).select("a", "b")))
        pairs = _all(likely)
        n = pairs.count()
        if not n:
            return stage(pairs.select("a", "b", F.lit(0.0).alias("j")), lasting=True)
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

        found = rows.select("node", "text").join(wanted, "node", "left_semi")
        # texts are smaller on disk than their shingles, which do not compress
        known = stage(found.groupBy("node").agg(F.first("text").alias("text")))
        sides = [known.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab"]

        def alike(batches):
            for part in slices(batches):
                sets = {}
                for node, text in ((0, 2), (1, 3)):
                    for own, data in zip(part.column(node).to_pylist(), part.column(text), strict=True):
                        if own not in sets:
                            sets[own] = shingles(data.as_py(), words)
                found = [jaccard(sets[x], sets[y]) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], names=["a", "b", "j"])

        both = [own.join(sides[0], "a").join(sides[1], "b").select("a", "b", "t_a", "t_b") for own in _sliced(pairs, TEXT_PAIRS, n)]
        return _all([stage(x, lasting=True, work=alike, schema="a long, b long, j double") for x in both])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """One row of df of each group: that with the smallest id (nulls last), then the smallest digest."""
    with scratch(df.sparkSession), sparing(df.sparkSession):
        found = stage(groups(df, id_col, text_col, fingerprints=fingerprints), lasting=True)
    # a third of all texts may be one group: its least member is found by partial aggregation
    order = F.struct(F.col("least").isNull().alias("none"), "least", "digest")
    kept = found.groupBy("grp").agg(F.min(order).alias("first")).select(F.col("first.digest").alias("__digest"), F.col("first.least").alias("__least"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.withColumn("__digest", F.sha2(text, 256)).withColumn("__id", F.col(id_col).cast("long"))
    last = F.lit((1 << 63) - 1)
    chosen = kept.select("__digest", F.coalesce("__least", last).alias("__id"))
    marked = rows.withColumn("__id", F.coalesce("__id", last)).join(chosen, ["__digest", "__id"], "left_semi")
    # rows that repeat both id and text are still as many as they were
    return marked.dropDuplicates(["__digest", "__id"]).select(*df.columns)
