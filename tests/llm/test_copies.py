"""Fingerprints, links, near-copies and repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from breakweave.llm import common, copies, simhash, substrings
from breakweave.llm.components import components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_print(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, corpus, nothing):
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    prints = [(i, plain_print(t or "")) for i, t in corpus]
    assert sorted((repr(i), f) for i, f, _ in got) == sorted((repr(i), f) for i, f in prints)
    values = sorted({f for _, f in prints})
    of = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[of[f]].append(i)
    assert all(c == min(least[of[f]], default=None) for _, f, c in got)
    assert simhash.near_duplicates(nothing).count() == 0


def test_crowded_keys_link_like_pairs(spark):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**62, 6).tolist():
        for _ in range(90):
            x = base
            for bit in rng.integers(0, 63, rng.integers(0, 4)).tolist():
                x ^= 1 << bit
            values.add(x)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    for paired in (2, 10**6):
        assert roots(values, [(r["u"], r["v"]) for r in simhash.links(df, paired).collect()]) == want


def test_near_copies_keep_one(spark, nothing):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(30):
        words = [f"w{rng.randrange(3000)}xyz" for _ in range(150)]
        for c in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(c):
                own[rng.randrange(150)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own), g))
    rows += [(None, rows[0][1], 0), (900, None, 0), (901, "", 0), rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = [r["doc_id"] for r in copies.keep_one(df).collect()]
    sets = {i: copies.shingles(t.encode()) for i, t, _ in rows if i is not None and t}
    want = roots(list(sets), [(a, b) for a in sets for b in sets if a < b and copies.jaccard(sets[a], sets[b]) >= 0.8])
    assert sorted(kept) == sorted({*want.values(), 900})
    assert copies.keep_one(nothing).count() == 0 and copies.keep_one(nothing).columns == nothing.columns


def test_copies_apart_from_the_least_member(spark):
    """Texts of one vocabulary in other orders, each with a near-copy: few are near the least of those that share their words."""
    rng = random.Random(8)
    words = [f"word{k:03d}" for k in range(80)]
    texts = []
    for _ in range(40):
        own = rng.sample(words, len(words))
        texts += [" ".join(own), " ".join([*own[:-1], "another"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [copies.shingles(t.encode()) for t in texts]
    of = roots(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if copies.jaccard(sets[a], sets[b]) >= 0.8])
    assert len(set(of.values())) == 40
    assert sorted(r["doc_id"] for r in copies.keep_one(df).collect()) == sorted(set(of.values()))


def test_near_copies_start_no_process_for_their_files(spark, docs, tmp_path, monkeypatch):
    """Hadoop's writer starts chmod for a file and for its checksum file; with none of the latter it did not write."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(k, [k, None], (f"t{k}", b"\xff"), None if k % 3 else 0.5) for k in range(50)]
    table = spark.createDataFrame(rows, "k long, a array<long>, s struct<t: string, b: binary>, x double").repartition(3)
    with common.sparing(spark):
        staged = common.stage(table.groupBy("k").agg(*[F.first(c).alias(c) for c in "asx"]))
        empty = common.stage(table.where("k < 0"))
        counted = common.stage(table.select("k"), work=lambda batches: batches, schema="k long")
    assert sorted(map(tuple, staged.collect())) == rows and staged.schema.names == table.schema.names
    assert not empty.collect() and empty.schema == table.schema
    assert sorted(r["k"] for r in counted.collect()) == [*range(50)]
    before = spark.conf.get(common.BATCH)
    copies.keep_one(docs, fingerprints=True).collect()
    assert spark.conf.get(common.BATCH) == before
    files = [p.name for p in tmp_path.rglob("*") if p.is_file()]
    assert len(files) > 4 and all(x.startswith("part-") and x.endswith(".parquet") for x in files)


def test_near_copies_of_every_kind_are_found(spark):
    """A block appended, the tail cut off, the last words changed, in short and long texts."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}abc"
    core, texts = [word() for _ in range(90)], []
    for n in [25, 30, 40, 60, 100, 200] * 6:
        own = [word() for _ in range(n)]
        texts += [own, [*own, *(word() for _ in range(n // 6))], own[: n - n // 7], [*own[:-1], word()]]
    for _ in range(30):
        tail = [word() for _ in range(15)]
        texts += [core + tail, [*core, *tail, word(), word()]]
    texts = [" ".join(x) for x in texts]
    sets = [copies.shingles(t.encode()) for t in texts]
    of = roots(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if copies.jaccard(sets[a], sets[b]) >= 0.8])
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["least"]: r["grp"] for r in copies.groups(df).collect()}
    assert sorted(map(len, _parts(found))) == sorted(map(len, _parts(of))) and set(_parts(found)) == set(_parts(of))


def test_near_copies_in_small_slices(spark, monkeypatch):
    """Keys and pairs that come in many slices give the groups of all pairs; unrelated long texts are told apart unread."""
    for name, most in (("SLICE_KEYS", 2000), ("PAIRS", 7), ("TEXT_PAIRS", 3)):
        monkeypatch.setattr(copies, name, most)
    rng = random.Random(4)
    own = [[f"w{rng.randrange(9)}" for _ in range(n)] for n in [1500, 1600, 1700, 20, 40] * 2]
    texts = [" ".join(x) for x in own] + [" ".join([*x[: -len(x) // 10], "other"]) for x in own[:7]]
    sets = [copies.shingles(t.encode()) for t in texts]
    of = roots(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if copies.jaccard(sets[a], sets[b]) >= 0.8])
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    judged, plain = [], copies._judged
    monkeypatch.setattr(copies, "_judged", lambda *a: judged.append(plain(*a)) or judged[-1])
    found = {r["least"]: r["grp"] for r in copies.groups(df).collect()}
    assert set(_parts(found)) == set(_parts(of))
    assert all(r["j"] > 0.5 for pairs in judged for r in pairs.collect()) and sum(x.count() for x in judged) >= 7


def test_long_sketches_never_rule_out_near_copies(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for n, same in [(n, s) for n in (600, 1000, 1030, 5000) for s in (0.0, 0.5, 0.78, 0.82, 0.95)]:
        a, more = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
        b = np.concatenate([a[: int(n * 2 * same / (1 + same))], more])[:n]
        rows.append((*[copies.sketch(x, copies.long_words(len(x))).tolist() for x in (a, b[: n - n // 40])], n, n - n // 40))
        want.append(copies.jaccard(np.unique(a), np.unique(b[: n - n // 40])))
    df = spark.createDataFrame(rows, "long_a array<long>, long_b array<long>, size_a int, size_b int")
    got = [r["ok"] for r in df.select(copies._long_alike(0.8).alias("ok")).collect()]
    assert all(ok for ok, j in zip(got, want, strict=True) if j >= 0.8) and not any(ok for ok, j in zip(got, want, strict=True) if j < 0.6)


def test_near_copies_by_fingerprints(spark):
    """Fingerprints within two bits link texts whose shingles are less alike than SIMILARITY."""
    rng = random.Random(6)
    base, near = [f"w{rng.randrange(3000)}xyz" for _ in range(120)], []
    while len(near) < 3:
        own = list(base)
        for k in range(0, 120, 12):
            own[k + rng.randrange(12)] = f"changed{rng.randrange(1000)}"
        if (simhash.fingerprint(" ".join(base).encode()) ^ simhash.fingerprint(" ".join(own).encode())).bit_count() <= simhash.DISTANCE + 4 * (not near):
            near.append(own)
    texts = [" ".join(x) for x in [base, *near]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    prints = [plain_print(t) for t in texts]
    of = roots(range(4), [(a, b) for a in range(4) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(r["doc_id"] for r in copies.keep_one(df, fingerprints=True).collect()) == sorted(set(of.values())) != [0, 1, 2, 3]
    assert copies.keep_one(df).count() == 4


def _parts(of):
    parts = defaultdict(set)
    for member, root in of.items():
        parts[root].add(member)
    return [frozenset(x) for x in parts.values()]


def plain_ends(text, low, high):
    table, mask = substrings.GEAR.astype(int), substrings.END_MASK
    ends, last, h = [], 0, 0
    for k, byte in enumerate(text):
        h = ((h << 1) + int(table[byte])) & 0xFFFF
        inside = k + 1 < len(text) and text[k + 1] & 0xC0 == 0x80
        if k + 1 - last >= high and not inside or k + 1 - last >= low and h & mask == 0 and not inside or k + 1 == len(text):
            ends.append(k + 1)
            last = k + 1
    return ends


def test_chunk_ends_roll_like_the_plain_hash():
    rng = random.Random(9)
    for n in (0, 1, 5, 300, 5000):
        text = "".join(rng.choice("abcdeé \n") for _ in range(n)).encode()
        assert substrings.chunk_ends(text, substrings.GEAR) == plain_ends(text, substrings.MIN_CHUNK, substrings.MAX_CHUNK)
    assert substrings.chunk_ends(b"x" * 1000, substrings.GEAR)[-1] == 1000


def test_insertions_leave_other_chunks():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    cut = lambda t: {t[a:b] for e in [substrings.chunk_ends(t, substrings.GEAR)] for a, b in zip([0, *e], e)}
    assert len(cut(text) - cut(text[:9000] + b"inserted" + text[9000:])) <= 3


def test_spans_against_plain_chunks(docs, corpus, nothing):
    owners = defaultdict(set)
    for i, t in corpus:
        t = (t or "").encode()
        e = substrings.chunk_ends(t, substrings.GEAR)
        for a, b in zip([0, *e], e):
            owners[t[a:b]].add((1 << 63) - 1 if i is None else i)
    want = set()
    for i, t in corpus:
        i, t = (1 << 63) - 1 if i is None else i, (t or "").encode()
        run = None
        e = substrings.chunk_ends(t, substrings.GEAR)
        for a, b in [*zip([0, *e], e), (len(t), len(t))]:
            state = None if a == b or len(owners[t[a:b]]) < 2 else i == min(owners[t[a:b]])
            if run and run[2] == state:
                run[1] = b
                continue
            if run and run[2] is not None and run[1] - run[0] >= substrings.MIN_BYTES:
                want.add((i, *run))
            run = [a, b, state]
    got = {(r["ord"], r["start"], r["stop"], r["kept"]) for r in substrings.spans(docs).collect()}
    assert got == want and any(not k for *_, k in got)
    assert substrings.spans(nothing).count() == 0


def test_dedup_cuts_later_passages(spark, docs, corpus):
    out = {r["doc_id"]: r["text"] for r in substrings.dedup(docs.where("doc_id is not null")).collect()}
    passages = [i for i, t in corpus if i is not None][-6:-1]
    assert out[5] == dict(corpus)[5]
    later = [i for i in passages if out[i] != dict(corpus)[i]]
    assert len(later) >= 3
    sized = spark.createDataFrame([(1, "some text", 9)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in substrings.dedup(sized, length_col="n_chars").collect()] == [(1, "some text", 9)]
