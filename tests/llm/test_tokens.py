"""Encoding, packing and media round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from breakweave.llm import bpe, media, packing

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode_match_the_library(docs, corpus, library):
    encoded = bpe.encode(docs, RANKS, P.PATTERN, window=500, overlap=60)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded, RANKS).collect()), key=repr)
    assert got == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in corpus), key=repr)


def test_long_texts_in_windows_match_the_library(spark, library):
    """Megabytes of prose, one letter without end, digits without end (triples of neighbours are out of step), many scripts."""
    words = ["the", "don't", "  ", "\n\n", "café", "1234567", "x_y", "漢字", "!!!", "\t", "’s", "we'll"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 800_000)), "x" * 50_000, "7" * 50_000, "word " * 3000 + "9" * 40_000 + " word" * 9000, "a" * 16_895, "b " * 8_448, "c " * 8_449, None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[3]), (3, texts[3])], "doc_id long, text string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode(df, RANKS, P.PATTERN).collect()), key=lambda r: repr(r[0]))
    want = [(k, library.encode_ordinary(t or "")) for k, t in [*enumerate(texts), (None, texts[3]), (3, texts[3])]]
    assert len(texts[0]) > 3_000_000 and got == sorted(want, key=lambda r: repr(r[0]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1'st \n\té!.", min_size=30, max_size=150), st.integers(6, 14), st.integers(3, 6))
def test_neighbours_are_stitched_like_the_whole(text, window, overlap):
    pattern = regex.compile(P.PATTERN)
    n = -(-(len(text) - overlap) // window)
    windows = [text[k * window : (k + 1) * window + overlap] for k in range(n)]
    marks = [bpe.boundaries(w, pattern, window, overlap) for w in windows]
    stops = [sorted({*a.tolist()} & {*b.tolist()})[:1] for (_, a), (b, _) in zip(marks, marks[1:], strict=False)]
    if all(stops):
        starts = [0, *(s[0] for s in stops)]
        parts = [bpe.between(w, a, window + s[0] if s else None, pattern) for w, a, s in zip(windows, starts, [*stops, None], strict=True)]
        assert [p for own in parts for p in own] == pattern.findall(text)


def test_encode_nothing(nothing):
    assert bpe.decode(bpe.encode(nothing, RANKS, P.PATTERN), RANKS).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1'st \n\té!.", max_size=120), st.integers(3, 12), st.integers(2, 8))
def test_windows_split_like_the_whole(text, window, overlap):
    pattern = regex.compile(P.PATTERN)
    assert [p for part in bpe.pre_tokens(text, pattern, window, overlap) for p in part] == pattern.findall(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_word_ids_match_the_tokenizer(text):
    tokenizer, known = Tokenizer.from_file(WORDS), test_word_ids_match_the_tokenizer.__dict__.setdefault("encode", packing.word_encoder(WORDS, None))
    assert known(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "é", "<|", "|>", "b's", "\t"]), max_size=12))
def test_special_tokens_match_the_tokenizer(parts):
    text = "".join(parts)
    known = test_special_tokens_match_the_tokenizer.__dict__.setdefault("encode", packing.word_encoder(WORDS, None))
    library = test_special_tokens_match_the_tokenizer.__dict__.setdefault("library", Tokenizer.from_file(WORDS))
    assert known(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_null_ids(spark):
    assert packing.word_encoder(WORDS, 1)("a <|endoftext|> b").tolist() == [320, 49407, 321, 1]
    df = spark.createDataFrame([(None, "no id"), (3, "an id"), (None, None)], "doc_id long, text string")
    assert packing.pack(df, WORDS, with_ids=True).count() == 3


def test_packing_covers_each_id_once(docs, corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, capacity=256, smallest=8, with_ids=True).toPandas()
    for doc_id, text in dict((i, t) for i, t in corpus if i is not None).items():
        own = rows[rows.doc_id == doc_id].sort_values("start")
        whole = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(map(bytes, own.ids)) == whole and (own.doc_tokens == len(whole) // 4).all()
        assert [zlib.crc32(bytes(x)) for x in own.ids] == own.ids_crc32.tolist()
    for _, bin_ in rows.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == (bin_.length.cumsum() - bin_.length).tolist() and bin_.length.sum() <= 256
    assert rows.length.sum() / (rows.sequence_id.nunique() * 256) > 0.9


def test_packing_repeated_rows_and_nothing(docs, corpus, nothing):
    rows = packing.pack(docs, WORDS).toPandas()
    assert rows[rows.doc_id.isna()].shape[0] >= 1
    assert rows[(rows.doc_id == 0) & (rows.start == 0)].shape[0] == 2
    assert packing.pack(nothing, WORDS).count() == 0


@given(st.integers(0, 9000))
def test_cuts_are_gapless(total):
    tails = packing.tail_classes(2048, 64)
    at = 0
    for start, length, cls in packing.cut(total, 2048, 64, tails):
        assert start == at and 0 < length <= 2048 // cls
        at += length
    assert at == total


def test_media_round_trip(docs, corpus):
    rows = media.stored(docs).collect()
    assert len(rows) == len(corpus)
    want = {(i, hashlib.sha256(media.padded((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t in corpus}
    assert {(r["doc_id"], hashlib.sha256(bytes(r["payload"])).hexdigest(), r["n_bytes"]) for r in rows} == want


def test_media_ranges_retries_and_nothing(spark, docs, corpus, nothing, tmp_path):
    assert media.write_archives(docs, f"file://{tmp_path}/a") == len(corpus)
    small = media.read_archives(spark, f"file://{tmp_path}/a", rangeBytes=200)
    assert small.count() == len(corpus) and small.rdd.getNumPartitions() > 10
    media.write_archives(nothing, f"file://{tmp_path}/b")
    assert media.read_archives(spark, f"file://{tmp_path}/b").count() == 0
    reader = media.ArchiveReader({"path": f"file://{tmp_path}/a"})
    honest, failed = media.ArchiveReader.member, []

    def flaky(file, offset, length, crc):
        if offset not in failed:
            failed.append(offset)
            raise OSError("lost")
        return honest(file, offset, length, crc)

    reader.member = flaky
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(corpus) and len(failed) > 5


def test_png_is_read_by_its_own_rules():
    payload = bytes(range(256)) * 2
    assert media.from_png(media.to_png(payload)) == payload
    broken = bytearray(media.to_png(payload))
    broken[60] ^= 1
    with pytest.raises(media.BadMember):
        media.from_png(bytes(broken))
