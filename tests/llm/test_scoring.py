"""Context mixing against a plain model that counts in dictionaries and walks each text token by token."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from breakweave.llm import common, mixing, scoring
from breakweave.llm.common import stage, text_bytes


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


@pytest.fixture(scope="module")
def scored(docs):
    return scoring.score(docs, common=50).toPandas()


def test_base_scores(scored, corpus):
    words = {repr(i): tokens(t) for i, t in corpus}
    seen = Counter(w for i, t in corpus if not held(i) for w in words[repr(i)])
    n, v = sum(seen.values()), len(seen)
    assert len(scored) == len(corpus)
    for r in scored.itertuples():
        i = None if math.isnan(r.doc_id) else int(r.doc_id)
        own = words[repr(i)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(seen[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0


def test_model_knows_what_it_learnt(scored):
    learnt = scored[~scored.held_out & (scored.n_tokens > 20)]
    assert learnt.bits_per_byte.mean() < 4


def test_scores_of_nothing(nothing, spark):
    assert scoring.score(nothing).count() == 0
    only = next(k for k in range(100) if held(k))
    row = scoring.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row["n_known"], row["train_tokens"]) == (0, 0) and row["base_score"] == 0.0 and row["score"] < 0


def test_equal_texts_score_alike(scored, corpus):
    of = defaultdict(set)
    texts = {i: t for i, t in corpus}
    for r in scored.itertuples():
        of[texts[None if math.isnan(r.doc_id) else int(r.doc_id)] or ""].add(round(r.score, 9))
    assert max(map(len, of.values())) == 1


class Plain:
    """The model's definition with dictionaries: counts of (class, node), of repeats and of letters."""

    def __init__(self, model, ids, texts):
        self.m, self.size = model, model.other
        self.symbol = lambda w: min(ids.get(w, self.size), self.size)
        self.pairs, self.nodes, self.repeats = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        self.letters = defaultdict(lambda: [0, 0])
        for text in texts:
            for run, guess, hit, context, word in self.walk(text):
                if guess is not None:
                    self.repeats[run, guess][hit] += 1
                    self.repeats[run][hit] += 1
                if not hit:
                    for node, bit in self.path(model.tree, self.symbol(word)):
                        self.pairs[context, node][bit] += 1
                        self.nodes[node][bit] += 1
        for word in {w for t in texts for w in t} - {b" "}:
            for key, bit, _ in self.spelling(word):
                for k in key:
                    self.letters[k][bit] += 1

    @staticmethod
    def path(tree, leaf):
        a, n = tree.offset[leaf], tree.length[leaf]
        return list(zip(tree.path[a : a + n].tolist(), tree.bit[a : a + n].tolist(), strict=True))

    def walk(self, text):
        """(run, guess, hit, context, word) of every token."""
        after, length, last = {}, 0, self.m.classes
        for k, word in enumerate(text):
            pair = (text[k - 2], text[k - 1]) if k >= 2 else None
            guess = after.get(pair) if pair else None
            hit = guess is not None and guess == word
            yield sum(length >= r for r in mixing.RUNS), None if guess is None else self.symbol(guess), hit, last, word
            length = length + 1 if hit else 0
            if pair:
                after[pair] = word
            if self.symbol(word) < self.m.classes:
                last = self.symbol(word)

    def spelling(self, word):
        for at, letter in enumerate(word + b" "):
            before = b" " * mixing.LENGTHS[-1] + word[:at]
            for node, bit in self.path(self.m.letter_tree, letter):
                yield [(before[-k:], node) for k in mixing.LENGTHS], bit, at

    @staticmethod
    def odds(zeros, ones, a=mixing.PRIOR, b=mixing.PRIOR):
        return math.log((ones + b) / (zeros + a))

    def mixed(self, gate, inputs, weights):
        return sum(w * x for w, x in zip(weights[gate], [*inputs, 1.0], strict=True))

    def narrow(self, counts, wide):
        p = 1 / (1 + math.exp(-wide))
        return self.odds(*counts, mixing.WIDER * (1 - p), mixing.WIDER * p)

    def events(self, token):
        """(key of the text's own counts or None, gate, mixed log-odds, bit) of a token's events."""
        run, guess, hit, context, word = token
        if guess is not None:
            x = self.odds(*self.repeats[run])
            yield ("again", run), mixing.REPEAT + run, self.mixed(mixing.REPEAT + run, [x, self.narrow(self.repeats[run, guess], x)], self.m.weights), int(hit)
        if hit:
            return
        for depth, (node, bit) in enumerate(self.path(self.m.tree, self.symbol(word))):
            n = sum(self.pairs[context, node])
            rank = sum(n >= t for t in mixing.TIMES)
            gate = mixing.FIRST + min(rank, len(mixing.RUNS)) if node == 0 else mixing.INNER + rank
            x = self.odds(*self.nodes[node])
            yield ("node", node) if depth < mixing.NEAR_STEPS else None, gate, self.mixed(gate, [x, self.narrow(self.pairs[context, node], x)], self.m.weights), bit
        if self.symbol(word) == self.size:
            for key, bit, at in self.spelling(word):
                seen = [sum(self.letters[k]) for k in key]
                known = sum(s > 0 for s in seen)
                gate = mixing.LETTER + 2 * known + (known > 0 and seen[known - 1] >= 8)
                z = self.mixed(gate, [self.odds(*self.letters[k]) for k in key], self.m.letter_weights)
                yield ("letter", key[mixing.OWN_LETTERS - 1]) if at < mixing.NEAR_LETTERS else None, gate, z, bit

    def bits(self, text):
        shift, share = defaultdict(float), defaultdict(lambda: mixing.OWN_SHARE)
        held_shift, held_share = defaultdict(lambda: mixing.INERTIA), defaultdict(lambda: mixing.INERTIA)
        own, total, at, block, walked = defaultdict(lambda: [0, 0]), 0.0, 0, mixing.BLOCKS[0], list(self.walk(text))
        while at < len(text):
            seen, sums = [], defaultdict(lambda: np.zeros(4))
            for token in walked[at : at + block]:
                for key, gate, z, bit in self.events(token):
                    if key is None:
                        total += math.log2(1 + math.exp(-z if bit else z))
                        continue
                    p = 1 / (1 + math.exp(-z))
                    new = self.odds(*own[key], mixing.OWN_PRIOR * (1 - p), mixing.OWN_PRIOR * p) - z
                    y = z + shift[gate] + share[gate] * new
                    total += math.log2(1 + math.exp(-y if bit else y))
                    q = 1 / (1 + math.exp(-y))
                    sums[gate] += [q * (1 - q), bit - q, q * (1 - q) * new * new, (bit - q) * new]
                    seen.append((key, bit))
            for gate, (sure, miss, sure_new, miss_new) in sums.items():
                held_shift[gate] += sure
                held_share[gate] += sure_new
                shift[gate] = min(4, max(-4, shift[gate] + miss / held_shift[gate]))
                share[gate] = min(2, max(0, share[gate] + miss_new / held_share[gate]))
            for key, bit in seen:
                own[key][bit] += 1
            at, block = at + block, min(2 * block, mixing.BLOCKS[1])
        return total


@pytest.fixture(scope="module")
def learnt(docs, corpus):
    learning = text_bytes(docs.where(~scoring.held_out(docs.doc_id)), "doc_id", "text")
    words = stage(learning.mapInArrow(scoring.count_words, "word binary, n long").groupBy("word").sum("n").withColumnRenamed("sum(n)", "n"))
    ids, _ = scoring.vocabulary(words, 120, 400)
    return scoring.learnt(learning, words, ids), ids, [tokens(t) for i, t in corpus if not held(i)]


def test_bits_against_the_plain_model(learnt, corpus):
    """Log-odds are kept in steps and the text's own counts in hashed cells, hence the tolerance."""
    model, ids, texts = learnt
    plain = Plain(model, ids, texts)
    chosen = [tokens(t) for _, t in corpus if len(t or "") < 4000] + [tokens("a b c d e f g " * 60), tokens("one two one two unseen-word one two unseen-word")]
    got = model.costs(model.flat(chosen, ids))
    for text, bits in zip(chosen, got.tolist(), strict=True):
        assert bits == pytest.approx(plain.bits(text), rel=0.03, abs=0.5)
    assert sum(got) == pytest.approx(sum(map(plain.bits, chosen)), rel=0.005)


def test_counts_do_not_depend_on_batches(learnt, corpus):
    model, ids, texts = learnt
    whole, halves = (np.zeros(mixing.situations(model.other, model.classes), np.uint32) for _ in range(2))
    mixing.add_situations(whole, texts, ids, model.classes)
    for text in texts:
        mixing.add_situations(halves, [text], ids, model.classes)
    assert (whole == halves).all()
    together = model.costs(model.flat(texts, ids))
    alone = [model.costs(model.flat([t], ids))[0] for t in texts]
    assert together.tolist() == pytest.approx(alone, rel=1e-5)


def test_probabilities_add_up(learnt):
    """Over all symbols of the alphabet and the way out of it, after any class."""
    model, _, _ = learnt
    for context in (0, 3, model.classes):
        total = 0.0
        for symbol in range(model.other + 1):
            path = Plain.path(model.tree, symbol)
            z = [(model.named[context, node] >> mixing.GATE_BITS) / mixing.ODDS for node, _ in path]
            total += math.prod(1 / (1 + math.exp(-x if bit else x)) for x, (_, bit) in zip(z, path, strict=True))
        assert total == pytest.approx(1, abs=1e-6)


def test_held_out_texts_beat_the_base(spark):
    """Texts of one vocabulary in two languages: contexts tell them apart, the base does not."""
    rng = random.Random(5)
    languages = [[("".join(rng.choice(c) for _ in range(rng.randint(2, 7)))) for _ in range(300)] for c in ("abcdeo", "stuvwy")]
    rows = [(k, " ".join(rng.choice(languages[k % 2][: rng.choice([20, 300])]) for _ in range(120))) for k in range(300)]
    out = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert out.score.sum() > 0.95 * out.base_score.sum()


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(scoring, "PART_BYTES", 100)
    rng = random.Random(1)
    text = " ".join("x" * rng.randint(1, 30) for _ in range(200)).encode()
    found = list(scoring.parts(text))
    assert [w for p in found for w in p] == [*text.split(), b" "] and len(found) > 10
    assert list(scoring.parts(b"")) == [[b" "]]


class Moving(Plain):
    """The whole method, event by event: every event moves its gate's weights and its level of the adaptive map."""

    def inputs(self, token):
        """(cell key of the text's own counts or None, gate, log-odds of the predictors, bit) of all events of a token."""
        run, guess, hit, context, word = token
        step = lambda x, size: round(x * size) / size
        if guess is not None:
            x = self.odds(*self.repeats[run])
            yield run, mixing.REPEAT + run, [x, step(self.narrow(self.repeats[run, guess], x), mixing.ODDS)], int(hit)
        if hit:
            return
        for depth, (node, bit) in enumerate(self.path(self.m.tree, self.symbol(word))):
            n = sum(self.pairs[context, node])
            rank = sum(n >= t for t in mixing.TIMES)
            gate = mixing.FIRST + min(rank, len(mixing.RUNS)) if node == 0 else mixing.INNER + rank
            x = self.odds(*self.nodes[node])
            yield node + 8 if depth < mixing.NEAR_STEPS else None, gate, [x, step(self.narrow(self.pairs[context, node], x), mixing.ODDS)], bit
        if self.symbol(word) == self.size:
            cells = mixing.letter_cells(self.m.letter_tree, [word])[2][mixing.OWN_LETTERS - 1].tolist()
            for cell, (key, bit, at) in zip(cells, self.spelling(word), strict=True):
                seen = [sum(self.letters[k]) for k in key]
                known = sum(s > 0 for s in seen)
                gate = mixing.LETTER + 2 * known + (known > 0 and seen[known - 1] >= 8)
                x = [step(self.odds(*self.letters[k]), mixing.LETTER_ODDS) for k in key]
                yield cell - (1 << mixing.SLOT_BITS) if at < mixing.NEAR_LETTERS else None, gate, x, bit

    @staticmethod
    def missed(y, bit):
        miss = bit - 1 / (1 + math.exp(-y))
        return miss, abs(miss) * max(1 - abs(miss), 0.5)

    def bits(self, text):
        room = 1 << math.ceil(math.log2(8 * len(text)))
        weights = {g: np.array(w[g], float) for w, gates in ((self.m.weights, range(mixing.LETTER)), (self.m.letter_weights, range(mixing.LETTER, mixing.GATES))) for g in gates}
        held, held_share, held_map = (defaultdict(lambda at=at: at) for at in (mixing.INERTIA * mixing.SQUARE, mixing.INERTIA, mixing.MAP_INERTIA))
        share, refined, own = defaultdict(lambda: mixing.OWN_SHARE), defaultdict(float), defaultdict(lambda: [0, 0])
        total, at, block, walked = 0.0, 0, mixing.BLOCKS[0], list(self.walk(text))
        while at < len(text):
            slopes, sums, maps, came = defaultdict(float), defaultdict(lambda: np.zeros(3)), defaultdict(lambda: np.zeros(2)), []
            for token in walked[at : at + block]:
                for key, gate, x, bit in self.inputs(token):
                    x, new = np.array([*x, 1.0]), 0.0
                    y = min(20, max(-20, weights[gate] @ x))
                    if key is not None:
                        cell = gate < mixing.LETTER, ((key * 0x9E3779B1) >> 7) & (room - 1)
                        p = 1 / (1 + math.exp(-y))
                        new = self.odds(*own[cell], mixing.OWN_PRIOR * (1 - p), mixing.OWN_PRIOR * p) - y
                        y += share[gate] * new
                        came.append((cell, bit))
                    miss, bend = self.missed(y, bit)
                    slopes[gate] += miss * x
                    sums[gate] += [bend * (x @ x), miss * new, bend * new * new]
                    level = gate, round(min(mixing.TOP, max(-mixing.TOP, y)))
                    y += refined[level]
                    total += math.log2(1 + math.exp(-y if bit else y))
                    maps[level] += self.missed(y, bit)
            for gate, (norm, miss_new, bend_new) in sums.items():
                held[gate] += norm
                weights[gate] += slopes[gate] / (2 * held[gate])
                held_share[gate] += bend_new
                share[gate] = min(2, max(0, share[gate] + miss_new / held_share[gate]))
            for level, (miss, bend) in maps.items():
                held_map[level] += bend
                refined[level] += miss / held_map[level]
            for cell, bit in came:
                own[cell][bit] += 1
            at, block = at + block, min(2 * block, mixing.BLOCKS[1])
        return total


def test_bits_against_the_moving_model(learnt, corpus):
    """Letters' contexts may collide, hence the tolerance."""
    model, ids, texts = learnt
    plain = Moving(model, ids, texts)
    rng = random.Random(3)
    strange = [b"".join(rng.choice([b"zq", b"xj", b"th", b"7"]) for _ in range(6)) for _ in range(300)]
    chosen = [tokens(t) for _, t in corpus if len(t or "") < 4000] + [tokens("a b c d e f g " * 60), [*strange, b" "], [b"x" * 400, b" "]]
    got = model.costs(model.flat(chosen, ids))
    for text, bits in zip(chosen, got.tolist(), strict=True):
        assert bits == pytest.approx(plain.bits(text), rel=2e-3, abs=0.6)


def test_late_letters_are_learnt_within_a_text(learnt):
    """Words that differ in their first letters, and whose other letters the learning texts never have in this order."""
    model, ids, _ = learnt
    rng = random.Random(1)
    words = [bytes([97 + k // 26, 97 + k % 26, *rng.choices(b"theronai", k=12)]) for k in range(600)]
    few, many = model.costs(model.flat([words[:32], words], ids)) / [32, 600]
    assert many < 0.85 * few


def test_texts_of_all_sizes_together(learnt, corpus):
    """Costs depend neither on the other texts, nor on how many texts' events are worked on together, nor on long words."""
    model, ids, texts = learnt
    chosen = [[b" "], *texts, [b"y" * 5000, b"k" * 70, b" "], [b"w%d" % k for k in range(3000)], [b" "]]
    together = model.costs(model.flat(chosen, ids)).tolist()
    for text, bits in zip(chosen, together, strict=True):
        assert model.costs(model.flat([text], ids))[0] == pytest.approx(bits, rel=1e-9)


def test_words_are_counted_as_bytes():
    odd = [b"A b\x0bB\x0cc\r\n\tA", b"", None, b"   ", b" \xff\xfe x\xc2\xa0y \x1cz\x85 \xc3\x89 ", "É é ZZ zz w".encode(), b"\x00 a\x00"]
    texts = odd * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    got = Counter()
    for part in scoring.count_words(iter([batch.slice(0, 3), batch.slice(3)])):
        got.update({w: 0 for w in part.column(0).to_pylist()})
        for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            got[w] += n
    assert got == Counter(w for t in texts for p in scoring.parts(t or b"") for w in p)


def test_workers_keep_common_words_alone(learnt):
    """Rare words came once or a few times among all texts: a worker that kept them grew with its input."""
    model, ids, _ = learnt
    known = ids | {b"common-word": len(ids) + 1, b"other-common": len(ids) + 2}
    few = [[b"common-word", *(b"rare%d" % k for k in range(500)), b" "]]
    first = model.costs(model.flat(few, known))
    model.flat([[b"common-word", b" "]], known)
    assert model.memory.words == [b"common-word", b"other-common"] and model.memory.met.tolist() == [True, False]
    room = len(model.memory.events[1])
    for k in range(20):
        model.flat([[w.replace(b"rare", b"as%02d" % k) for w in few[0]]], known)
    assert len(model.memory.events[1]) <= 2 * room
    # what lies in their room now is of other words
    assert model.costs(model.flat(few, known)).tolist() == first.tolist()
    assert model.costs(model.flat(few, ids)).tolist() == first.tolist()


def test_staged_files_take_little_memory(docs, monkeypatch, tmp_path):
    """Spark's own writer counts an executor's memory twice, and large batches fill its workers."""
    seen = []

    def watched(df, **more):
        out = stage(df, **more)
        seen.append((df.sparkSession.conf.get(common.BATCH), [f for f in out.inputFiles() if f.endswith(".zstd.parquet")]))
        return out

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(scoring, "stage", watched)
    scoring.score(docs, common=50).count()
    assert seen == [(str(common.BATCH_BYTES), [])] * 2
