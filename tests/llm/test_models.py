"""Scoring, quality, URL, licence and nearest-neighbour operators against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from breakweave.llm import licenses, nearest, quality, urls


def test_labellers_and_scorer(spark, nothing):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, good = [], {}
    for k in range(240):
        words = [word() for _ in range(60)]
        bad = k % 6 == 0
        if bad:
            words = [[w.upper() + "!!" for w in words], [w + "###" for w in words], [words[0]] * 60][k // 6 % 3]
        good[k] = not bad
        rows.append((k, " ".join(words)))
    rows += [(900, None), (901, ""), (None, "some quite normal text here"), rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in quality.classify(df).collect()}
    assert sum(out[k] == good[k] for k in good) / len(good) > 0.95 and all(out[k] for k in good if good[k])
    assert quality.classify(df).count() == len(rows) and quality.kept(df).columns == df.columns
    assert quality.classify(nothing).count() == 0 and quality.kept(nothing).columns == nothing.columns


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.85
    patterns = np.stack([np.where(truth, 1, np.where(rng.random(4000) < a, -1, 1)) for a in (0.9, 0.7, 0.5, 0.8)], axis=1)
    _, posterior, prior = quality.fit_labels(patterns, np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.95 and abs(prior - 0.85) < 0.05


def test_em_against_a_plain_one():
    """A loop over single texts, and no labeller's accuracy is pinned: one that is often wrong on good texts is seen to be."""
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.8
    wrong = (0.01, 0.02, 0.25)
    rows = np.stack([np.where(truth, np.where(rng.random(600) < w, -1, 1), np.where(rng.random(600) < 0.8, -1, 1)) for w in wrong], axis=1)
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    shares, posterior, prior = quality.fit_labels(patterns, counts.astype(float), rounds=30)
    good = [0.1 if -1 in r else 0.95 for r in rows.tolist()]
    for _ in range(30):
        own = [[[1.0] * 3 for _ in range(3)] for _ in range(2)]
        weight = [sum(1 - g for g in good), sum(good)]
        for r, g in zip(rows.tolist(), good, strict=True):
            for j, v in enumerate(r):
                own[0][j][v + 1] += 1 - g
                own[1][j][v + 1] += g
        for c in range(2):
            for j in range(3):
                own[c][j] = [x + quality.BELIEF_WEIGHT * weight[c] * b for x, b in zip(own[c][j], quality.BELIEF[c].tolist(), strict=True)]
                own[c][j] = [x / sum(own[c][j]) for x in own[c][j]]
        share = (weight[1] + 1) / (len(rows) + 2)
        for k, r in enumerate(rows.tolist()):
            a = math.prod(own[1][j][v + 1] for j, v in enumerate(r)) * share
            b = math.prod(own[0][j][v + 1] for j, v in enumerate(r)) * (1 - share)
            good[k] = a / (a + b)
    assert prior == pytest.approx(share) and np.allclose(shares, own)
    by_pattern = {tuple(p): x for p, x in zip(patterns.tolist(), posterior.tolist(), strict=True)}
    assert [by_pattern[tuple(r)] for r in rows.tolist()] == pytest.approx(good, abs=1e-9)
    assert shares[1, 2, 0] > 0.1 > shares[1, 0, 0]


def test_the_sample_holds_distinct_rows(spark):
    rows = [(1, "a text that comes again and again and says little")] * 300 + [(k, f"text {k} with some words of its own kind {k}") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.classify(df, sample=50).count() == len(rows)
    assert quality.classify(spark.createDataFrame([(1, "words " * 300_000)], "doc_id long, text string")).count() == 1


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://b.net/x?y#z", "ftp://q.example.com/de/2", "http://example.com/den", "http://sub.org/fr/#x", "http://org/fr/", "no scheme", None, "", "http://", "http://h", "http://h?x/y",
    "http://notexample.net/en/3", "x://y://z/w", "http://example.net/en", "http://a.example.net/en/1",
]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", after[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(p), p, a) for a, p in RULES if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[len(p.split("/")[0]) :])]
    return max(fits)[1:] if fits else (None, None)


def plain_scores(texts, labelled, own=None):
    """Log-likelihood differences a character of the two models, from plain dictionaries."""
    alphabet = urls.ALPHABET

    def parts(text):
        folded = "^" * (urls.ORDERS - 1) + "".join(c if c in alphabet[:-1] else "?" for c in text.lower()) + "$"
        code = [(alphabet + "^$").index(c) + 1 for c in folded]
        for at in range(urls.ORDERS - 1, len(folded)):
            cells = [0]
            for k in range(1, urls.ORDERS):
                cells.append(cells[-1] + code[at - k] * (len(alphabet) + 3) ** (k - 1))
            yield code[at], [c % urls.SLOTS for c in cells]

    counts = {v: defaultdict(int) for v in ("allow", "block")}
    for text, verdict in labelled:
        for sym, cells in parts(text):
            for k, c in enumerate(cells):
                counts[verdict][k, c, sym] += 1
                counts[verdict][k, c] += 1
    out = []
    for text in texts:
        total = n = 0
        for sym, cells in parts(text):
            p = {}
            for v in counts:
                p[v] = 1 / (len(alphabet) + 1)
                for k, c in enumerate(cells):
                    p[v] = (counts[v][k, c, sym] + urls.SMOOTHING * p[v]) / (counts[v][k, c] + urls.SMOOTHING)
            total, n = total + math.log(p["allow"]) - math.log(p["block"]), n + 1
        out.append(total / n)
    return out


def test_urls_against_plain_code(spark):
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df, RULES).collect()}
    assert len(got) == len(URLS)
    parts = [plain_parts(u) for u in URLS]
    labelled = sorted({(h + p, plain_rule(h, p)[1], h) for h, p in parts if plain_rule(h, p)[0]})
    want = plain_scores([h + p for h, p in parts], [(t, v) for t, v, _ in labelled])
    for k, (host, path) in enumerate(parts):
        rule, action = plain_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["score"] == pytest.approx(want[k], abs=1e-9)
        assert action in (None, got[k]["verdict"])
    assert urls.judge(df.limit(0), RULES).count() == 0
    unruled = urls.judge(spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string"), RULES).first()
    assert (unruled["verdict"], unruled["score"]) == ("allow", 0.0)


def test_licences_against_plain_search(docs, corpus, nothing):
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    want = []
    for i, t in corpus:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        want.append((repr(i), len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want)
    assert licenses.scan(nothing).count() == 0


def test_matching_statistics():
    rng = random.Random(4)
    texts = [[rng.choice("abc") for _ in range(12)] for _ in range(3)]
    scanner = licenses.Scanner({}, [(str(k), " ".join(t)) for k, t in enumerate(texts)])
    words = [rng.choice("abcd") for _ in range(300)]
    inside = lambda run: any(t[k : k + len(run)] == run for t in texts for k in range(len(t)))
    longest = [max(n for n in range(at + 2) if inside(words[at + 1 - n : at + 1])) for at in range(300)]
    ends = [at for at in range(300) if longest[at] >= licenses.MIN_RUN and (at == 299 or longest[at + 1] != longest[at] + 1)]
    assert [(n, end - 1) for _, n, end in scanner.scan(words)[1]] == [(longest[at], at) for at in ends]


def plain_labels(words, templates):
    """Every run that a template shares with the text, found by comparing all places, chained by trying all pairs."""
    found = []
    for label, template in templates:
        # right-maximal runs: the longest run of any template that ends at a word, unless it goes on
        runs = set()
        for end in range(1, len(words) + 1):
            size = max((n for n in range(end + 1) if any(_has(t, words[end - n : end]) for _, t in templates)), default=0)
            more = end < len(words) and any(_has(t, words[end - size : end + 1]) for _, t in templates)
            if size >= licenses.MIN_RUN and not more:
                runs |= {(end, size, at + size) for at in range(len(template) - size + 1) if template[at : at + size] == words[end - size : end]}
        best, chains = (0, 0, 0), []
        for end, run, stop in sorted(runs):
            own = (run, end - run)
            for text_end, template_end, before, start in chains:
                fresh = min(run, end - text_end, stop - template_end)
                if end - run - text_end <= licenses.MAX_GAP and fresh > 0 and text_end <= end:
                    own = max(own, (before + fresh, start), key=lambda x: (x[0], -x[1]))
            chains.append((end, stop, *own))
            if own[0] > best[0]:
                best = (*own, end)
        size = len(template)
        if best[0] and (size >= licenses.SHORT or best[0] == size == best[2] - best[1]) and best[0] / size >= licenses.MIN_COVER:
            found.append((label, best[1], best[2], best[0] / size))
    return [c for c in found if not any(d[1] <= c[1] and c[2] <= d[2] and d[2] - d[1] > c[2] - c[1] and d[0] != c[0] for d in found)]


def _has(template, run):
    return any(template[k : k + len(run)] == run for k in range(len(template) - len(run) + 1))


def test_labels_and_scores_against_plain_chains():
    rng = random.Random(11)
    templates = [(f"t{k}", [f"w{rng.randrange(60)}" for _ in range(n)]) for k, n in enumerate((6, 14, 20, 30, 30))]
    templates.append(("longer", [*templates[1][1], *(f"v{k}" for k in range(16))]))
    scanner = licenses.Scanner({}, [(label, " ".join(t)) for label, t in templates])
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = list(rng.choice(templates)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = "other"
            words += [*own[rng.choice([0, 0, 3]) :], *(f"x{rng.randrange(9)}" for _ in range(rng.choice([0, 5, 60])))]
        got = sorted(scanner.covered(scanner.scan(words)[1]))
        assert got == sorted(plain_labels(words, templates))


def test_other_licences_get_no_label(spark):
    texts = {
        "Licensed under CC BY-ND 4.0": "cc-by",
        "Licensed under CC BY 4.0.": "cc-by,cc-by-notice",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-notice",
        "x " + licenses.TEMPLATES[16][1] + " y": "mit",
        licenses.TEMPLATES[19][1]: "apache",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).orderBy("doc_id").collect()] == list(texts.values())


def test_templates_are_found_with_changes():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    text = "Permission is hereby granted, free of charge, to any cat obtaining a copy of this software and associated documentation files, the software, to deal in the software without restriction"
    (_, _, _, covered) = next(c for c in scanner.chains(scanner.scan(licenses.words_of(text))[1]) if c[0] == "mit")
    assert covered > 0.9


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(1000 + k, x[40].tolist(), 1) for k in range(30)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1), (2080, [None] * 16, 1), (None, x[3].tolist(), 1), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = nearest.search(df, leaf_rows=100, k=5).toPandas().sort_values(["query_id", "rank"])
    ids, full = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    hit = total = 0
    for q, own in got.groupby("query_id"):
        s = full @ full[list(ids).index(q)]
        s = np.round(s, 12)
        s[list(ids).index(q)] = -np.inf
        want = ids[np.lexsort((ids, -s))[:5]]
        hit, total = hit + len({*want} & {*own.vec_id}), total + 5
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
    assert hit / total >= 0.9
    ordered = got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    assert ordered.vec_id.tolist() == got.vec_id.tolist()
    assert nearest.search(df.limit(0)).count() == 0


def test_chi_square():
    assert nearest.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert nearest.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-6)
