import random

import pytest

LONG = 40_000


def words(rng, n, size=3):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in", "é", "ß"]) for _ in range(rng.randint(1, size))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near-copies, shared passages, null, empty and very long texts, repeated rows, a null id."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(30, 200)) for _ in range(40)]
    passage = words(rng, 70)
    texts = [*base, base[3], base[3], base[4] + " extra", None, "", "   \n\t ", "x" * 3000, words(rng, LONG // 4), "a", "One Two", "Licensed under CC BY-NC 4.0. All rights reserved"]
    texts += [f"{words(rng, 40)} {passage} {words(rng, 40)}" for _ in range(4)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id here at all but some words")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", 1, "u", 5, 0.5, "fp") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, uid int, ord string, n int, score double, fp string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
