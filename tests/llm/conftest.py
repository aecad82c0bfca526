import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, findings string, score string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(600)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with columns whose names clash with results."""

    def make(texts, langs=None, sources=None):
        rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or ""), "own node", "own findings", "own score")
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """NULLs in every column, empty, wordless and very long texts, and repeated rows."""
    rng = random.Random(5)
    long_text = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [(None,) * 8, (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "n", "f", "x"),
            (3, "!!! ...", "en", "s", 7, "n", "f", "x"), (4, long_text, "en", "s", 1, "n", "f", "x"),
            (4, long_text, "en", "s", 1, "n", "f", "x"), (5, "one", "en", None, 3, "n", "f", "x"),
            (None, "a text without any id at all", "en", "s", 3, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
