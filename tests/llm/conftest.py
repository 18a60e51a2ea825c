import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu pra sto".split() for b in "ra tin sel mo ka".split()]


@pytest.fixture(scope="session")
def make_text():
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null columns, empty and long texts, repeated rows, columns with clashing names."""
    long = "word " * 30_000
    rows = [
        (1, None, "en", "a", None, "x"),
        (2, "", None, None, 0, "y"),
        (3, long, "en", "a", len(long), "z"),
        (3, long, "en", "a", len(long), "z"),
        (None, "some text of no one", None, "b", 19, None),
        (None, None, None, None, None, None),
        (4, "\n\n  \n", "de", "b", 5, "w"),
        (5, "ünïcode – “quotes” and 日本語のテキスト", "ja", "ä", 30, "toxicity"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
