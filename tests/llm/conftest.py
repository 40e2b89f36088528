import random

import pytest

WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "ra") for b in ("n", "st", "l", "r") for c in ("a", "e", "o", "ing", "er")]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, id long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table with extra columns whose names clash with results."""

    def make(rows, source="s"):
        return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source(i), len(t or ""), 0.5, 1, 7) for i, t in rows], DOC)

    return make


@pytest.fixture
def rng():
    return random.Random(11)
