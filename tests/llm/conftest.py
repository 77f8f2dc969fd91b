import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, source]) as a documents table."""

    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *(7 for _ in extra)) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} int" for c in extra))

    return make


def prose(n, seed, size=400):
    """``n`` words, different for different seeds."""
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}x{seed % 7}" for _ in range(n))
