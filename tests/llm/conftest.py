from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Texts of n words that differ by their seed."""
    import random

    syllables = ["the", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make
