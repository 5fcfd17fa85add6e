import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + tuple(1 for _ in extra) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} int" for c in extra))

    return make


def invented(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
