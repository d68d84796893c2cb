from __future__ import annotations

import pytest

from clientela.llm.shipping import ship

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(spark):
    ship(spark)
    return spark


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def build(rows, lang="en"):
        full = [(i, t, lang, f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENT)

    return build


# Null id and text, empty, blank, short, ties, repeated rows, a long text.
ODD = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "short"),
    (6, "one  two three\nfour five six seven"),
    (6, "one  two three\nfour five six seven"),
    (None, "one two three four five six seven"),
    (None, None),
    (7, "çà et là, 12 mots — ne s’arrête pas"),
    (8, " ".join(f"w{i}" for i in range(30_000))),
    (9, "x" * 100_000),
]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def clashing(odd):
    """The odd rows with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = (
        "kept", "digest", "keep_id", "component_id", "block", "bucket", "rank", "salt", "score", "rate", "copies",
        "tokens", "words", "place", "length", "text_hash", "features", "quality", "domain",
    )
    for name in names:
        odd = odd.withColumn(name, F.lit("x"))
    return odd


@pytest.fixture
def empty(make):
    return make([]).where("false")
