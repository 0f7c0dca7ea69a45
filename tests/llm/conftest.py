import random

import pytest


@pytest.fixture
def docs_of(spark):
    """Rows (doc_id, text, lang, source) with extra columns whose names operators use inside."""

    def make(rows):
        full = [
            (doc_id, text, lang, source, 0 if text is None else len(text), "x", 1, 2)
            for doc_id, text, lang, source in (
                (*row, *("en", "s")[len(row) - 2 :]) if len(row) < 4 else row for row in rows
            )
        ]
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "line string, row long, first int"
        )
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def words():
    """Seeded prose: ``words(n)`` gives n words."""
    source = random.Random(11)
    syllables = ["er", "on", "ti", "the", "an", "re", "ing", "st", "le", "or", "de", "qu"]

    def prose(n, source=source):
        return " ".join(
            "".join(source.choice(syllables) for _ in range(source.randint(1, 4)))
            for _ in range(n)
        )

    return prose


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (6, "é" * 3000 + " " + "word " * 20_000),
    (None, "a row without an id, twice"),
    (None, "a row without an id, twice"),
    (7, "*** --- !!!"),
]


@pytest.fixture
def edges(docs_of):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return docs_of([*EDGES, (8, "no language here", None, None)])


@pytest.fixture
def nothing(docs_of):
    return docs_of([(1, "x")]).limit(0)
