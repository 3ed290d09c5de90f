from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) tuples."""

    def build(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def some_docs(spark):
    """The smallest documents table, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Texts that every operator must survive: empty, blank, odd characters, very long, no boundary.
ODD = [
    (1, ""), (2, None), (3, " \t\n"), (4, "a"), (5, "a"), (6, "A  a b　c\x1c\x85 d"),
    (7, "\U0001f600 é İΣ don't we'll"), (8, "x" * 70000), (9, "ab c\n" * 9000), (10, " " * 40000 + "z"),
    (None, "no id"), (11, "<|endoftext|> <|startoftext|>"), (11, "same id"), (12, "\u0000nul"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)
