"""Helpers of the training-data tests: small tables with awkward rows."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts, or from (doc_id, text, lang, source) rows."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return build


LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture
def awkward():
    """Null, empty, blank, very long, tied and repeated rows, and rows with null columns."""
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", None, None),
        (4, LONG, "en", "b"),
        (5, "one two three", "de", "b"),
        (6, "one two three", "de", "b"),
        (6, "one two three", "de", "b"),
        (None, "a row without an id", None, "c"),
        (7, "tail\nline\n\nTail \nline", "en", None),
        (8, "É\U0001f600 ünï c\x00de [INST] </s> \\ <s>", "fr", "c"),
    ]
