from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, ids from 0, all of one source unless given."""

    def make(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty and blank texts, copies, odd white space, several scripts and a very long word."""
    return [None, "", "   \n", "a b c d e f", "a b c d e f", "É ü ß ñ 漢字 ЖЖ", "x\x1cy z", "ab" * 30_000, "one two\nthree\n\nfour five six " * 300, "<|endoftext|> don't"]
