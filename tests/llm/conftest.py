from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture()
def table(spark):
    """Makes a documents table of texts, with ids from 0."""

    def make(texts, lang="en", source="s.example"):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


ODD = [None, "", " ", "\n", "a", "a", "x\ty  z\n\nw", "é ñ ü 漢字 🦄 ́", "word " * 3000, "one two three four five"]


@pytest.fixture()
def odd(table):
    return table(ODD)
