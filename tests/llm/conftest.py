from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Nulls, empty and blank texts, ties, repeated rows, odd characters, a very long text.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 5),
    (4, "Same Text here, twice.", "en", "b", 22),
    (5, "same text here, TWICE.", "en", "b", 22),
    (5, "same text here, TWICE.", "en", "b", 22),
    (6, "Straße É é İ Σς \U0001f600 é", "de", "\U0001f600", 20),
    (7, "mail a.b@c.de or +1 (499) 555-6503, 10.0.0.1 4111 1111 1111 1111 mit license", "en", "a", 60),
    (8, "word " * 30000, "en", "b", 150000),
    (9, "x" * 200000, "fr", "c", 200000),
    (10, "one two", "en", "c", 7),
    (11, "One  two", "en", None, 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, size int, digest string, fp int"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_texts():
    return [(i, t) for i, t, *_ in ODD]
