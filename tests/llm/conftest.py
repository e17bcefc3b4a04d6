from __future__ import annotations

import os

import pytest

# Matrix products in Spark's Python workers use one thread per task, as on a cluster.
os.environ.setdefault("OMP_NUM_THREADS", "1")

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, fingerprint string, copies int, _kept_id int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "b"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "de", "a"),
        (6, long_text, "en", "b"),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund am Fluß und die Katze", "de", None),
        (8, "12345 !!! ???", "en", "a"),
        (None, "A row without an id but with a text of its own", None, "b"),
        (None, None, None, None),
        (9, "naïve 𝒳𝒴 <|endoftext|> é ́x it's WE'RE", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, None, "s", None, "f", 3, 1) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
