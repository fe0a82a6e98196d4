from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
#: Rows with NULLs, empty and very long texts, ties and repeats; the extra columns clash with inner names.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big house\nsecond line of the text which is long enough"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "a text without an id that still has enough words to be compared with others here"),
    (5, LONG),
    (5, LONG),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the big house\nsecond line of the text which is long enough"),
    (7, "x"),
    (2 ** 60 + 1, "çédille 漢字 \U0001f600 it's 12345 don't   stop <|endoftext|>"),
    (8, "y" * 5000),
]
EXTRA = ("row_id", "length", "tie", "no_id", "line", "keep", "piece", "n_kept", "line_doc", "label", "x", "a.b")


@pytest.fixture(scope="session")
def odd(spark):
    kind = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *([None] * len(EXTRA))) for r in ODD], kind)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
