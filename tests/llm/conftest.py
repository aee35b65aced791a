import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, place string, mark double, label string, k1 string, _n int, bands string, keep_0 string, shingles string, component_id int, _row string, rank int"


def make(spark, rows):
    """documents with extra columns that clash with the operators' own names."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, "x", 0.5, "l", "k", 2, "b", "keep", "s", 3, "r", 4) for r in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.replace("w1", "w2", 1)
    long = words(rng, 30_000, 5000)
    key = "AKIA" + "QWERTY123456ZXCV"
    return [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", None), (3, near, "en", None), (4, None, "en", "a"), (5, "", None, "a"), (6, " \n\t ", "de", "b"), (7, long, "de", "c"),
        (8, "one two", "fr", "c"), (9, "one two", "fr", "c"), (None, "a row without an id " + base, "en", "a"), (10, f'token = "abcDEF12345678" and {key} here é {"0123456789abcdef" * 2}', "en", "a"),
        (11, f'password: "short" é token=abcDEF12345678 {key}', "en", "b"), (12, "12345 67890 !!!", "en", "c"), (13, "ONE\x0bTWO\x0cTHREE four five six seven", "es", "c"), (14, "line one here\nline two\nline one here\n\nline one here", "es", "a"),
    ]


@pytest.fixture()
def edge(spark):
    return make(spark, edge_rows())


@pytest.fixture()
def empty(spark):
    return make(spark, [])
