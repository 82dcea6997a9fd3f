import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tid string, x0 double, gl int, _z binary, u0 int, id int, Text string"


def words(n, rng, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids; extra columns have the operators' own names."""
    rng = random.Random(5)
    body = words(120, rng)
    texts = [
        (1, body, "en", "a"),
        (2, body, "en", "a"),
        (2, body, "en", "a"),
        (3, None, "en", "a"),
        (None, words(80, rng), None, None),
        (None, None, None, None),
        (4, "", "en", None),
        (5, " \t\n ", None, "b"),
        (6, words(40_000, rng), "de", "b"),
        (7, "x" * 200_000, "de", "b"),
        (8, body.replace(" ", "  \n"), "fr", "c"),
        (9, "one two", "fr", "c"),
        (10, "Größe «naïve»\u00a0 中文 🙂 " * 30, "de", "c"),
        (11, "a " * 500, "en", "c"),
        (12, words(60, rng) + " " + " ".join(body.split()[10:70]), "en", "b"),
        (13, "12345 67890 !!! ???", "en", "b"),
    ]
    return [(i, t, lang, s, None, "k", "t", 1.0, 2, b"z", 3, 4, "T") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
