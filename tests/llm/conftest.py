import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, cell int, label int, fp bigint, `rank` int, _size int"


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, 3, 4, 5, 6)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    base, long = words(rng, 60), words(rng, 60_000)
    return [doc(1, base), doc(2, base), doc(2, base), doc(3, base.upper()), doc(4, None), doc(5, ""), doc(6, " \t\n "), doc(7, long),
            doc(8, long + " tail"), doc(None, base), doc(None, "alone " + words(rng, 30)), doc(9, "Ünïcödé 文字 \u0000 x", None, None),
            doc(10, "one"), doc(11, "one two three"), (12, "x y z v w", None, None, None, None, None, None, None, None, None),
            doc(None, None, None, None), doc(-5, base + " more"), doc(20, "1234 !!"), *[doc(100 + k, words(rng, 50)) for k in range(20)]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2, "x") for k in range(100, 120)] + [(1, None, 3, "x"), (2, 0, 0, "x"), (2, 1, 1, "x"), (None, 1, 1, None)],
                                 "doc_id bigint, quality int, toxic int, text string")
