import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


def documents(spark, rows):
    """doc_id, text and columns whose names the operators use themselves."""
    data = [(i, t, "en", f"s{n}", n, n, "x", True, 1) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, kept boolean, shard int")


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
