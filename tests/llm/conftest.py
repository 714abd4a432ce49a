import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, media string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    prose = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t), "m", 0.5) for i, t in enumerate(prose)]
    rows += [(100, None, None, None, None, None, None), (None, "no id here", "en", "s", 1, "m", 0.1), (101, "", "", "", 0, "", 0.0), (102, "\n \t\n", "en", "s", 3, "m", 0.0)]
    rows += [(103, "word " * 50_000, "en", "s", 250_000, "m", 0.0), (104, "x" * 300_000, "en", "s", 300_000, "m", 0.0), (105, "é😀ß   " * 40, "de", "s", 1, "m", 0.0)]
    rows += [(0, prose[0], "en", "s", 1, "m", 0.5), (200, prose[1], "en", "t", 1, "m", 0.5), (200, prose[1], "en", "t", 1, "m", 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source", "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
