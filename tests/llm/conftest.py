import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string, _id string, lines string"


@pytest.fixture(scope="session")
def table(spark):
    """name -> the table at sf0.001."""
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rnd = random.Random(3)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(200)]
    long_text = " ".join(rnd.choice(words) for _ in range(60_000))
    one = " ".join(rnd.choice(words) for _ in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long_text), (5, one), (5, one), (6, one), (None, one), (None, None),
            (7, "one"), (8, "one two\n\none two"), (9, "x" * 600_000), (10, "Cc BY-nc 4.0 all RIGHTS reserved"),
            (11, one + "\n" + one), (12, "🙂 naïve don't  stop it's 'tis 100%\r\n\r\n"), (13, one.replace("w1 ", "zz ", 1))]
    return spark.createDataFrame([(i, t, "e", "clash", "clash") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
