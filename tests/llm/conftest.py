import random

import pytest

LONG = "un mot " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("ab cdefghilmnoprstu".replace(" ", "")) for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    return [
        (1, prose(1), "xx", "s", 3),
        (2, prose(1), "xx", "s", 3),
        (2, prose(1), "xx", "s", 3),
        (3, None, "yy", None, None),
        (4, "", None, "s", 0),
        (None, prose(1), None, None, None),
        (None, None, None, None, None),
        (5, LONG, "yy", "hot", len(LONG)),
        (6, " \n\t", "xx", "hot", 3),
        (7, prose(7), "yy", "hot", 1),
        (8, "12 34 !!", "xx", "hot", 1),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("h", F.lit(2)).withColumn("score", F.lit(None).cast("double"))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
