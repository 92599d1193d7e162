import random

import pytest

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "ra", "si", "to", "vu") for b in ("n", "r", "st", "ld", "mp", "x", "", "ck", "sh", "th")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, repeated rows and one id with two texts."""
    rng = random.Random(3)
    long = prose(rng, 9_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, long), (7, long), (8, "Same text, twice. " * 12),
            (8, "Same text, twice. " * 12), (9, "first of nine " + prose(rng, 60)), (9, "second of nine " + prose(rng, 60)),
            (10, "é ß 日本 \U0001f600 " * 30), (11, "a" * 5_000), (12, "x\x00y\x1c\x85z " * 20)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 5, "k", [1], 0.5, None) for i, t in odd_rows],
                                 "doc_id long, text string, lang string, key long, _id string, ids array<int>, score double, n_tokens long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
