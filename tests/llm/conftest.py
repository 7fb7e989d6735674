import random

import pytest

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int, kinds: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}" for _ in range(n))


@pytest.fixture
def odd(spark):
    """Null ids, null, empty, blank and very long texts, repeated rows, and further columns whose names clash with ours."""
    long = words(1, 60_000)
    rows = [
        (1, "a few words here"), (2, None), (3, ""), (4, " \n\t"), (5, "!!! ???"), (None, words(2, 80)), (7, long), (8, long), (9, "one"), (9, "one"), (10, words(3, 120)), (10, words(4, 130)),
        (11, "Ünïcödé ß 字 " * 40), (12, "x" * 100_000),
    ]
    return spark.createDataFrame([(i, t, 0.5, "r", 1, 2, [3], True) for i, t in rows], "doc_id bigint, text string, score double, rest string, size long, n_words int, spans array<int>, key boolean")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], KIND)
