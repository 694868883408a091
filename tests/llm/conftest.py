import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must stand: nulls, empty and long texts, ties, repeats, and clashing columns."""
    long = prose(1, 6000) + "\n" + "x" * 40_000
    rows = [
        (1, prose(2, 80), "en"),
        (2, prose(2, 80), "en"),
        (2, prose(2, 80), "en"),
        (3, None, None),
        (4, "", "fr"),
        (5, " \n\t ", "xx"),
        (6, long, "en"),
        (7, prose(3, 60) + "\n" + prose(4, 60) + "\n" + prose(3, 60), "de"),
        (8, "naïve café ☕ 中文字符 Привет мир " * 12, None),
        (None, prose(5, 70), "en"),
        (None, None, None),
    ]
    full = [(*r, 1, "c", "k", 0.5, [1]) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, doc int, copy string, key string, score double, lines array<int>").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
