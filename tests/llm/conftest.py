import random

import pytest

WORDS = "the of and to in is on that by this with you it not or be are from at as for was an river stone green paper little house".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded invented sentences."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er", "s"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls, empty, very long and repeated texts, repeated ids, and columns of clashing names."""
    long_text = prose(1, 40_000)
    base = prose(2, 120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " tail", "en", None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, "   \n\t ", "de", "b"),
        (7, "one two", "de", "a"),
        (None, prose(3, 50), "de", "a"),
        (None, prose(3, 50), "de", "a"),
        (8, prose(4, 60), "fr", "c"),
        (8, prose(4, 60), "fr", "c"),
        (8, prose(5, 60), "fr", "c"),
        (9, long_text, None, "c"),
        (10, "é" * 500, "fr", "ü"),
        (11, "\U0001f600 ñandú 1d10t <|endoftext|> x", "es", "c"),
    ]
    names = ("row", "score", "i", "t", "size", "shard", "component_id", "spans", "ids", "pll", "copies", "part", "p", "draw", "block")
    rows = [(*r, len(r[1] or ""), *("x" for _ in names)) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -5")
