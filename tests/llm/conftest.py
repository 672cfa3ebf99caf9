import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows, a very long text."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x1", "über"]) + str(r.randint(0, 400)) for _ in range(60_000))
    same = " ".join(f"w{i}" for i in range(60))
    return [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, same + " tail", None, None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \t\n\x0b\x0c\r ", "de", "b"), (7, "one two", "de", None), (8, "One\x0ctwo", "fr", "c"), (9, long, "en", "c"),
        (10, "a " * 3000, "en", "c"), (11, " \x85\xa0 \U0001d465 ß", "de", "c"), (12, "1 2 3 !!! ###", None, "c"), (None, "no id here at all", "en", "a"),
        (13, "the same line\n" * 30, "en", "a"), (14, same.upper(), "en", "d"),
    ]
