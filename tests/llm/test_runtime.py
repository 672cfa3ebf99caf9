"""The bounded filter ahead of joins, written tables, and rolling hashes."""

import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import runtime
from lectern.llm.words import U, grams, hashes, mix, prefix, split_words


def test_likely_and_without(spark, monkeypatch):
    rows = [(i, f"t{i}") for i in range(2000)] + [(None, "null"), (5, "again")]
    df = spark.createDataFrame(rows, "id long, bits string")
    for bits in (1 << 26, 1 << 16):
        monkeypatch.setattr(runtime, "LEAST_BITS", min(bits, runtime.LEAST_BITS))
        monkeypatch.setattr(runtime, "MOST_BITS", bits)
        for keys in ([], [5], list(range(0, 4000, 7)), [None, 3]):
            k = spark.createDataFrame([(x,) for x in keys], "id long")
            kept = {(r.id, r.bits) for r in runtime.likely(df, "id", k).collect()}
            want = {r for r in rows if r[0] in keys and r[0] is not None}
            assert want <= kept and (bits < 1 << 20 or len(kept) <= len(want) + 3)
            rest = runtime.without(df, "id", k)
            assert rest.columns == df.columns and sorted(map(str, rest.collect())) == sorted(map(str, df.join(k, "id", "left_anti").select("id", "bits").collect()))


def test_with_few(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x") for i in range(300)] + [(None, "y"), (7, "z")], "id long, t string")
    table = runtime.keep(spark.createDataFrame([(7, "seven"), (500, "none"), (9, "nine")], "id long, said string"))
    want = sorted(map(str, df.join(table, "id", "left").select("id", "t", "said").collect()))
    for rows in (runtime.BROADCAST_ROWS, 1):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
        assert sorted(map(str, runtime.with_few(df, "id", table).select("id", "t", "said").collect())) == want


def test_shared_folder_off_local_masters(monkeypatch):
    """Without a shared folder a cluster is refused; a local master has a folder of its own."""
    import pytest

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_keep_and_sweep(spark):
    df = runtime.keep(spark.range(5).selectExpr("id", "cast(null AS string) AS s"))
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(path) and path.startswith(runtime.shared_dir(spark).removeprefix("file://"))
    runtime.sweep()
    assert not os.path.exists(path)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 8))
def test_grams(xs, k):
    """Equal sequences, and only these, have equal names wherever they stand."""
    names = hashes([b"w%d" % x for x in xs])
    n = len(xs) - k + 1
    if n > 0:
        got = grams(prefix(names), np.arange(n), k)
        for i in range(n):
            for j in range(i):
                assert (got[i] == got[j]) == (xs[i : i + k] == xs[j : j + k])


def test_words_and_mix():
    assert split_words("a\x1cb\x85c \x0bd\xa0e".encode()) == ["a\x1cb\x85c".encode(), "d\xa0e".encode()] and split_words(None) == []
    x = np.arange(10_000, dtype=U)
    assert len(np.unique(mix(x))) == len(x)
