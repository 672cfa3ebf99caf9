"""Jaccard join and substring dedup against comparing everything with everything."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from corpus import make
from lectern.llm import jaccard, recompress
from lectern.llm.components import components
from lectern.llm.words import hashes


def components_of(spark, rows, **k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(spark, rows, **k)).collect()}


def edits(r, base, n):
    w = list(base)
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [f"e{r.randrange(9999)}"], [w[i], f"i{r.randrange(9999)}"]])
    return " ".join(w)


def test_near_copies(spark, monkeypatch):
    """Chains of copies, shared passages and one large group, in blocks small enough to take the second round."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 6)):
            w = edits(r, base, r.randint(0, 6)).split()
            if r.random() < 0.4:
                w = w[:5] + passage + w[5:]
            rows.append(" ".join(w))
            base = w if r.random() < 0.5 and len(w) > 2 else base
    hub = [r.choice(vocabulary) for _ in range(100)]
    rows += [edits(r, hub, r.choice([0, 1, 2, 3, 4, 5, 8])) for _ in range(150)]
    rows += [" ".join(hub)] * 20
    r.shuffle(rows)
    docs = [(i, t, "en", "s") for i, t in enumerate(rows)]
    assert components_of(spark, docs) == brute.jaccard([(d, t) for d, t, *_ in docs])


@pytest.mark.parametrize("fan", [4, 2048])
def test_shingle_in_every_document(spark, monkeypatch, fan):
    """One passage in all documents, ranges dealt at once or in two steps, with its shingles known as frequent."""
    from lectern.llm import dealing

    for name, value in (("RANGE", 500), ("FLUSH", 700), ("LEAST_SAMPLE", 1000), ("SHARE", 2), ("FREQUENT", 20), ("SEEN", 10), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(dealing, "FAN", fan)
    r = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(60):
        base = common + [f"v{r.randrange(10**6)}" for _ in range(r.randint(0, 60))]
        rows += [edits(r, base, r.randint(0, 5)) for _ in range(r.randint(1, 4))]
    rows += [rows[3]] * 15 + [" ".join(common)] * 5
    r.shuffle(rows)
    docs = [(i, t, "en", "s") for i, t in enumerate(rows)]
    assert len(jaccard.frequent_shingles(make(spark, docs).select("doc_id", "text"), 10_000)) >= 20
    assert components_of(spark, docs) == brute.jaccard([(d, t) for d, t, *_ in docs])


def test_chained_groups(spark, monkeypatch):
    """A large candidate component whose documents hang together in a chain: only pairs of blocks with a shingle in common meet."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(3000)]
    rows = [" ".join(words[10 * i : 10 * i + r]) for i in range(200) for r in (100, 96)]
    docs = [(i, t, "en", "s") for i, t in enumerate(rows)]
    assert components_of(spark, docs) == brute.jaccard([(d, t) for d, t, *_ in docs])


def test_shingles_that_fall_together(spark, monkeypatch):
    """Shingles whose names agree on the way to their range are both kept: no link is lost at the very bound."""
    r = random.Random(2)
    rows = []
    for g in range(25):
        base = [f"v{r.randrange(10**6)}" for _ in range(84)]  # 80 shingles; 75 % of the union at the least
        rows += [" ".join(base), " ".join([*base[: 84 - 10], *(f"x{r.randrange(10**6)}" for _ in range(10))])]
        rows += [" ".join([*base, *(f"y{r.randrange(10**6)}" for _ in range(26))])]
    docs = [(i, t, "en", "s") for i, t in enumerate(rows)]
    want = brute.jaccard([(d, t) for d, t, *_ in docs])

    def coarse(table):  # 32 bits are cut to 5: in each range, many shingles of a set fall together
        got = table.column("names").to_pylist()
        names = [(np.frombuffer(x, np.uint32) & np.uint32(31)).tobytes() for x in got]
        return table.set_column(table.schema.get_field_index("names"), "names", pa.array(names, pa.binary()))

    import pyarrow as pa

    plain = jaccard._shared
    monkeypatch.setattr(jaccard, "_shared", lambda parts: (lambda run: lambda table: run(coarse(table)))(plain(parts)))
    assert components_of(spark, docs) == want


def test_odd_texts(spark, odd):
    got = jaccard.jaccard_components(make(spark, odd)).collect()
    assert len(got) == len(odd)
    want = brute.jaccard([(d, t) for d, t, *_ in odd if d is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert jaccard.jaccard_components(make(spark, [])).collect() == []
    assert components_of(spark, [(1, None, None, None), (2, "", None, None)]) == {1: (0, 1), 2: (0, 2)}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(80)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("flush", [200, 1_000_000])
def test_repeats(spark, monkeypatch, flush):
    monkeypatch.setattr(recompress, "FLUSH", flush)
    r = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 120)] + [["z"] * 40, ["p", "q"] * 30]
    rows = []
    for d in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
            if r.random() < 0.4:
                p = r.choice(passages)
                w += p[r.randint(0, 3) : len(p) - r.randint(0, 3)] if r.random() < 0.5 else p
        rows.append((d, r.choice([" ", "\n", "\t "]).join(w), "en", "s"))
    rows += [(500 + i, rows[7][1], "en", "s") for i in range(3)]
    got = recompress.remove_repeats(make(spark, rows)).select("doc.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats([(d, t) for d, t, *_ in rows]))


def test_repeats_of_odd_texts(spark, odd):
    got = recompress.remove_repeats(make(spark, odd)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.repeats([(d, t) for d, t, *_ in odd]), key=key)
    for r in got:
        assert r.doc.found == "x"
        if r.n_removed == 0:
            assert r.kept_text == r.doc.text
        else:
            assert len(brute.words(r.kept_text)) == r.n_words - r.n_removed
    assert recompress.remove_repeats(make(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=35, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_symbol_starts_agree(window, before, after):
    """Whatever stands around a 35-word window, one symbol of one name starts at one common place in its first 18 words."""
    window = window[:35]
    word = lambda xs: hashes([str(x).encode() for x in xs])
    inside = []
    for a, b in (([], []), (before, after), (after, before)):
        words = word(a + window + b)
        at, names = recompress.symbols(words, np.zeros(len(words), int))
        inside.append({(int(x) - len(a), int(n)) for x, n in zip(at, names) if 0 <= x - len(a) <= recompress.REACH})
    assert set.intersection(*inside)


@pytest.mark.parametrize("fan", [3, 2048])
def test_ranges_in_two_steps(spark, monkeypatch, fan):
    """Many ranges, dealt at once or in two steps, with one window in every document and a memory of few sent names."""
    monkeypatch.setattr(recompress, "FAN", fan)
    monkeypatch.setattr(recompress, "FLUSH", 300)
    monkeypatch.setattr(recompress, "RANGE_BYTES", 500)
    monkeypatch.setattr(recompress, "SENT", 20)
    r = random.Random(3)
    everywhere = " ".join(f"e{i}" for i in range(40))
    rows = [(d, " ".join(f"t{r.randrange(10**6)}" for _ in range(r.randint(0, 50))) + f" {everywhere if d % 3 else ''} " + " ".join(f"t{r.randrange(10**6)}" for _ in range(9)), "en", "s") for d in range(150)]
    got = recompress.remove_repeats(make(spark, rows)).select("doc.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats([(d, t) for d, t, *_ in rows]))


def test_map_time_is_flat():
    """What a task does for gathered words doesn't grow with the number of ranges."""
    import time

    import pyarrow as pa

    r = random.Random(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([" ".join(f"w{r.randrange(10**5)}" for _ in range(500)) for _ in range(400)])], ["row", "text"])
    spent = {}
    for parts in (1_000, 1_000_000):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            blobs = sum(b.num_rows for b in recompress._entries(parts, recompress._anchors, True)([batch]))
            best = min(best, time.perf_counter() - began)
        spent[parts] = best
        assert blobs <= 2 * recompress.FAN
    assert spent[1_000_000] < 2 * spent[1_000] + 0.05


def test_cut():
    gone = np.array([False, True, True, False, True])
    assert recompress.cut(b" a  b c\n\nd e ", gone) == b" a\nd" and recompress.cut(b"a b c d e", ~gone) == b"b c\ne"


def test_overlaps_in_ranges_of_names(monkeypatch):
    """The same counts however many names are looked at together, and little memory beside the sets."""
    import tracemalloc

    import numpy as np

    from lectern.llm import jaccard

    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    sets = [np.sort(r.choice(pool, r.integers(1, 900), replace=False)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for some in (50, 1000, 10**9):
        monkeypatch.setattr(jaccard, "PASS", some)
        got = jaccard._overlaps(sets)
        assert all(got[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j)  # what only one set has isn't counted
    monkeypatch.setattr(jaccard, "PASS", 200_000)
    large = [np.sort(r.integers(0, 1 << 63, 500_000, dtype=np.uint64)) for _ in range(8)]
    tracemalloc.start()
    jaccard._overlaps(large)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
