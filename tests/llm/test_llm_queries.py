"""Registered queries against their SQL, the pipeline stage by stage, and the registry."""

import pytest

from compare import connect, normal
from lectern.llm.queries import QUERIES, SQL
from lectern.llm.runtime import keep

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(connect(SF).sql(SQL[name]).df())


def test_registry(spark):
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    sizes = [docs.count()]
    for name, stage in c.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF))
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        else:
            assert docs.schema.names == before.schema.names and docs.join(before, "doc_id", "left_anti").isEmpty()
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4] > 0.6 * sizes[0]


def brute_quality(docs):
    """doc_ids kept: base rules, and weak documents of hosts whose shrunk rate is over 0.9."""
    import brute

    rows = []
    for d in docs:
        n, chars, symbols, dup, again = brute.rules(d.text)
        lines = [x for x in (d.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = n < 20 or 100 * again > 30 * n
        weak = failed or 100 * symbols > 10 * chars or 100 * dup > 30 * len(lines) or chars < 2 * n or chars > 15 * n
        rows.append((d.doc_id, d.source, failed, weak))
    hosts = {}
    for _, h, _, weak in rows:
        k = hosts.setdefault(h, [0, 0])
        k[0] += weak
        k[1] += 1
    n, m = len(rows), sum(r[3] for r in rows) / len(rows)
    between = (sum(k * k / c for k, c in hosts.values()) - n * m * m - (len(hosts) - 1) * m * (1 - m)) / (n - 1)
    s = min(10_000, max(2, m * (1 - m) / between - 1)) if between > 0 else 10_000
    rate = {h: (k + m * s) / (c + s) for h, (k, c) in hosts.items()}
    return {d for d, h, failed, weak in rows if not (failed or weak and rate[h] > 0.9)}


def brute_leaks(docs, items):
    """doc_ids with a run of an item's words, stripped and lower-cased, of 13 words or 60 % of it."""
    plain = lambda t: [x for w in t.split() if (x := w.strip(".,;:!?#*$%&|").lower())]
    items = [plain(t) for t in items]
    out = set()
    for d in docs:
        w = plain(d.text)
        places = {}
        for i, x in enumerate(w):
            places.setdefault(x, []).append(i)
        for item in items:
            best, last = 0, {}
            for x in item:
                last = {i: last.get(i - 1, 0) + 1 for i in places.get(x, ())}
                best = max([best, *last.values()])
            if best >= 8 and (best >= 13 or 100 * best >= 60 * len(item)):
                out.add(d.doc_id)
    return out


def test_pipeline_against_brute_force(spark):
    import zlib

    import brute
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from lectern.llm.packing import cuts

    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    docs = keep(stages["quality_rules"](spark, docs, SF))
    after = docs.collect()
    assert {d.doc_id for d in after} == brute_quality(before)
    docs = keep(stages["ngram_jaccard"](spark, docs, SF))
    groups = brute.jaccard([(d.doc_id, d.text) for d in after])
    before, after = after, docs.collect()
    assert {d.doc_id for d in after} == {d for d, (_, comp) in groups.items() if d == comp}
    docs = keep(stages["substring_dedup"](spark, docs, SF))
    want = {d: (n, gone, sha) for d, n, gone, sha in brute.repeats([(d.doc_id, d.text) for d in after])}
    texts = {d.doc_id: d.text for d in after}
    after = docs.collect()
    for d in after:
        n, gone, sha = want[d.doc_id]
        import hashlib

        assert hashlib.sha256(" ".join(brute.words(d.text)).encode()).hexdigest() == sha and d.n_chars == len(d.text)
        assert gone or d.text == texts[d.doc_id]
    docs = keep(stages["decontamination"](spark, docs, SF))
    leaks = brute_leaks(after, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    before, after = after, docs.collect()
    assert {d.doc_id for d in after} == {d.doc_id for d in before} - leaks
    rows = stages["packing"](spark, docs, SF).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for d in after:
        ids = np.array(exact.encode(d.text, add_special_tokens=False).ids + [2], "<u4")
        pieces += [(d.doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(ids)))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(pieces)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_stages_of_odd_tables(spark, odd):
    """Each stage on nulls, empty and long texts, repeated rows and clashing columns, and on an empty table."""
    import corpus_pipeline as c
    from corpus import make

    want = {
        "quality_rules": {1, 2, 3, 9, 14}, "ngram_jaccard": {None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13},
        "substring_dedup": {None, *range(1, 15)}, "decontamination": {None, *range(1, 15)},
    }
    for name, stage in c.STAGES:
        docs = make(spark, odd)
        got = stage(spark, docs, SF)
        if name == "packing":
            assert sorted((r.doc_id or 0) for r in got.where("piece = 0").collect()) == sorted((d or 0) for d, *_ in odd)
        else:
            rows = got.collect()
            assert got.columns == docs.columns and {r.doc_id for r in rows} == want[name], (name, {r.doc_id for r in rows})
            if name in ("substring_dedup", "decontamination"):
                assert len(rows) == len(odd)
            if name == "substring_dedup":
                assert {r.doc_id: r.text for r in rows}[4] is None and {r.text for r in rows if r.doc_id in (1, 2)} == {""}
        assert stage(spark, make(spark, []), SF).count() == 0
