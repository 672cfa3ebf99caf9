"""Quality rules against plain counting, host verdicts, and the quality classifier."""

import random

import brute
from corpus import make
from lectern.llm.quality_eb import quality
from lectern.llm.quality_rules import kept_rows, quality_verdicts


def test_rules(spark, odd):
    got = quality_verdicts(make(spark, odd)).collect()
    assert len(got) == len(odd)
    by = {t: brute.rules(t) for _, t, *_ in odd}
    seen = {r.doc_id: r for r in got}
    for d, t, *_ in odd:
        r = seen[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by[t]
        assert r.base_failed == (by[t][0] < 20 or 100 * by[t][4] > 30 * by[t][0])
        assert not (r.base_failed and r.kept)
    assert quality_verdicts(make(spark, [])).count() == 0 and kept_rows(make(spark, [])).count() == 0


def test_hosts(spark):
    """A host of junk loses its weak documents and keeps its clean one; elsewhere a weak document stays."""
    r = random.Random(4)
    clean = lambda: " ".join(f"word{r.randrange(10**6)}" for _ in range(40))
    junk = lambda: " ".join(f"w{r.randrange(10**6)}***" for _ in range(40))
    rows = [(i, junk(), "en", "bad") for i in range(60)] + [(100, clean(), "en", "bad"), (101, junk(), "en", "good"), (102, junk(), "en", None)] + [(200 + i, clean(), "en", "good") for i in range(60)]
    rows += [(300, junk(), "en", "tiny")]
    docs = make(spark, rows)
    kept = {x.doc_id for x in quality_verdicts(docs).where("kept").collect()}
    assert kept == {100, 101, 102, 300} | set(range(200, 260))
    rest = kept_rows(docs)
    assert {x.doc_id for x in rest.collect()} == kept and rest.schema == docs.schema


def test_quality(spark, odd):
    r = random.Random(6)
    good = lambda: ". ".join(" ".join(r.choice(["some", "plain", "words", "in", "order", "here"]) for _ in range(9)).capitalize() for _ in range(8))
    bad = lambda: " ".join(r.choice(["BUY", "NOW"]) + "!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "en", f"s{i % 7}") for i in range(600)] + [(None if d is None else 1000 + d, t, lang, s) for d, t, lang, s in odd]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality(make(spark, rows), labels, "source", "lang")
    held = [x for x in got.where("doc_id < 600 AND doc_id % 2 = 1").collect()]
    assert got.count() == len(rows) and sum(x.kept == (x.doc_id % 3 > 0) for x in held) > 0.98 * len(held)
    assert all(0 <= x.posterior <= 1 and x.path_posterior is not None for x in got.collect())
    assert quality(make(spark, []), labels, "source", "lang").count() == 0
    assert {x.kept for x in quality(make(spark, rows[:5]), labels.limit(0), "source", "lang").collect()} <= {True, False}


def brute_posteriors(rows):
    """Host, path and document posteriors from (host, path, evidence), group by group."""
    import math

    import numpy as np

    def strength(groups, parent):
        n, k = sum(len(v) for v in groups.values()), len(groups)
        if k < 2 or n <= k:
            return 10_000.0
        inner = sum(len(v) * max(0.0, np.mean(np.square(v)) - np.mean(v) ** 2) for v in groups.values()) / (n - k)
        between = (sum(len(v) * (np.mean(v) - parent[g]) ** 2 for g, v in groups.items()) - (k - 1) * inner) / n
        return 10_000.0 if between <= 0 else min(10_000.0, max(2.0, inner / between))

    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    mean = sum(e for *_, e in rows) / len(rows)
    a = strength(hosts, dict.fromkeys(hosts, mean))
    host = {h: (sum(v) + a * mean) / (len(v) + a) for h, v in hosts.items()}
    b = strength(paths, {g: host[g[0]] for g in paths})
    path = {g: (sum(v) + b * host[g[0]]) / (len(v) + b) for g, v in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    safe = lambda x: min(1 - 1e-6, max(1e-6, x))
    return [(host[h], path[h, p], 1 / (1 + math.exp(-(odds(safe(e)) + 0.5 * (odds(safe(path[h, p])) - odds(safe(mean))))))) for h, p, e in rows]


def test_posteriors_against_brute_force(spark, odd):
    """Shrunk means of hosts and paths, and documents' posteriors, from the evidence."""
    r = random.Random(12)
    words = ["some", "plain", "words", "in", "order", "here", "and", "there"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 60))) + ("!!! BUY" if r.random() < (i % 5) / 5 else "."), r.choice(["en", "de", None]), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(None if d is None else 1000 + d, t, lang, s) for d, t, lang, s in odd]
    labels = spark.createDataFrame([(i, int("BUY" not in rows[i][1]), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    got = quality(docs, labels, "source", "lang").collect()
    where = {}
    for d, _, lang, s in rows:
        where.setdefault(d, []).append((s, lang))
    every = [(*where[x.doc_id][0], x.evidence) for x in got]  # repeated rows of the fixture agree in host and path
    want = brute_posteriors(every)
    assert len(got) == len(rows)
    for x, (host, path, posterior) in zip(got, want):
        assert abs(x.host_posterior - host) < 1e-9 and abs(x.path_posterior - path) < 1e-9 and abs(x.posterior - posterior) < 1e-9
        assert x.kept == (x.posterior >= 0.5)


def test_word_evidence(spark):
    """Texts alike in all but their words are told apart."""
    r = random.Random(3)
    good, bad = [f"good{i}" for i in range(30)], [f"evil{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(40)), "en", f"s{i % 3}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality(make(spark, rows), labels, "source", "lang").where("doc_id >= 200").collect()
    assert sum(x.kept == (x.doc_id % 2 == 1) for x in got) >= 0.97 * len(got)
