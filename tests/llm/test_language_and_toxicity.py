"""Language identification and toxicity: exact properties and held-out accuracy."""

import random

import numpy as np

from corpus import make
from lectern.llm import langid, toxicity
from lectern.llm.queries import QUERIES
from lectern.llm.words import U

SF = "/root/testdata/sf0.01"


def brute_length(texts_by_lang, text, order=langid.ORDER):
    """Code length of a text under each language by walking down the contexts."""
    out = {}
    for lang, texts in texts_by_lang.items():
        counts = {}
        for t in texts:
            t = langid.PAD + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                    counts[t[i - k : i]][t[i]] += 1
        bits = 0.0
        t = langid.PAD + text
        for i in range(order, len(t)):
            for k in range(order, -2, -1):
                if k < 0:
                    bits += 8
                    break
                c = counts.get(t[i - k : i])
                if c is None:
                    continue
                n, u = sum(c.values()), len(c)
                if t[i] in c:
                    bits -= np.log2(c[t[i]] / (n + u))
                    break
                bits -= np.log2(u / (n + u))
        out[lang] = bits
    return out


def test_code_lengths():
    r = random.Random(3)
    words = {"aa": ["the", "of", "and", "thing"], "bb": ["der", "und", "ist", "ßü"], "cc": ["xyz"]}
    train = {k: [" ".join(r.choice(w) for _ in range(20)).encode() for _ in range(5)] for k, w in words.items()}
    trees = langid.fit((k, t) for k, ts in train.items() for t in ts)
    texts = [b"the und of", b"", b"q", "ßü der thing \U0001f600".encode(), b"xyz" * 50, bytes(range(1, 200))]
    got = trees.lengths(texts)
    for t, row in zip(texts, got):
        want = brute_length(train, t)
        assert np.allclose(row, [want[x] for x in trees.langs], rtol=1e-5, atol=1e-3)
    # After any context, the probabilities of all bytes add up to 1 at most: it is a code.
    for context in (b"the ", b"\n\n\n\n", b"zzzz", b" und"):
        grams = np.array([int.from_bytes(context + bytes([c])) for c in range(256)], U)
        assert (np.exp2(-trees.costs(grams).astype(float)).sum(0) <= 1 + 1e-5).all()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 64)
    trees = langid.fit([("a", b"some words here"), ("b", b"und der ist")])
    texts = [b"words der " * 30, b"und", b"", b"here some" * 2]
    pieces = trees.lengths(texts)
    monkeypatch.setattr(langid, "AT_ONCE", 10**6)
    assert np.allclose(pieces, trees.lengths(texts))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_long_texts_only(spark):
    """A language that stands in long texts alone is learnt from stretches of them."""
    r = random.Random(5)
    text = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, text("abcdef", 40), "xx", "s") for i in range(30)] + [(100 + i, text("uvwxyz", 30_000), "yy", "s") for i in range(6)]
    rows += [(200, text("uvwxyz", 12), None, "s"), (201, text("abcdef", 12), None, "s")]
    docs = make(spark, rows)
    sample = langid.training_sample(docs).collect()
    assert {x.lang for x in sample} == {"xx", "yy"} and max(len(x.text) for x in sample) == langid.TRAIN_CHARS
    got = {x.doc_id: x.lang_pred for x in langid.predict(docs, langid.fit((x.lang, x.text.encode()) for x in sample)).collect()}
    assert got[200] == "yy" and got[201] == "xx"


def test_language_of_odd_texts(spark, odd):
    docs = make(spark, odd)
    trees = langid.fit((lang, text.encode()) for lang, text in langid.training_sample(docs).collect())
    got = {r.doc_id: r for r in langid.predict(docs, trees).collect()}
    for d, t, *_ in odd:
        assert (got[d].lang_pred == "und") == (not any(map(str.isalpha, t or ""))), d
        assert (got[d].score == 0) == (got[d].lang_pred == "und")
    none = langid.predict(docs, langid.fit([]))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.predict(make(spark, []), trees).count() == 0 and langid.training_sample(make(spark, [])).count() == 0


def test_viterbi():
    """The decoder finds the cheapest of all paths."""
    import itertools

    model = toxicity.CharModel({g: 5 for w in ("idiot", "trash", "loser", "plain") for g in toxicity.word_grams(w)})
    for token in ("1d10t", "tr@sh", "l0oser", "p.l.a", "ii1"):
        best = None
        for path in itertools.product(*toxicity.choices(token)):
            text, cost = "".join(c for c, _ in path), sum(x for _, x in path)
            w = "^^^" + text + "$"
            cost += sum(model.bits(w[i : i + 3], w[i + 3]) for i in range(len(w) - 3))
            best = min(best, (cost, text)) if best else (cost, text)
        assert toxicity.viterbi(token, model) == best[1]
    r = toxicity.Restorer(model)
    assert [r.word(x) for x in ("1d10t!", "TR@SH", "looooser", "l-o-s-e-r", "plain,", "2024", "x" * 90)] == ["idiot", "trash", "loser", "loser", "plain", "2024", "x" * 90]
    assert r.restore("an i d i o t here") == "an idiot here" and r.restore(None) == ""


def test_edges_and_long_tokens():
    """Letter-like signs at either end may be letters or punctuation, and tokens of any length are decoded."""
    words = ("stupid", "idiot", "cunt", "class", "plain", "hello")
    r = toxicity.Restorer(toxicity.CharModel({g: 50 for w in words for g in toxicity.word_grams(w)}))
    assert [r.word(x) for x in ("$tupid", "!diot", '"(unt"', "cla$$", "hello!", "(plain)", "$TUPID!!!", "idiot!", "$$$")] == ["stupid", "idiot", "cunt", "class", "hello", "plain", "stupid", "idiot", ""]
    assert r.word("id" + "i" * 500 + "ot") == "idiot" and r.word("s" + "-_" * 200 + "tup1d") == "stupid"
    many = "-".join("idiot" * 300)
    assert r.word(many) == "idiot" * 300


def test_toxicity_learns(spark):
    r = random.Random(7)
    plain = [f"word{i}" for i in range(200)]
    disguised = ["idiot", "1d10t", "id-i-ot", "idiiiot", "i d i o t", "trash", "tr4sh"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            for _ in range(2):
                w.insert(r.randrange(20), r.choice(disguised[:1] + disguised[5:6] if i < 400 else disguised))
        rows.append((i, " ".join(w), "en", "s"))
        if i < 400:
            labels.append((i, 1, int(i % 4 == 0)))
    docs = make(spark, rows)
    words = toxicity.restored(toxicity.gather(docs))
    scorer = toxicity.learn(toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), words)
    assert {"idiot", "trash"} <= set(scorer.weights) and not any(w.startswith("word") for w in scorer.weights)
    got = {x.doc_id: x.score for x in toxicity.score(docs, scorer, words).collect()}
    wrong = [(i, got[i], rows[i][1]) for i in range(600) if (got[i] >= 0.5) != (i % 4 == 0)]
    assert not wrong


def test_whole_counts_and_decoding(spark, monkeypatch):
    """The table of counts is that of all words, and decoding in groups that ask for their counts equals decoding with all."""
    from collections import Counter

    monkeypatch.setattr(toxicity, "TOGETHER", 20)
    r = random.Random(2)
    letters = "abcdeéßжщ汉"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))).title() + r.choice(["", ".", "!", "3", "@x", "iii"]) for _ in range(30)) for _ in range(40)]
    texts += ["i d i o t s", "an 1d10t!", "x" * 60 + "9" * 300 + "y", "w.o.r.d and w0rd", None, ""]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = Counter()
    for t in texts:
        for w in (t or "").split():
            core = w.strip(toxicity._EDGE).lower()
            if core.isalpha():
                want.update(toxicity.word_grams(core))
    g = toxicity.gather(docs)
    assert dict(g.counts.collect()) == want
    model = toxicity.CharModel(dict(want))
    got = {x.token: x.word for x in toxicity.restored(g).collect()}
    odd = {f for t in texts if t for f in [*toxicity.set_apart(t), *(toxicity.plain_or_odd(w)[1] for w in t.split())]} - {None}
    assert set(got) == odd and len(odd) > 100
    assert all(got[x] == toxicity.decode(x, model) for x in odd)


def test_long_disguises(spark):
    """Disguises of more characters than any bound are found: in one token, and set apart by spaces."""
    plain = [f"word{i}" for i in range(50)]
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(plain) for _ in range(15)) + (r.choice([" idiot here", " you idiot", " an idiot so", " idiot idiot"]) + f" z{i}" if i % 3 == 0 else ""), "en", "s") for i in range(300)]
    long = ["i" * 41 + "d1ot", "i-" * 30 + "d-i-o-t", " ".join("i" * 30 + "diot"), "1" * 45 + "diot"]
    rows += [(1000 + k, f"word1 word2 {x} word3", "en", "s") for k, x in enumerate(long)]
    docs = make(spark, rows)
    words = toxicity.restored(toxicity.gather(docs))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.learn(toxicity.sample(docs, labels), words), words).collect()}
    assert all(got[1000 + k] >= 0.5 for k in range(len(long))), [got[1000 + k] for k in range(len(long))]


def brute_scores(docs, rows):
    """Scores of texts by going through the steps one text at a time, with one model of everything."""
    import math
    from collections import Counter

    counts = Counter()
    for t in docs:
        for w in (t or "").split():
            core = w.strip(toxicity._EDGE).lower()
            if core.isalpha():
                counts.update(toxicity.word_grams(core))
    r = toxicity.Restorer(toxicity.CharModel(dict(counts)))
    near, n, bad = {}, len(rows), sum(y for _, y in rows)
    for t, y in rows:
        if y:
            w = [x for x in map(r.word, t.split()) if x] + r.apart(t)
            first = {}
            for a, x, b in zip(["", *w], w, [*w[1:], ""]):
                if x.isalpha():
                    first[x] = min(first.get(x, f"{a} {b}"), f"{a} {b}")
            for x, c in first.items():
                near.setdefault(x, set()).add(c)
    wanted = {f for x, c in near.items() if len(c) >= toxicity.SUPPORT for f in toxicity.features(x)}
    weights = {}
    has = [({f for x in {*map(r.word, t.split())} for f in toxicity.features(x)} | {f for x in r.apart(t) for i in range(len(x)) for j in range(i + toxicity.STEM, len(x) + 1) if x[i:j] in wanted for f in toxicity.features(x[i:j])}, y) for t, y in rows]
    for f in wanted:
        a, b = sum(y for s, y in has if f in s), sum(1 - y for s, y in has if f in s)
        odds = (a + 0.5) / (bad + 1) / ((b + 0.5) / (n - bad + 1))
        if a > b and math.log(odds) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > math.log(toxicity.ODDS):
            weights[f] = min(6.0, math.log(odds))
    return weights


def test_lexicon_against_brute_force(spark):
    r = random.Random(9)
    plain, bad = [f"pl{chr(97 + i // 26)}{chr(97 + i % 26)}n" for i in range(80)], ["idiot", "trash", "loser"]
    disguise = lambda w: r.choice([w, w, w.replace("i", "1").replace("a", "@"), w[0] + w[1] * 4 + w[2:], "-".join(w), " ".join(w), w + "s"])
    rows = []
    for i in range(240):
        w = [r.choice(plain) for _ in range(12)]
        if i % 3 == 0:
            w[r.randrange(12)] = disguise(r.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(toxicity.sample(docs, labels), toxicity.restored(toxicity.gather(docs)))
    want = brute_scores([t for _, t, *_ in rows], [(t, int(i % 3 == 0)) for i, t, *_ in rows[:200]])
    assert set(scorer.weights) == set(want) and all(abs(scorer.weights[f] - want[f]) < 1e-9 for f in want) and {"idiot", "trash", "loser"} <= set(want)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)  # some labels have no toxic word in their text
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_texts(spark, odd):
    docs = make(spark, odd)
    words = toxicity.restored(toxicity.gather(docs))
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (3, 1, None), (None, 1, 1)], [(1, 1, 1), (7, 0, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity.score(docs, toxicity.learn(toxicity.sample(docs, table), words), words).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.gather(make(spark, []))
    assert none.counts.count() == 0 and toxicity.restored(none).count() == 0
