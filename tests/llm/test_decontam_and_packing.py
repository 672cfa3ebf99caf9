"""Decontamination against a plain search, re-parameterised items, and packing by exact round trip."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus import make
from lectern.llm import decontam, packing
from lectern.llm.queries import tokenizer_spec


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r.kind for r in decontam.contamination(make(spark, docs), bench(spark, items)).collect()}


def test_passages(spark):
    r = random.Random(8)
    word = lambda: f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(5000)}x"
    items = [(i, " ".join(word() for _ in range(r.randint(5, 40))).capitalize() + ".") for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        w = [word() for _ in range(r.randint(5, 80))]
        for i, t in r.sample(items, r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(w))
            w[at:at] = [t] if r.random() < 0.5 else ["\n" + t + "\n"]
            want.add((d, i))
        docs.append((d, " ".join(w), "en", "s"))
    got = found(spark, docs, items)
    assert set(got) == want and set(got.values()) == {"exact"}
    clean = decontam.clean_rows(make(spark, docs), bench(spark, items))
    assert {x.doc_id for x in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_reparameterised(spark):
    item = "A train leaves with Alice at 60 km and Bob follows with Alice at 90 km so when does Bob pass Alice on the long way home"
    same = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("60", "72").replace("90", "75.5")
    mixed = item.replace("Alice", "Carol", 1).replace("60", "72").replace("Alice", "Erin", 1)
    part = " ".join(item.split()[:7])
    docs = [(1, f"Look. {item}", "en", "s"), (2, f"Look. {same}", "en", "s"), (3, f"Look. {mixed}", "en", "s"), (4, part, "en", "s"), (5, "x " + " ".join(item.split()[3:]), "en", "s")]
    got = found(spark, docs, [(9, item)])
    assert got[1, 9] == "exact" and got[2, 9] == "reparameterised" and (3, 9) not in got and (4, 9) not in got and got[5, 9] == "exact"


def test_copies(spark):
    """Copies count however many slots they have, with a value changed in one place, and around a word put in or left out."""
    numbers = "Compute 12, 15, 18, 21, 24, 27 and find the 9th: 36, 39."
    w = [f"plain{k}" for k in range(40)]
    w[5] = w[20] = "17"
    forty, changed = " ".join(w), " ".join([*w[:20], "18", *w[21:]])
    twenty = [f"other{k}" for k in range(20)]
    docs = [(1, f"see this. {numbers} so", "en", "s"), (2, f"x {changed} y", "en", "s"), (3, " ".join([*twenty[:10], "really", *twenty[10:]]), "en", "s"), (4, " ".join([*twenty[:9], *twenty[10:]]), "en", "s"), (5, " ".join(twenty[:10]), "en", "s")]
    got = found(spark, docs, [(1, numbers), (2, forty), (3, " ".join(twenty))])
    assert got == {(1, 1): "exact", (2, 2): "reparameterised", (3, 3): "exact", (4, 3): "exact"}


def test_glued_units(spark):
    item = "A car drives 100km in 2h and rests for 15min before it drives back so how fast was it on the way?"
    got = found(spark, [(1, item.replace("100km", "240km").replace("2h", "3h").replace("15min", "40min"), "en", "s"), (2, item.replace("100km", "far"), "en", "s")], [(1, item)])
    assert got == {(1, 1): "reparameterised", (2, 1): "exact"}  # of the second, what follows its other word


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 red apples and 3 pears. Tom eats 2 of them. Tom buys 4 more. How many fruits does Tom have?"
    wrapped = item.replace("does Tom", "does\nTom").replace("and 3", "and\n3")
    docs = [(1, item.replace("Tom", "Anna"), "en", "s"), (2, f"Once more: {wrapped.replace('Tom', 'Anna').replace('5', '7')}", "en", "s"), (3, item.replace("Tom", "Anna", 2), "en", "s")]
    got = found(spark, docs, [(1, item)])
    assert got[1, 1] == got[2, 1] == "reparameterised"


def plain_matches(item, doc):
    """Whether some alignment of the item with the document counts: every offset is tried, every window compared word by word."""
    v = decontam.Vocabulary()
    a, b = v.template(item.encode()), v.template(doc.encode())
    low = lambda t: [decontam._core(w) for w in t.words]
    x, y = low(a), low(b)
    n, size = len(x), min(decontam.WINDOW, len(x))
    forms = [([(k, w if not k else None) for k, w in zip(ks, x)], [(k, w if not k else None) for k, w in zip(ls, y)]) for ks, ls in ((a.kind, b.kind), (a.second, b.second), (0 * a.kind, 0 * b.kind))]
    start = [(decontam.NAME, None), *forms[0][0][1:size]] if item[:1].isupper() else None
    for begin in range(-n, len(y)):
        for use in ((0, 2), (0, 1, 2)):
            got = set()
            for i in range(max(0, -begin), min(n, len(y) - begin) - size + 1):
                if any(forms[f][0][i : i + size] == forms[f][1][begin + i : begin + i + size] for f in use) or i == 0 and start == forms[0][1][begin : begin + size]:
                    got |= set(range(i, i + size))
            if not got or len(got) < 13 and 100 * len(got) < 60 * n:
                continue
            slots = [(i, x[i], y[begin + i]) for i in sorted(got) if (a.second[i] or b.second[begin + i]) and (b.kind[begin + i] or x[i] != y[begin + i])]
            changed = {i for i, p, q in slots if p != q}
            run = longest = 0
            for i in range(n):
                run = run + 1 if i in got and i not in changed else 0
                longest = max(longest, run)
            one = len({(p, q) for _, p, q in slots}) == len({p for _, p, _ in slots}) == len({q for _, _, q in slots})
            if 10 * len(changed) <= len(got) or longest >= 20 or 100 * longest >= 60 * n or 2 * len(slots) <= len(got) and one:
                return True
    return False


def test_slots_against_all_alignments(spark):
    """Hundreds of items: copies in any case, with other values in all slots, with clashing values, and clean texts."""
    r = random.Random(21)
    names, units = ["Alice", "Bob", "Carol", "Dan", "Erin", "Frank", "Grace", "Heidi", "Ivan", "Judy"], ["km", "kg", "hours", "dollars"]
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "pe", "ra") for b in ("ter", "gon", "lish", "mer", "dow", "vant")]
    items, docs, want = [], [], {}
    for i in range(300):
        cast, values, parts = r.sample(names, 3), r.sample(range(10, 999), 4), []
        for _ in range(r.randint(3, 6)):
            parts.append(" ".join([r.choice(words), r.choice(cast), *(r.choice(words) for _ in range(r.randint(2, 4))), str(r.choice(values)), r.choice(units), r.choice(words)]))
        items.append((i, " and ".join(parts) + "?"))
        item = items[-1][1]
        other = dict(zip([*cast, *map(str, values)], [*r.sample([x for x in names if x not in cast], 3), *map(str, r.sample(range(1000, 9999), 4))]))
        changed = " ".join(other.get(w, w) for w in item.split())
        mixed = " ".join(r.choice(names) if w in names else str(r.randint(1, 9)) if w.isdigit() else w for w in item.split())
        around = lambda t: " ".join(r.choice(words) for _ in range(r.randint(0, 9))) + f" {t} " + " ".join(r.choice(words) for _ in range(5))
        for k, (t, sure) in enumerate([(item, True), (item.upper(), True), (item.lower(), True), (changed, True), (mixed, None), (" ".join(r.choice(words) for _ in range(60)), False), (" ".join(r.sample(item.split(), len(item.split()))), None)]):
            docs.append((10 * i + k, around(t), "en", "s"))
            want[10 * i + k] = i, sure
    got = {d: set() for d, *_ in docs}
    for d, i in found(spark, docs, items):
        got[d].add(i)
    sure = [d for d, (i, x) in want.items() if x]
    assert sum(want[d][0] in got[d] for d in sure) >= 0.99 * len(sure)
    assert not any(got[d] for d, (i, x) in want.items() if x is False)
    for d, text, *_ in docs[:1400]:
        i = want[d][0]
        assert (i in got[d]) == plain_matches(items[i][1], text), (items[i][1], text)


def test_copies_of_any_kind(spark):
    """Copies in another case, of arithmetic, of names and numbers alone, and items under five words."""
    arithmetic = "What is 12 + 7 * 3 - 4 / 2 = 31 and 5 * 5 = 25 ?"
    cast = "Alice Bob 12 Carol Dan 13 Erin Frank 14 Grace Heidi 15"
    names = "Name the year in which Marie Curie met Albert Einstein in Brussels at Solvay"
    items = [(1, arithmetic), (2, cast), (3, names), (4, "Who wrote Faust?"), (5, "Yes."), (6, "2 + 2 = 4")]
    texts = [arithmetic, cast, names.lower(), names.upper(), names.title(), "some\n  who wrote faust \nmore", "but who wrote Faust?", "yes", "yes\nno", "a\n2 + 2 = 4\nb", "a\n2 - 2 = 4", "Alice Bob 12 Erin Frank 13 Grace Ivan 7 Judy Dan 99"]
    got = found(spark, [(i, f"so {t}" if 0 <= i < 5 else t, "en", "s") for i, t in enumerate(texts)], items)
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 3), (5, 4), (7, 5), (9, 6)} and set(got.values()) == {"exact"}


def test_odd_texts(spark, odd):
    items = [(1, None), (2, ""), (3, "one two three four"), (4, "w50 w51 w52 w53 w54 w55 w56 w57"), (4, "w50 w51 w52 w53 w54 w55 w56 w57"), (5, "!!! ###")]
    got = decontam.contamination(make(spark, odd), bench(spark, items)).collect()
    assert sorted(r.doc_id for r in got) == sorted(2 * [1, 2, 2, 3, 14]) and {r.item_id for r in got} == {4}
    docs = make(spark, odd)
    clean = decontam.clean_rows(docs, bench(spark, items))
    assert clean.schema == docs.schema and clean.count() == len(odd) - 5
    assert decontam.contamination(docs, bench(spark, [])).count() == 0 and decontam.clean_rows(docs, bench(spark, [])).count() == len(odd)
    assert decontam.contamination(make(spark, []), bench(spark, items)).count() == 0


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_WORDS", 20)
    monkeypatch.setattr(decontam, "REMEMBERED", 5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(10))) for i in range(12)]
    docs = [(i, f"pre {t} post", "en", "s") for i, t in items] + [(50, "clean text of no item at all here", "en", "s")]
    assert set(found(spark, docs, items)) == {(i, i) for i in range(12)}
    assert [r.doc_id for r in decontam.clean_rows(make(spark, docs), bench(spark, items)).collect()] == [50]


def unpacked(rows):
    """Sequences as lists of pieces; checks that they are gapless and within capacity."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return seqs


def test_packing(spark, odd):
    docs = make(spark, odd)
    rows = packing.pack(docs, tokenizer_spec()).collect()
    seqs = unpacked(rows)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None)
    want = []
    for d, t, *_ in odd:
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (at, n) in enumerate(packing.cuts(len(ids))):
            assert n <= 1024 and (n == 1024 or k == 0)
            if d is not None:
                want.append((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
    assert pieces == sorted(want)
    assert len(seqs) <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(make(spark, []), tokenizer_spec()).count() == 0


def test_packing_without_ids(spark, monkeypatch):
    """Rows without a doc_id spread over slices; the order in which rows arrive changes nothing."""
    monkeypatch.setattr(packing, "SLICE", 10)
    docs = make(spark, [(None, f"text {i % 90:02d}", "en", "a") for i in range(400)] + [(i % 5, "again and again", "en", "a") for i in range(300)])
    once, again = (packing.pack(docs.repartition(k), tokenizer_spec()).collect() for k in (1, 7))
    assert len(once) == 700 and sorted(map(str, once)) == sorted(map(str, again))
    assert len(unpacked(once)) <= -(-sum(r.length for r in once) // 1024) + 2


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    r = random.Random(seed)
    count = {}
    for _ in range(r.choice([1, 7, 200, 5000])):
        n = r.choice([r.randint(1, 1024), r.randint(300, 700), r.randint(1, 60), 512, 1024])
        count[n] = count.get(n, 0) + 1
    bins, ranks = {}, {}
    for n, first, m, at, offset in packing.plan(count):
        assert first == ranks.get(n, 0)
        ranks[n] = first + m
        for k in range(m):
            bins.setdefault(at + k, []).append((offset, n))
    assert ranks == count and sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n
        assert end <= 1024 and sum(3 * n > 1024 for _, n in b) <= 2
    tokens = sum(n * c for n, c in count.items())
    large = sum(c for n, c in count.items() if 2 * n > 1024)
    assert len(bins) <= max(-(-tokens // 1024), large) * 1.25 + 2


def test_fast_ids():
    """tiktoken and tokenizers agree over the range in which the first is used, and special tokens go to the second."""
    enc = packing.Encoder(*tokenizer_spec())
    r = random.Random(0)
    points = [chr(i) for i in range(0x250)]
    texts = [a + b for a in points for b in r.sample(points, 6)] + ["".join(r.choice(points) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(r.choice(" \t\n\r\x0b\x0c\x85\xa0\x1c'sdtreml1a.É") for _ in range(20)) for _ in range(4000)]
    for t in texts:
        assert enc.fast.encode_ordinary(t) == enc.exact.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("a<|endoftext|>b", "日本語 text", "x̀"):
        assert enc.ids(t).tolist() == enc.exact.encode(t, add_special_tokens=False).ids


def test_slots_in_plenty_against_all_alignments():
    """Items of mostly numbers and names, in texts that are full of them: nothing but the begin of an alignment hangs on literals."""
    r = random.Random(13)
    word = lambda: r.choice([*map(str, range(10, 40)), "Tom", "Anna", "sum", "of", "is", "what", "the", "5", "km"])
    hits = 0
    for _ in range(1500):
        item = " ".join(word() for _ in range(r.randint(5, 26)))
        w = item.split()
        for k in r.sample(range(len(w)), r.choice([0, 0, 1, 2, 4]) % len(w)):
            w[k] = word()
        text = " ".join([*(word() for _ in range(r.randint(0, 30))), *w, *(word() for _ in range(r.randint(0, 9)))])
        vocabulary = decontam.Vocabulary()
        got = bool(decontam.matches(decontam.index([(1, item)]), vocabulary.template(text.encode()), text.encode()))
        want = plain_matches(item, text)
        hits += want
        assert got or not want, (item, text)
    assert 500 < hits < 1450


def test_time_is_linear_in_the_text():
    r = random.Random(1)
    number = lambda: str(r.randint(1, 99))
    rows = [(i, f"Given the sequence {' '.join(number() for _ in range(20))} what comes next?") for i in range(5)]
    alike = [(i, "id " + " id ".join(f"{number()} {number()} {number()}" for _ in range(8))) for i in range(5)]
    for items, text, most in ((rows, " ".join(number() for _ in range(2_000_000)), 5), (alike, " ".join(f"id {number()} {number()} {number()}" for _ in range(20_000)), 5), ([(0, "x " * 40)], "x " * 1_000_000, 5)):
        idx, t = decontam.index(items), decontam.Vocabulary().template(text.encode())
        began = time.perf_counter()
        got = decontam.matches(idx, t, text.encode())
        assert time.perf_counter() - began < most and bool(got) == (text[0] == "x")
    text = f"{' '.join(number() for _ in range(100_000))} {rows[3][1]} 1 2 3"
    assert [x[0] for x in decontam.matches(decontam.index(rows), decontam.Vocabulary().template(text.encode()), text.encode())] == [3]
