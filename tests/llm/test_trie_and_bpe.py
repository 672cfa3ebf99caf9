"""The prefix trie against a brute-force one, and the codec against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from compare import connect, normal
from corpus import make
from lectern.llm.bpe_codec import Codec, classes, decode, encode
from lectern.llm.prefix_trie import common, prefix_trie, rebuilt, stitch, sweep, turn_arrays
from lectern.llm.queries import QUERIES, SQL

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_trie(members):
    """Nodes of the trie of [(conv_id, [turn])], a turn being (anything, words): by listing every prefix of every member."""
    held = {}
    for c, turns in members:
        for d in range(len(turns) + 1):
            held.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    out = []
    for path, who in held.items():
        below = [p for p in held if p[: len(path)] == path]
        childless = [p for p in below if not any(q[:-1] == p for q in held if q)]
        up = held.get(path[:-1]) if path else None
        ends = ",".join(str(c) for c in sorted(c for c, last in who if last))
        saved = sum((len(held[p]) - 1) * (p[-1][1] if p else 0) for p in below)
        children = sum(1 for p in held if p and p[:-1] == path)
        out.append((min(c for c, _ in who), len(path), min(c for c, _ in up) if up else None, len(who), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_rebuilt(rows):
    """{conv_id: turns} of (conv_id, turn, role, text) rows, rebuilt."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, name), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # the remainder of SQL
        out.append((c, [((r, t), len(brute.words(t))) for r, t in own.get(base, [])[:h] + turns[h:]]))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def swept(members, sizes):
    """Nodes by sweep() and stitch() alone, over stretches of the given sizes."""
    packed = sorted((b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns), c, [w for _, w in turns]) for c, turns in members)
    out, stacks, ids, late = [], [], {}, []
    for k, n in enumerate(sizes):
        part, packed = packed[:n], packed[n:]
        for row in sweep(((p, w, c) for p, c, w in part), k):
            if row["kind"] == "open":
                stacks.append((row["first"], row["last"], row["open"]))
            elif row["kind"] == "ids":
                ids.setdefault(row["name"], []).append(row["ids"])
            else:
                late.append(row)
    assert not packed
    names = {}
    for name, row in stitch(stacks):
        names[name] = row[0]
        out.append((*row, hashlib.sha256(",".join(ids.get(name, [])).encode()).hexdigest()))
    for row in late:
        parent = names[row["name"]] if row.get("name") else row["parent_conv_id"]
        out.append((row["conv_id"], row["depth"], parent, *(row[x] for x in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))))
    return sorted(out, key=repr)


def test_sweep_over_any_stretches():
    r = random.Random(5)
    for _ in range(400):
        members = [(r.randint(-40, 400), [(r.choice("abc"), r.randint(0, 1)) for _ in range(r.choice([0, 0, 1, 2, 3, 3, 5]))]) for _ in range(r.randint(1, 25))]
        members = list({c: (c, t) for c, t in members}.values())
        sizes, left = [], len(members)
        while left:
            sizes.append(min(left, r.choice([0, 1, 1, 2, 3, 8])))
            left -= sizes[-1]
        assert swept(members, sizes) == brute_trie(members)


def test_common():
    a = bytes(range(64))
    assert common(a, a) == 4 and common(a, b"") == 0 and common(a, a[:32]) == 2 and common(a, a[:47] + b"x") == 2


def conversations(spark, rows):
    """With columns that clash with names used inside."""
    schema = "conv_id long, turn long, role string, text string, base long, name string, one string, words long, h int, head string, kind string"
    return spark.createDataFrame([(*x, 1, "n", "o", 2, 3, "h", "k") for x in rows], schema)


def test_trie_of_odd_rows(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi there", "hi", "", None, "a\x0cb \xa0 c"])) for c in [*range(45), -7, -20, 10**12] for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "no conversation"), (50, None, "user", "x"), (50, 0, "user", "y"), (50, 0, "user", "y"), (50, 0, "user", "z"), (61, 0, None, None)]
    rows += [(60 + k, 0, "user", "hot turn " * 50) for k in range(200)] + [(400, t, "user", f"turn {t} " * 3) for t in range(700)]
    rows += rows[:3]
    r.shuffle(rows)
    got = rows_of(prefix_trie(rebuilt(turn_arrays(conversations(spark, rows)))))
    small = [x for x in rows if x[0] is None or x[0] < 400]
    assert rows_of(prefix_trie(rebuilt(turn_arrays(conversations(spark, small))))) == brute_trie(brute_rebuilt(small))
    deep = [x for x in got if x[1] > 10]
    assert len(deep) == 690 and all(x[0] == x[2] == 400 and x[3] == 1 and x[6] == 0 for x in deep)


def test_trie_of_empty_table(spark):
    assert rows_of(prefix_trie(rebuilt(turn_arrays(conversations(spark, []))))) == []


def test_trie_query(spark):
    sf = "/root/testdata/sf0.01"
    assert normal(QUERIES["op11_prefix_trie"](spark, sf).toPandas()) == normal(connect(sf).sql(SQL["op11_prefix_trie"]).df())


@pytest.fixture(scope="module")
def pair():
    return Codec(PATH, classes()), Tokenizer.from_file(PATH)


def same(pair, text):
    mine, theirs = pair
    ids = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, text[:200]
    assert mine.decode(got) == theirs.decode(ids, skip_special_tokens=False)


def test_mixed_strings(pair):
    r = random.Random(3)
    pool = [
        *("'s 't 're 've 'm 'll 'd ' '' l e S 12 a the ing ... !! _ - </w> <|endoftext|> <|startoftext|> <|ENDOFTEXT|>".split()),
        *"ΣςİǅéÅﬁ½²٣日本한﻿​́ªʰẞßȺ\x00 \t\n\x0b\x1c\x1f\x85\xa0 　", "é", "Å", "\U0001f602" * 2, "\U0001d465", "\U0010ffff",
    ]
    for _ in range(20_000):
        same(pair, "".join(r.choice(pool) for _ in range(r.randint(0, 14))))


def test_every_code_point(pair):
    for lo in range(0, 0x110000, 0x800):
        block = [chr(c) for c in range(lo, lo + 0x800) if not 0xD800 <= c < 0xE000]
        same(pair, " ".join(block))
        same(pair, "a".join(block))


def test_fragments_are_certain(pair):
    """No token goes over a cut, and cuts leave short fragments of most texts."""
    codec, _ = pair
    text = "the quickest brown foxes wouldn't jump over lazy dogs' 12 kennels"
    found = codec.fragments(text)
    assert "".join(found) == "".join(chr(0x100 + int(x)) for x in codec.symbols(text))
    assert len(found) >= len(text.split())


def test_documents_both_ways(spark, pair, odd):
    docs = make(spark, odd)
    got = sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in decode(encode(docs, PATH), PATH).collect())
    want = sorted((d or -1, np.array(ids := pair[1].encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), pair[1].decode(ids, skip_special_tokens=False)) for d, t, *_ in odd)
    assert got == want
    assert decode(encode(make(spark, []), PATH), PATH).collect() == []


def test_bpe_query(spark, pair):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe_codec"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        text = pair[1].decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        Codec(public_tokenizers.path("byte_bpe_50k.json"), classes())


def test_long_text(pair):
    """Linear in the text, also where there is no cut at all."""
    for text in ("ab" * 1_000_000, "the cat sat. " * 150_000, "x " * 500_000):
        began = time.perf_counter()
        got = pair[0].encode(text)
        assert len(got) >= 4 and time.perf_counter() - began < 10


def test_plans(spark):
    """No product, nothing but the open stacks in one task, and texts read for their names alone."""
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op11_prefix_trie"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in out and "NestedLoop" not in out and "SinglePartition" not in out
    turns = rebuilt(turn_arrays(spark.read.parquet(f"{sf}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert turns.count("Exchange") == 1 and "Python" not in turns and "MapIn" not in turns
    both = QUERIES["op12_bpe_codec"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in both and both.count("MapInArrow") == 2 and "ReadSchema: struct<doc_id:bigint,text:string>" in both
