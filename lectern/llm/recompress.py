"""Substring dedup by recompression: removes word windows whose word sequence starts anywhere else in the corpus.

Names are content hashes, so one name means one word sequence in every document, with no dictionary to exchange.

1. Each text is recompressed: a round names runs of two equal words, then rounds name pairs (left, right), where a bit of
   a symbol's name says whether it can stand left or right and only symbols up to the round's cap take part. Whether two
   neighbours merge hangs on these two alone, so inside equal substrings all symbols agree but for whole symbols of at most
   the sum of the caps (17 words) at either end. A 35-word window therefore holds at least one whole symbol, at most 17
   words from its own start, that every other occurrence of the window has at the same place and by the same name.
2. Each top-level symbol's name, taken together with that of the 18 words from its start, is dealt out (hash ranges). One
   that stands twice reveals a candidate; within what a map task has gathered, equal names meet at once and travel as one.
3. Around revealed symbols (at most 17 words before), the full 35-word windows are named and dealt out: a window name that
   stands twice is a verified repeat. All judged windows are windows of the input.
4. The verified starts go back to their texts, which drop the words they cover. Texts without any stay where they are.

The number of ranges grows with the input. Beyond FAN ranges they are dealt in two steps, so that a task never sends blobs
of a few entries. A map task sends a name that it has met twice only once (it remembers SENT of them at most), so a window
that stands everywhere meets itself in one entry a task.

Null text: no words. Fewer words than a window: nothing is removed. Repeated rows of a doc_id count as documents of their
own. Windows are equal if their 64-bit names and the names' ranges, taken from two different hashes, are equal. Rows go by a
64-bit name of doc_id and text; starts beyond a text, which only another text of that name could have, are not its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep, left_rare, likely, only, parts_for, small_batches
from lectern.llm.words import R2, U, as_bytes, grams, hashes, lean, mix, prefix, split_words

WINDOW = 35
#: Longest run and longest symbols that take part in each round of pairs; they add up to REACH.
RUN, CAPS = 2, (1, 1, 1, 2, 2, 4, 4)
REACH = RUN + sum(CAPS)
#: Words gathered before a map task sends blobs; bytes of text for each hash range.
FLUSH, RANGE_BYTES = 500_000, 12_000_000
#: Ranges that a task deals to at once, and names that it remembers to have sent.
FAN, SENT = 8192, 500_000
_BLOBS = "part int, ids binary, counts binary, names binary, at binary, fine binary"
_FOUND = "row long, at binary"


def symbols(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each top-level symbol starts, and its name; doc tells the document of each word."""
    at = np.arange(len(names))
    size = np.ones(len(names), np.int64)
    if not len(names):
        return at, names
    same = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    before, after = np.append(False, same), np.append(same, False)
    longer = np.zeros(len(names), bool)
    longer[:-1] = after[1:]
    head = after & ~before & ~longer  # a maximal run of exactly two
    names = np.where(head, mix(names * U(R2) + U(RUN)), names)
    size[head] = RUN
    left = ~np.append(False, head[:-1])
    names, size, at, doc = names[left], size[left], at[left], doc[left]
    for k, cap in enumerate(CAPS, 1):
        right = (mix(names + U(k)) >> U(63)).astype(bool)
        live = size <= cap
        join = np.append((~right & live)[:-1] & (right & live)[1:] & (doc[1:] == doc[:-1]), False)
        i = np.flatnonzero(join)
        names[i] = mix(names[i] * U(R2) + mix(names[i + 1]) + U(k))
        size[i] += size[i + 1]
        stay = np.ones(len(names), bool)
        stay[i + 1] = False
        names, size, at, doc = names[stay], size[stay], at[stay], doc[stay]
    return at, names


def _dealt(ids: np.ndarray, doc: np.ndarray, name: np.ndarray | None, at: np.ndarray, fine: np.ndarray, fan: int) -> list[tuple]:
    """Blobs of entries by range, or by group of ranges if there are more than ``fan``; only ranges with entries are visited."""
    part = fine % fan
    order = np.lexsort((doc, part))
    doc, at, fine, part = doc[order], at[order].astype(np.int32), fine[order].astype(np.int32), part[order]
    name = None if name is None else name[order]
    out = []
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
        heads = lo + np.flatnonzero(np.append(True, doc[lo + 1 : hi] != doc[lo : hi - 1]))
        out.append((int(part[lo]), ids[doc[heads]].tobytes(), np.diff(np.append(heads, hi)).astype(np.int32).tobytes(), None if name is None else name[lo:hi].tobytes(), at[lo:hi].tobytes(), fine[lo:hi].tobytes()))
    return out


def _batch(out: list[tuple], fan: int, parts: int) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 5)
    cols = list(zip(*out)) or [[]] * 6
    if parts <= fan:
        cols[5] = [None] * len(cols[0])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "ids", "counts", "names", "at", "fine"])


def _split(name: np.ndarray, fine: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: those to send (one of each name, none that was sent before), those met twice, and the names now sent."""
    order = np.lexsort((fine, name))
    again = np.zeros(len(name), bool)
    again[1:] = (name[order][1:] == name[order][:-1]) & (fine[order][1:] == fine[order][:-1])
    twice = again.copy()
    twice[:-1] |= again[1:]
    key = mix(name[order].astype(U) * U(R2) + fine[order].astype(U))
    known = sent[np.minimum(np.searchsorted(sent, key), len(sent) - 1)] == key if len(sent) else np.zeros(len(name), bool)
    if len(sent) < SENT:
        sent = np.union1d(sent, key[twice & ~known][:SENT])
    return np.sort(order[~again & ~known]), np.sort(order[twice | known]), sent


def _entries(parts: int, starts, short: bool):
    """Map side of steps 2 and 3. starts: of a gathered batch, the positions to name and names to take them with; short:
    send 32-bit names. Names met more than once are sent once, and all their entries also go out as found (names null)."""
    size = WINDOW - REACH if short else WINDOW
    fan = min(parts, FAN)

    def send(rows, texts, marks, sent):
        n = np.array([len(x) for x in texts])
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(len(texts)), n)
        words = np.concatenate(texts)
        at, own = starts(words, doc, ends - n, ends, marks)
        if len(at):
            fits = at + size <= ends[doc[at]]
            at, own = at[fits], own if own is None else own[fits]
        name, fine = grams(prefix(words), at, size), (grams(prefix(words, R2), at, size, R2) % U(parts)).astype(np.int64)
        if own is not None:
            name = mix(name * U(R2) + own)
        name, doc, ids, at = name.astype(np.uint32) if short else name, doc[at], np.array(rows, np.int64), at - (ends - n)[doc[at]]
        once, found, sent = _split(name, fine, sent)
        out = _dealt(ids, doc[once], name[once], at[once], fine[once], fan) + _dealt(ids, doc[found], None, at[found], doc[found] % parts, fan)
        return _batch(out, fan, parts), sent

    def run(batches):
        lean()
        sent = np.empty(0, U)
        rows, texts, marks, total = [], [], [], 0
        for b in batches:
            found = b.column("found").to_pylist() if "found" in b.schema.names else [None] * b.num_rows
            for row, text, mark in zip(b.column("row").to_pylist(), as_bytes(b.column("text")), found):
                words = split_words(text)
                if len(words) >= WINDOW:
                    rows.append(row)
                    texts.append(hashes(words))
                    marks.append(mark)
                    total += len(words)
                    if total >= FLUSH:
                        batch, sent = send(rows, texts, marks, sent)
                        yield batch
                        rows, texts, marks, total = [], [], [], 0
        if rows:
            yield send(rows, texts, marks, sent)[0]

    return run


def _dealt_again(kind):
    """Second step of dealing: blobs of a group of ranges, sorted by group, are gathered and dealt to single ranges."""

    def run(batches):
        lean()
        held, total, group = [], 0, None

        def send():
            out = []
            for null in (False, True):
                pick = [x for x in held if (x[2] is None) == null]
                if pick:
                    ids = np.concatenate([np.frombuffer(x[0], np.int64) for x in pick])
                    doc = np.repeat(np.arange(len(ids)), np.concatenate([np.frombuffer(x[1], np.int32) for x in pick]))
                    name = None if null else np.concatenate([np.frombuffer(x[2], kind) for x in pick])
                    at, fine = (np.concatenate([np.frombuffer(x[k], np.int32) for x in pick]) for k in (3, 4))
                    out += _dealt(ids, doc, name, at, fine, (1 << 31) - 1)
            return _batch([(*x[:5], None) for x in out], 1, 1)

        for b in batches:
            for part, *x in zip(*(c.to_pylist() for c in b.columns)):
                if held and (part != group or total >= FLUSH):
                    yield send()
                    held, total = [], 0
                group = part
                held.append(x)
                total += len(x[3]) // 4
        if held:
            yield send()

    return run


def _by_range(rows: DataFrame, parts: int, starts, short: bool) -> DataFrame:
    """Blobs of the rows' entries, by range."""
    blobs = rows.mapInArrow(_entries(parts, starts, short), _BLOBS)
    if parts > FAN:
        blobs = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_dealt_again(np.uint32 if short else U), _BLOBS)
    return blobs


def _anchors(words, doc, begins, ends, marks):
    return symbols(words, doc)


def _candidates(words, doc, begins, ends, marks):
    """Starts of windows that reach a revealed symbol start within REACH words."""
    step = np.zeros(len(words) + 1, np.int64)
    for begin, end, blobs in zip(begins, ends, marks):
        at = np.unique(np.frombuffer(b"".join(blobs), np.int32)) + begin
        at = at[at < end]
        lo, hi = np.maximum(at - REACH, begin), np.minimum(at, end - WINDOW)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        np.add.at(step, lo, 1)
        np.add.at(step, hi + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0), None


def _twice(kind):
    """Reduce side: entries whose name stands twice in the range, and those found before."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        row, name, at, out = [], [], [], {"row": [], "at": []}
        for x in table.select(["ids", "counts", "names", "at"]).to_batches():
            for ids, counts, names, spots in zip(*(c.to_pylist() for c in x.columns)):
                ids, counts, spots = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(spots, np.int32)
                if names is None:
                    cut = np.cumsum(counts)
                    out["row"] += ids.tolist()
                    out["at"] += [spots[j - n : j].tobytes() for j, n in zip(cut, counts)]
                else:
                    row.append(np.repeat(ids, counts))
                    name.append(np.frombuffer(names, kind))
                    at.append(spots)
        if name:
            row, name, at = np.concatenate(row), np.concatenate(name), np.concatenate(at)
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            hit = order[np.append(False, same) | np.append(same, False)]
            hit = hit[np.argsort(row[hit], kind="stable")]
            ids, first = np.unique(row[hit], return_index=True)
            cut = np.append(first, len(hit))
            out["row"] += ids.tolist()
            out["at"] += [at[hit[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
        return pa.table([pa.array(out["row"], pa.int64()), pa.array(out["at"], pa.binary())], names=["row", "at"])

    return run


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words the windows at starts cover."""
    step = np.zeros(n + 1, np.int64)
    starts = np.unique(starts[starts <= n - WINDOW])
    step[starts] += 1
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked as gone; what stood around them shrinks to one line break."""
    out, last, open_gap = [], 0, False
    for m, g in zip(_WORD.finditer(text), gone.tolist()):
        if not g:
            if open_gap:
                out.append(b"\n" if out else b"")
            else:
                out.append(text[last : m.start()])
            out.append(m.group())
        open_gap, last = g, m.end()
    return b"".join(out if open_gap else [*out, text[last:]])


def _judged(batches):
    lean()
    for b in batches:
        total, removed, digest, left = [], [], [], []
        for text, blobs in zip(as_bytes(b.column("text")), b.column("found").to_pylist()):
            words, gone = split_words(text), None
            total.append(len(words))
            if blobs:
                gone = covered(len(words), np.frombuffer(b"".join(blobs), np.int32))
                words = [w for w, x in zip(words, gone.tolist()) if not x]
            removed.append(int(gone.sum()) if gone is not None else 0)
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            left.append(cut(text, gone) if gone is not None else text)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(left, pa.binary()).cast(pa.string())],
            ["doc", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """row, found: for each row (xxhash64 of doc_id and text), blobs of the starts of its repeated windows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = parts_for(size, RANGE_BYTES, 64)
    rows = docs.select("row", "text")
    revealed = keep(_by_range(rows, parts, _anchors, True).groupBy("part").applyInArrow(_twice(np.uint32), _FOUND))
    gather = lambda found: found.groupBy("row").agg(F.collect_list("at").alias("found"))  # noqa: E731  at most a blob for each range and map batch
    marked = likely(rows, "row", revealed.select("row").distinct()).join(gather(revealed), "row")
    return keep(gather(_by_range(marked, parts, _candidates, False).groupBy("part").applyInArrow(_twice(U), _FOUND)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns of the row), n_words, n_removed, kept_sha256 and kept_text of every row.

    kept_sha256 is of the kept words joined by one space; kept_text has the spacing of the text (null stays null).
    """
    found = repeated_windows(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    rows = left_rare(rows, "row", found).select("doc", F.col("doc.text").alias("text"), "found")
    shape = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_judged, f"doc {shape}, n_words long, n_removed long, kept_sha256 string, kept_text string")
