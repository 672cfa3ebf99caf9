"""Benchmark decontamination on templates: numbers, units and names become typed slots, windows of templates are matched
by hash, and slots must be filled consistently, so that re-parameterised questions are found as well as copies.

A word is stripped of punctuation and lower-cased. A number (digits, also with a unit glued to them, or a number word) is the slot <num>, a unit right
after a number <unit>, and a capitalised word that doesn't begin a sentence or line <name> (an item's first word may be met as either). A second
form of each text takes capitalised words that begin a sentence or line as <name> too, and a third has no slots at all, so
that copies are found whatever their slots and capitals; windows of a form are looked up
among those of the same form. Words of punctuation alone don't
count. The template windows of the benchmark (8 words; a shorter item of 5 to 7 words as a whole) are looked up in every
document. Windows that agree on where an item would begin form an alignment. It counts if it covers 13 words or 60 % of
the item, at least half of the covered words are literal, and its slots can be filled one to one: the same value
of the item always meets the same value of the document and the reverse. The last two don't hold for copies: an alignment
of which no more than a tenth of the covered words differ, or with a run of equal words of LONG words or 60 % of the item, counts without them. Alignments of an item that
follow one another with at most WINDOW words between them on either side, as around a word put in or left out, are also
taken together. With equal values throughout the match is
"exact", else "reparameterised". Of several alignments of an item in a document the one covering most counts, then the
first.

Windows of slots alone, which every table of numbers has everywhere, don't begin an alignment; SEED equal words in a row
within such a stretch do (fewer for items under seven words), and an alignment of which half the covered words are literal has a window with one. Once begun, an
alignment is compared whole, slots included, so it counts as if every window had been looked up. All alignments of an item are
compared as arrays, each once, so time and memory are linear in the text.

An item under five words is no window: it matches, but for case and punctuation at either end, as a whole line, and one of a
single word only as a whole text.

The benchmark goes to the executors in slices of at most SLICE_WORDS words, a slice for a pass over the documents, so a
broadcast has a fixed bound; documents are never shuffled. Null and empty texts match nothing, items without a word are
never matched, and repeated rows of documents or items give repeated matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lectern.llm.runtime import only, parts_for, small_batches
from lectern.llm.words import U, as_bytes, grams, lean, prefix

WINDOW, SHORTEST, ENOUGH, SHARE = 8, 5, 13, 60
#: Words of an equal run, and percent of the covered words that may differ, that make a copy.
LONG, DIFFER = 20, 10
#: Equal words that begin an alignment where all words are slots, for items of seven words or more: a copy that counts has as
#: many in a row (SHARE of a shorter one).
SEED = 5
#: Windows of a text that are looked up at once, and cells of a comparison of alignments.
WINDOWS, CELLS = 1 << 16, 1 << 19
SLICE_WORDS = 1_000_000
#: Distinct words of which a worker remembers the kind before it starts anew.
REMEMBERED = 500_000
NUM, UNIT, NAME = 1, 2, 3
_SLOT = np.array([0, *(xxh3_64_intdigest(x) for x in (b"<num>", b"<unit>", b"<name>"))], U)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_UNITS = frozenset("mm cm m km in ft mi mg g kg lb lbs oz t ms s sec secs min mins h hr hrs ml l usd eur gbp percent meters metres miles feet inches grams kilograms pounds seconds minutes hours days weeks months years dollars cents euros degrees litres liters mph kmh kb mb gb".split())
_GLUED = re.compile(r"[+-]?\d[\d.,:/]*(" + "|".join(sorted(_UNITS, key=len, reverse=True)) + ")")
_NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_SIGNS = "+-$€£"
_PUNCTUATION = "!\"#&'()*,-./:;<=>?@[\\]^_`{|}~«»“”‘’…—–%$€£"


_IS_NUMBER, _IS_UNIT, _IS_TITLE, _ENDS, _EMPTY = 1, 2, 4, 8, 16


def _core(w: bytes) -> str:
    return w.decode("utf-8", "replace").strip(_PUNCTUATION).lower()


class Vocabulary(dict):
    """Ids of words by their bytes, and by id what the template needs to know of each: its name and flags."""

    def __init__(self):
        super().__init__()
        self.name, self.flags = np.empty(1 << 16, U), np.empty(1 << 16, np.uint8)

    def __missing__(self, word: bytes) -> int:
        w = word.decode("utf-8", "replace")
        core = w.strip(_PUNCTUATION)
        low = core.lower()
        flags = _EMPTY if not core else 0
        if low in _NUMBER_WORDS or core and (core[0].isdigit() or core[0] in _SIGNS) and (_NUMBER.fullmatch(core) or _GLUED.fullmatch(low)):
            flags |= _IS_NUMBER
        if low in _UNITS:
            flags |= _IS_UNIT
        if core and core[0].isupper() and (len(core) == 1 or not core.isupper()):
            flags |= _IS_TITLE
        if w[-1] in ".!?:":
            flags |= _ENDS
        i = self[word] = len(self)
        if i == len(self.name):
            self.name, self.flags = np.resize(self.name, 2 * i), np.resize(self.flags, 2 * i)
        self.name[i], self.flags[i] = xxh3_64_intdigest(low.encode()), flags
        return i

    def template(self, text: bytes | None) -> Template:
        """The forms of a text and the words they stand for."""
        if len(self) > REMEMBERED:
            self.clear()
        words, starts = [], []
        for line in (text or b"").split(b"\n"):
            got = line.split()
            if got:
                starts.append(len(words))
                words += got
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not len(ids):
            return Template(np.empty(0, U), np.empty(0, U), np.empty(0, np.int8), np.empty(0, np.int8), [])
        name, flags = self.name[ids], self.flags[ids]
        number = (flags & _IS_NUMBER) > 0
        first = np.append(False, (flags[:-1] & _ENDS) > 0)
        first[starts] = True
        kind = np.where(number, NUM, np.where(((flags & _IS_UNIT) > 0) & np.append(False, number[:-1]), UNIT, np.where(((flags & _IS_TITLE) > 0) & ~first, NAME, 0))).astype(np.int8)
        second = np.where((kind == 0) & ((flags & _IS_TITLE) > 0), NAME, kind).astype(np.int8)
        if (flags & _EMPTY).any():
            stay = np.flatnonzero((flags & _EMPTY) == 0)
            kind, second, name, words = kind[stay], second[stay], name[stay], [words[i] for i in stay.tolist()]
        return Template(np.where(kind > 0, _SLOT[kind], name), name, kind, second, words)


def _has(marked: np.ndarray, size: int) -> np.ndarray:
    """Which windows hold a marked word."""
    count = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=count[1:])
    return count[size:] > count[:-size]


def _all(marked: np.ndarray, size: int) -> np.ndarray:
    """Places of windows of marked words alone."""
    count = np.append(0, np.cumsum(marked))
    return np.flatnonzero(count[size:] - count[:-size] == size)


@dataclass(slots=True)
class Template:
    """Names of a text's words with slots and without, kinds of the first and second form, and the words."""

    name: np.ndarray
    plain: np.ndarray
    kind: np.ndarray
    second: np.ndarray
    words: list[bytes]

    def forms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the words in each of the three forms."""
        return self.name, np.where(self.kind != self.second, _SLOT[NAME], self.name), self.plain

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of the windows that begin alignments: of the first form those with a literal word, then those of
        the second with one and of the third that differ from it."""
        one, two, three = self.forms()
        first, plain = np.flatnonzero(_has(self.kind == 0, size)), np.flatnonzero(_has(self.kind > 0, size))
        differ = self.kind != self.second
        other = np.flatnonzero(_has(differ, size) & _has(self.second == 0, size)) if differ.any() else first[:0]
        names = [grams(prefix(x), at, size) if len(at) else np.empty(0, U) for x, at in ((one, first), (two, other), (three, plain))]
        return np.concatenate(names), np.concatenate([first, other, plain])

    def seeds(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of so many plain words in a row that are all slots in the second form."""
        at = _all(self.second > 0, size)
        return grams(prefix(self.plain), at, size) if len(at) else np.empty(0, U), at


@dataclass
class Index:
    """Template windows of a slice of the benchmark, sorted by name, and its items of a few words."""

    ids: list[int]
    items: list[Template]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # size -> names, items, places, marks; below 0: seeds
    short: dict[bytes, list[int]]  # line -> items
    longest: int  # bytes of the longest such line
    forms: list[tuple[np.ndarray, ...]]  # of each item
    slotted: list[bool]  # whether an item has a window of slots alone


def _line(text: bytes) -> tuple[bytes, int]:
    """A line as short items are compared, and its number of words."""
    words = text.decode("utf-8", "replace").lower().split()
    return " ".join(words).strip(_PUNCTUATION + " ").encode(), sum(1 for w in words if w.strip(_PUNCTUATION))


def _marks(names: np.ndarray) -> np.ndarray:
    """A table by the first bits of names that tells which may be among them: a quick look ahead of the search."""
    bits = min(24, max(12, (16 * len(names)).bit_length()))
    out = np.zeros(1 << bits, bool)
    out[names >> U(64 - bits)] = True
    return out


def index(rows: list[tuple[int, str | None]]) -> Index:
    vocabulary, ids, items, held, short = Vocabulary(), [], [], {}, {}
    for item_id, text in rows:
        t = vocabulary.template(None if text is None else text.encode())
        size = min(WINDOW, len(t.words))
        if not size:
            continue
        if size < SHORTEST:
            short.setdefault(_line(text.encode())[0], []).append(len(ids))
        else:
            names, at = t.windows(size)
            if _starts_upper(t) and (t.kind[1:size] == 0).any():  # within a sentence, its first word looks like a name
                other = np.append(_SLOT[NAME], t.name[1:size])
                names, at = np.append(names, grams(prefix(other), np.zeros(1, int), size)), np.append(at, 0)
            few = min(SEED, -(-SHARE * size // 100))
            for key, names, at in ((size, names, at), (-few, *t.seeds(few))):
                if len(names):
                    _, single = np.unique(np.column_stack([names, at.astype(U)]), axis=0, return_index=True)
                    held.setdefault(key, []).append((names[single], np.full(len(single), len(ids)), at[single]))
        ids.append(item_id)
        items.append(t)
    windows = {}
    for size, parts in held.items():
        name, item, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(name, kind="stable")
        windows[size] = name[order], item[order], at[order], _marks(name)
    slotted = [len(t.words) >= SHORTEST and len(_all(t.second > 0, min(WINDOW, len(t.words)))) > 0 for t in items]
    return Index(ids, items, windows, short, max(map(len, short), default=0), [t.forms() for t in items], slotted)


def _starts_upper(t: Template) -> bool:
    return t.words[0][:1].isalpha() and t.words[0].decode("utf-8", "replace")[0].isupper()


def _short(idx: Index, text: bytes, words: int) -> dict[int, tuple]:
    """Short items that the text has as whole lines, or is."""
    best: dict[int, tuple] = {}
    for line in text.split(b"\n"):
        if line and len(line) <= 2 * idx.longest + 64:
            key, n = _line(line)
            for item in idx.short.get(key, ()):
                if n > 1 or words == 1:
                    best[item] = n, n, "exact"
    return best


def matches(idx: Index, t: Template, text: bytes | None = None) -> list[tuple[int, int, int, str]]:
    """(item, covered words, item words, kind) of each item that the template, or a line of its text, contains."""
    best = _short(idx, text, len(t.words)) if idx.short and text else {}
    forms = t.forms()
    seen: dict[int, np.ndarray] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for size, (names, items, places, marks) in idx.windows.items():
        if len(t.words) < abs(size):
            continue
        every, at = t.windows(size) if size > 0 else t.seeds(-size)
        bits = U(64 - (len(marks).bit_length() - 1))
        for k in range(0, len(every), WINDOWS):
            maybe = k + np.flatnonzero(marks[every[k : k + WINDOWS] >> bits])
            lo = np.searchsorted(names, every[maybe])
            hit = names[np.minimum(lo, len(names) - 1)] == every[maybe]
            maybe, lo = maybe[hit], lo[hit]
            if not len(maybe):
                continue
            count = np.searchsorted(names, every[maybe], side="right") - lo
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            which, begin = items[entry], np.repeat(at[maybe], count) - places[entry]
            order = np.lexsort((begin, which))
            which, begin = which[order], begin[order]
            new = np.append(True, (which[1:] != which[:-1]) | (begin[1:] != begin[:-1]))
            which, begin = which[new], begin[new]
            for item in np.unique(which).tolist():
                if best.get(item, (0,))[0] < len(idx.items[item].words):  # one that is covered whole can't be covered better
                    mine = begin[which == item]
                    if idx.slotted[item]:  # a stretch of slots goes with an alignment that begins beside it
                        mine = np.unique(mine[:, None] + np.arange(-WINDOW, WINDOW + 1))
                    mine = np.setdiff1d(mine, seen[item], assume_unique=True) if item in seen else mine
                    seen[item] = np.union1d(seen[item], mine) if item in seen else mine
                    _alignments(idx, item, t, forms, mine, best, runs)
    for item, held in runs.items():
        if len(held) > 1:
            for pairs in _chains(sorted(held)):
                if best.get(item, (0,))[0] == len(idx.items[item].words):
                    break
                _judge(idx.items[item], item, pairs, t, best)
    return [(item, *x) for item, x in sorted(best.items())]


def _longest(marked: np.ndarray) -> np.ndarray:
    """The longest run of marks in each row."""
    count = np.cumsum(marked, axis=1)
    return (count - np.maximum.accumulate(np.where(marked, 0, count), axis=1)).max(axis=1)


def _spread(windows: np.ndarray, size: int) -> np.ndarray:
    """The words that marked windows cover, by row."""
    count = np.cumsum(np.pad(windows, ((0, 0), (size, size - 1))), axis=1)
    return count[:, size:] > count[:, :-size]


def _alignments(idx: Index, item: int, t: Template, forms, begins: np.ndarray, best: dict[int, tuple], runs: dict[int, list]) -> None:
    """Compare an item with the text at each of the given places, as a whole, and note the best alignment that counts.

    runs gets the stretches that windows cover.
    """
    entry, theirs = idx.items[item], idx.forms[item]
    n, total = len(entry.words), len(t.words)
    size = min(WINDOW, n)
    upper = _starts_upper(entry)
    for k in range(0, len(begins), max(1, CELLS // n)):
        begin = begins[k : k + max(1, CELLS // n)]
        at = begin[:, None] + np.arange(n)
        there = (at >= 0) & (at < total)
        at = np.clip(at, 0, total - 1)

        def alike(form: int) -> np.ndarray:
            """Windows of which all words are equal in a form."""
            count = np.cumsum(np.pad((forms[form][at] == theirs[form]) & there, ((0, 0), (1, 0))), axis=1)
            return count[:, size:] - count[:, :-size] == size

        plain = alike(0) | alike(2)
        if upper:
            count = ((forms[0][at[:, 1:size]] == theirs[0][1:size]) & there[:, 1:size]).sum(axis=1)
            plain[:, 0] |= (count == size - 1) & there[:, 0] & (forms[0][at[:, 0]] == _SLOT[NAME])
        whole = _spread(plain | alike(1), size)
        differ = forms[2][at] != theirs[2]
        slot = ((t.second[at] > 0) | (entry.second > 0)) & ((t.kind[at] > 0) | differ)  # a word that only the second form takes as a name is a literal if both have it
        for covers in (_spread(plain, size), whole):  # what the second form adds takes nothing away
            covered = covers.sum(axis=1)
            slots, changed = covers & slot, covers & slot & differ
            enough = ((covered >= ENOUGH) | (100 * covered >= SHARE * n)) & (covered > best.get(item, (0,))[0])
            longest = _longest(covers & ~changed)
            copy = (100 * changed.sum(axis=1) <= DIFFER * covered) | (longest >= LONG) | (100 * longest >= SHARE * n)
            fits = enough & (copy | (2 * slots.sum(axis=1) <= covered))
            for row in sorted(np.flatnonzero(fits).tolist(), key=lambda r: -covered[r]):
                if covered[row] <= best.get(item, (0,))[0]:
                    break
                i = np.flatnonzero(slots[row])
                if copy[row] or _one_to_one(entry.plain[i], t.plain[at[row][i]]):
                    best[item] = int(covered[row]), n, "reparameterised" if changed[row].any() else "exact"
        if best.get(item, (0,))[0] == n:
            return
        edge = np.diff(np.pad(whole, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        runs.setdefault(item, []).extend(zip((begin[r] + lo).tolist(), lo.tolist(), (hi - lo).tolist()))


def _one_to_one(a: np.ndarray, b: np.ndarray) -> bool:
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def _judge(entry: Template, item: int, pairs: list[tuple[int, int]], t: Template, best: dict[int, tuple]) -> None:
    """Note a chain of places (of the item, of the document) if it counts and covers more than the best so far."""
    covered, n = len(pairs), len(entry.words)
    if (covered < ENOUGH and 100 * covered < SHARE * n) or covered <= best.get(item, (0,))[0]:
        return
    i, p = np.array(pairs).T
    differ = entry.plain[i] != t.plain[p]
    slot = ((t.second[p] > 0) | (entry.second[i] > 0)) & ((t.kind[p] > 0) | differ)
    changed = slot & differ
    if 100 * changed.sum() > DIFFER * covered:
        longest = run = 0
        for k in range(covered):
            run = 0 if changed[k] else run + 1 if k and pairs[k - 1] == (i[k] - 1, p[k] - 1) else 1
            longest = max(longest, run)
        if longest < LONG and 100 * longest < SHARE * n and (2 * slot.sum() > covered or not _one_to_one(entry.plain[i[slot]], t.plain[p[slot]])):
            return
    best[item] = covered, n, "reparameterised" if changed.any() else "exact"


def _chains(held: list[tuple[int, int, int]]):
    """Pairs of places of runs (document, item, words) that follow one another, for each last run of a chain the longest one."""
    total, back, last = [], [], 0
    longest = max(n for *_, n in held)
    for k, (p, i, n) in enumerate(held):
        total.append(n)
        back.append(-1)
        while held[last][0] + longest + WINDOW < p:
            last += 1
        for j in range(last, k):
            q, o, m = held[j]
            cut = max(0, q + m - p, o + m - i)  # words of the later run that the earlier one has
            if cut < n and p > q and i > o and p + cut - q - m <= WINDOW and i + cut - o - m <= WINDOW and total[j] + n - cut > total[k]:
                total[k], back[k] = total[j] + n - cut, j
    ended = set(range(len(held))) - set(back)
    for k in sorted(ended, key=lambda k: -total[k]):
        if back[k] < 0:
            continue
        chain = []
        while k >= 0:
            chain.append(held[k])
            k = back[k]
        pairs: list[tuple[int, int]] = []
        for p, i, n in reversed(chain):
            cut = max(0, pairs[-1][1] + 1 - p, pairs[-1][0] + 1 - i) if pairs else 0
            pairs += [(i + x, p + x) for x in range(cut, n)]
        yield pairs


def _indexes(benchmark: DataFrame):
    """Broadcast indexes of the benchmark's slices, one at a time."""
    spark = benchmark.sparkSession
    bench = only(benchmark, "item_id", "text")
    n = bench.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).head()[0]
    slices = parts_for(n, SLICE_WORDS, 1)
    for k in range(slices):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield spark.sparkContext.broadcast(index([tuple(x) for x in part.orderBy("item_id").collect()]))  # at most about SLICE_WORDS words


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, kind: one row for each benchmark item that a row of docs contains."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, matched_words long, item_words long, kind string"
    out = spark.createDataFrame([], schema)

    def run(held):
        def find(batches):
            lean()
            vocabulary, idx = Vocabulary(), held.value
            for b in batches:
                rows = [(doc, idx.ids[i], c, n, k) for doc, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))) for i, c, n, k in matches(idx, vocabulary.template(text), text)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "item_id", "matched_words", "item_words", "kind"])

        return find

    for held in _indexes(benchmark):
        out = out.unionByName(only(docs, "doc_id", "text").mapInArrow(run(held), schema))
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns."""
    small_batches(docs.sparkSession)

    def run(held):
        def clean(batches):
            lean()
            vocabulary, idx = Vocabulary(), held.value
            for b in batches:
                yield b.filter(pa.array([not matches(idx, vocabulary.template(t), t) for t in as_bytes(b.column("text"))], pa.bool_()))

        return clean

    schema = docs.schema
    for held in _indexes(benchmark):
        docs = docs.mapInArrow(run(held), schema)
    return docs
