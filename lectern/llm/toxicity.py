"""Toxicity by noisy-channel deobfuscation: restore disguised words under a character language model, then score the text.

1. A character model (counts of 4-grams of lower-cased words of letters) is gathered from all texts, into a table.
2. A token that looks disguised - characters that stand for letters among letters, a letter three or more times in a row,
   single characters set apart by spaces, bits of up to three by separators - becomes a lattice: each character may be itself, a letter that
   it is used for, or dropped (separators, repeats, letter-like signs at either end). Viterbi decoding finds the cheapest path under the character model
   plus the channel's costs. Other tokens are taken as they are. Each distinct disguised token of the corpus is decoded once:
   tokens are dealt into groups, a group asks the table for the counts that its lattices can use, and no task holds more.
3. The lexicon is learnt from labelled texts, restored alike: words that SUPPORT or more toxic texts use, each
   text standing for the first by name of the word's neighbourhoods in it (so copies of one text count once), and beginnings of such words (from STEM letters on), if other texts
   hardly have them. A text's evidence is the sum over its distinct words of the log odds of the word or its beginnings,
   the largest of them; a logistic curve of the number of strong words and the sum of the
   others, fitted to the labelled sample, turns it into the score.
4. Restored words that weigh anything go back to their texts; all other words are weighed where they stand.

Labels come from a bounded sample, the TRAIN_ROWS labelled rows whose doc_id has the smallest hash. Every text is scored
whole, and tokens of any length are decoded. Null and empty texts have no evidence and get the curve's lowest value. Without labels of both kinds no word is
learnt and every score is the share of label 1 (0 without labels). A token stays as it is if no 4-gram of what it decodes
to has been seen. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep, likely, only, parts_for, small_batches, with_few
from lectern.llm.words import lean

TRAIN_ROWS, SUPPORT, ODDS, STEM = 20_000, 4, 8.0, 4
#: Log odds of a strong word; evidence beyond which more doesn't change the curve's verdict (parameters of the model).
STRONG, MANY, CLEAR = 5.0, 3.0, 12.0
GRAM, REMEMBERED = 4, 200_000
#: Distinct words that a map task counts before it sends their 4-grams; distinct tokens decoded together.
COUNTED, TOGETHER = 300_000, 10_000
#: Characters after which the decoder puts aside what its paths spell.
PIECE = 64
#: Letters that a character is used for (fixed values of the channel).
STANDS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~^'`·/\\"
#: Bits that the channel charges for a letter in disguise, a dropped separator, a dropped repeat, and a digit or sign kept.
DISGUISED, DROPPED, REPEAT, KEPT = 1.0, 0.5, 0.5, 6.0
_EDGE = " \t\"'.,;:!?*#%&|$()[]{}<>«»“”‘’…-_~^/\\"
_SIGNS = "".join(map(re.escape, STANDS))
#: An underline is a separator only, and separators aren't given back, or the time would grow exponentially with the token.
_ODD = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1\1|^[^\W_]{{1,3}}(?:[{re.escape(SEPARATORS)}]++[^\W_]{{1,3}}){{2,}}$")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?<!\S)\S(?:[ \t]+\S){3,}(?!\S)")


class CharModel:
    """Bits of a character after the three before it, from counts; unseen ones share the mass of one count each."""

    def __init__(self, counts: dict[str, int], contexts: dict[str, int] | None = None, kinds: int | None = None):
        self.grams = counts
        self.contexts = contexts
        if contexts is None:
            self.contexts = Counter()
            for g, n in counts.items():
                self.contexts[g[:-1]] += n
        self.kinds = max(2, len({g[-1] for g in counts}) if kinds is None else kinds)

    def bits(self, before: str, c: str) -> float:
        return -math.log2((self.grams.get(before + c, 0) + 0.1) / (self.contexts.get(before, 0) + 0.1 * self.kinds))


def word_grams(word: str) -> list[str]:
    w = "^" * (GRAM - 1) + word + "$"
    return [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]


def choices(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each character what it may stand for, and the channel's charge."""
    out = []
    core = token.strip(_EDGE)
    start = token.index(core)
    for i, c in enumerate(token):
        if c.isalpha():
            again = i and token[i - 1] == c
            out.append([(c, 0.0)] + ([("", REPEAT)] if again else []))
        else:
            way = [(x, DISGUISED) for x in STANDS.get(c, "")] + [(c, KEPT)]
            out.append(way + ([("", DROPPED)] if c in SEPARATORS or c.isspace() else []) + ([("", REPEAT)] if i and token[i - 1] == c else []))
            if core and not start <= i < start + len(core) and c not in SEPARATORS:
                out[-1].append(("", DROPPED))
    return out


def viterbi(token: str, model: CharModel) -> str:
    """The cheapest path through the token's lattice."""
    paths = {"^" * (GRAM - 1): (0.0, "")}
    done: dict[str, tuple] = dict.fromkeys(paths, ())  # what was settled of each path, as linked pieces
    for k, options in enumerate(choices(token), 1):
        best: dict[str, tuple[float, str]] = {}
        settled: dict[str, tuple] = {}
        for before, (cost, text) in paths.items():
            for c, charge in options:
                after = (before + c)[-(GRAM - 1) :]
                total = cost + charge + (model.bits(before, c) if c else 0.0)
                if after not in best or (total, text + c) < best[after]:
                    best[after] = total, text + c
                    settled[after] = done[before]
        paths, done = best, settled
        if k % PIECE == 0:  # texts stay short, so that the time grows with the token's length alone
            done = {x: (done[x], text) for x, (_, text) in paths.items()}
            paths = {x: (cost, "") for x, (cost, _) in paths.items()}
    _, text, last = min((cost + model.bits(before, "$"), text, before) for before, (cost, text) in paths.items())
    pieces, link = [text], done[last]
    while link:
        link, text = link
        pieces.append(text)
    return "".join(reversed(pieces))


def asked(token: str) -> set[str]:
    """The 4-grams that some path through the token's lattice has: all that decoding asks of the counts."""
    states, out = {"^" * (GRAM - 1)}, set()
    for options in choices(token):
        after = set()
        for before in states:
            for c, _ in options:
                if c:
                    out.add(before + c)
                    after.add((before + c)[-(GRAM - 1) :])
                else:
                    after.add(before)
        states = after
    return out | {before + "$" for before in states}


def decode(full: str, model: CharModel) -> str:
    """A disguised token restored."""
    got = viterbi(full, model)
    return got if any(g in model.grams for g in word_grams(got)) else full.strip(_EDGE)


def plain_or_odd(token: str) -> tuple[str, str | None]:
    """The token lower-cased without signs at either end, and with its letter-like ones if it looks disguised."""
    core = token.strip(_EDGE).lower()
    if not core:
        return core, None
    if token.isalpha():  # only a repeated letter can make such a word look disguised
        return core, core if _THRICE.search(core) else None
    low = token.lower()
    at = low.index(core)
    full = "".join(c for c in low[:at] if c in STANDS) + core + "".join(c for c in low[at + len(core) :] if c in STANDS)
    if full.isalpha():
        return core, full if _THRICE.search(full) else None
    return core, full if _ODD.search(full) else None


def set_apart(text: str) -> list[str]:
    """Characters set apart by spaces, each stretch joined."""
    return [joined for m in _APART.finditer(text) if len(set(joined := "".join(m.group().split()).lower())) > 2]


@dataclass
class Restorer:
    """Restored forms of tokens, by a model or by what is known of a text's disguised tokens; remembers the last tokens."""

    model: CharModel | None = None
    known: dict[str, str] = field(default_factory=dict)
    held: dict[str, str] = field(default_factory=dict)

    def decode(self, full: str) -> str:
        return decode(full, self.model) if self.model else self.known.get(full, full.strip(_EDGE))

    def word(self, token: str) -> str:
        got = self.held.get(token)
        if got is None:
            core, full = plain_or_odd(token)
            if len(self.held) > REMEMBERED:
                self.held.clear()
            got = self.held[token] = core if full is None else self.decode(full)
        return got

    def apart(self, text: str) -> list[str]:
        """Restored forms of characters set apart by spaces."""
        return [self.decode(x) for x in set_apart(text)]

    def restore(self, text: str | None) -> str:
        """The text with disguised tokens restored; words are lower-cased and stripped of punctuation."""
        joined = _APART.sub(lambda m: self.decode(x) if len(set(x := "".join(m.group().split()).lower())) > 2 else m.group(), text or "")
        return "\n".join(" ".join(w for w in map(self.word, line.split()) if w) for line in joined.split("\n"))


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    return [word, *(word[:i] + "*" for i in range(STEM, len(word)))]


def within(joined: str, wanted, longest: int) -> set[str]:
    """Wanted words of at most ``longest`` letters in what characters set apart spell."""
    return {w for i in range(len(joined)) for k in range(i + STEM, min(len(joined), i + longest) + 1) if (w := joined[i:k]) in wanted}


def used_words(text: str | None, restorer: Restorer, wanted, longest: int) -> set[str]:
    """Restored words of the text; of characters set apart, the wanted words found in what they spell."""
    if not text:
        return set()
    return set(map(restorer.word, set(text.split()))) | {w for x in restorer.apart(text) for w in within(x, wanted, longest)}


@dataclass
class Scorer:
    """What is frozen after learning: the lexicon's log odds and the curve."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    known: dict[str, float] = field(default_factory=dict)
    heads: frozenset[str] | None = None

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[word] = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        return got

    def evidence(self, words: set[str]) -> tuple[float, float]:
        """The number of strong words and the sum of the weaker ones' log odds, both up to a bound."""
        got = [self.weight(w) for w in words]
        return min(MANY, sum(x >= STRONG for x in got)), min(CLEAR, sum(x for x in got if x < STRONG))

    def heavy(self, word: str) -> list[str]:
        """What weighs in a restored token: the word, or words in what characters set apart spell."""
        return [word] if self.weight(word) else sorted(within(word, self.weights, max(map(len, self.weights), default=0)))

    def plain(self, text: str | None) -> set[str]:
        """Words that weigh among the tokens that aren't disguised."""
        if not text or not self.weights:
            return set()
        if self.heads is None:  # what weighs begins as some word or beginning of the lexicon
            self.heads = frozenset(f.rstrip("*")[:STEM] for f in self.weights)
        heads, out = self.heads, set()
        for token in set(text.split()):
            core = token.strip(_EDGE).lower()
            if core[:STEM] in heads and plain_or_odd(token)[1] is None and self.weight(core):
                out.add(core)
        return out

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * evidence[0] + self.curve[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def gram_counts(words: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The 4-grams of the words, each as often as its word."""
    cores: Counter[str] = Counter()
    for w, n in words.items():
        core = w.strip(_EDGE).lower()
        if core.isalpha():
            cores[core] += n
    if not cores:
        return [], np.empty(0, np.int64)
    edge = "^" * (GRAM - 1)
    codes = np.frombuffer("".join(f"{edge}{w}$" for w in cores).encode("utf-32-le"), np.uint32)
    grams = np.array([len(w) + 1 for w in cores])
    begins = np.cumsum(grams + GRAM - 1) - (grams + GRAM - 1)
    at = np.repeat(begins - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    here = np.zeros(0x110000, bool)
    here[codes] = True
    alphabet = np.flatnonzero(here).astype(np.uint32)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    dense, key = place[codes], np.zeros(len(at), np.int64)
    for k in range(GRAM):  # some 50 000 kinds of characters fit
        key = key * len(alphabet) + dense[at + k]
    key, which = np.unique(key, return_inverse=True)
    n = np.bincount(which, np.repeat(np.fromiter(cores.values(), np.float64, len(cores)), grams)).astype(np.int64)
    out = np.empty((len(key), GRAM), np.uint32)
    for k in reversed(range(GRAM)):
        out[:, k] = alphabet[key % len(alphabet)]
        key = key // len(alphabet)
    return [x.decode("utf-32-le") for x in out.astype("<u4").view(f"V{4 * GRAM}").ravel().tolist()], n


@dataclass
class Gathered:
    """What one pass over all texts gathers: counts (gram, n) of all 4-grams, and odd (row, token) of all disguised tokens."""

    counts: DataFrame
    odd: DataFrame


def gather(docs: DataFrame) -> Gathered:
    """Counts and disguised tokens of all texts; row is a name of the text, so that copies give the same."""

    def grams(words: Counter) -> pa.RecordBatch:
        names, n = gram_counts(words)
        none = [None] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.string())], ["gram", "n", "row", "token"])

    def run(batches):
        lean()
        words: Counter[str] = Counter()
        plain, before, full, keys = set(), set(), {}, set()  # tokens met, those met earlier, disguised ones, and these as a set
        for b in batches:
            names, texts = b.column("row").to_pylist(), b.column("text").to_pylist()
            tokens = [t.split() if t else [] for t in texts]
            fresh: set[str] = set()
            for x in tokens:
                words.update(x)
                fresh.update(x)
            if len(full) > REMEMBERED:
                full.clear()
                keys.clear()
            for token in fresh.difference(plain, before, keys):
                odd_form = plain_or_odd(token)[1]
                if odd_form is None:
                    plain.add(token)
                else:
                    full[token] = odd_form
                    keys.add(token)
            rows, odd = [], []
            for row, t, x in zip(names, texts, tokens):
                if t:
                    forms = {full[token] for token in keys.intersection(x)}.union(set_apart(t))
                    rows += [row] * len(forms)
                    odd += sorted(forms)
            if len(plain) > REMEMBERED:
                plain, before = set(), plain
            none = [None] * len(odd)
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.string()), pa.array(none, pa.int64()), pa.array(rows, pa.int64()), pa.array(odd, pa.string())], ["gram", "n", "row", "token"])
            if len(words) > COUNTED:
                yield grams(words)
                words.clear()
        if words:
            yield grams(words)

    small_batches(docs.sparkSession)
    all = keep(docs.select(F.xxhash64("text").alias("row"), "text").mapInArrow(run, "gram string, n long, row long, token string"))
    counts = keep(all.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    return Gathered(counts, all.where("token IS NOT NULL").select("row", "token"))


def restored(g: Gathered) -> DataFrame:
    """row, token, word: what each disguised token of each text decodes to under the whole counts."""
    spark = g.counts.sparkSession
    tokens = keep(g.odd.select("token").distinct())
    groups = parts_for(tokens.count(), TOGETHER, 8)
    kinds = g.counts.select(F.substring("gram", GRAM, 1)).distinct().count()
    contexts = g.counts.groupBy(F.substring("gram", 1, GRAM - 1).alias("key")).agg(F.sum("n").alias("n"))
    facts = keep(g.counts.select(F.col("gram").alias("key"), "n").unionByName(contexts))  # 4-grams and contexts differ in length

    def asks(batches):
        lean()
        out: set[tuple[int, str]] = set()

        def send():
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], ["part", "key"])

        for b in batches:
            for part, token in zip(b.column("part").to_pylist(), b.column("token").to_pylist()):
                for gram in asked(token):
                    out.add((part, gram))
                    out.add((part, gram[:-1]))
                if len(out) > REMEMBERED:
                    yield send()
                    out.clear()
        if out:
            yield send()

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        grams, before = {}, {}
        for key, n in zip(right.column("key").to_pylist(), right.column("n").to_pylist()):
            (grams if len(key) == GRAM else before)[key] = n
        model = CharModel(grams, before, kinds)
        held = left.column("token").to_pylist()
        return pa.table([pa.array(held, pa.string()), pa.array([decode(x, model) for x in held], pa.string())], names=["token", "word"])

    dealt = tokens.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(groups)).cast("int"))
    wanted = dealt.repartition(F.col("part")).mapInArrow(asks, "part int, key string").distinct().join(facts, "key")
    decoded = keep(dealt.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(spell, "token string, word string"))
    return keep(keep(g.odd.distinct()).join(decoded, "token").select("row", "token", "word"))  # both written: AQE can split a hot token


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows with the smallest hashes of doc_id, TRAIN_ROWS at most."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    rows = likely(only(docs, "doc_id", "text"), "doc_id", known)
    return keep(rows.join(F.broadcast(known), "doc_id"))  # TRAIN_ROWS at most


def learn(rows: DataFrame, words: DataFrame) -> Scorer:
    """The lexicon and the curve from rows (text, toxic) of a bounded sample; words: row, token, word of disguised tokens."""
    spark = rows.sparkSession
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    base = Scorer({}, (math.log((toxic + 0.5) / (n - toxic + 0.5)) if n else -30.0, 0.0, 0.0))
    if not toxic or toxic == n:
        return base
    rows = rows.select(F.xxhash64("text").alias("row"), "text", F.col("toxic").cast("int").alias("toxic"))
    known = words.join(F.broadcast(rows.select("row").distinct()), "row")  # TRAIN_ROWS names at most
    rows = keep(rows.join(known.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("known")), "row", "left"))

    def texts(b):
        """text, label and a restorer that knows the text's disguised tokens, of each row."""
        for text, label, pairs in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("known").to_pylist()):
            yield text, label, Restorer(known=dict(pairs or ()))

    def contexts(batches):
        for b in batches:
            out = set()
            for text, label, restorer in texts(b):
                if label == 1:
                    words = [w for w in map(restorer.word, (text or "").split()) if w] + restorer.apart(text or "")
                    near: dict[str, str] = {}
                    for x, w, y in zip(["", *words], words, [*words[1:], ""]):
                        if w.isalpha() and (w not in near or f"{x} {y}" < near[w]):
                            near[w] = f"{x} {y}"
                    out |= set(near.items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["word", "near"])

    used = rows.mapInArrow(contexts, "word string, near string").distinct()
    used = [x for (x,) in used.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("word").collect()]
    wanted = spark.sparkContext.broadcast(frozenset(f for w in used for f in features(w)))

    def present(batches):
        known = wanted.value
        longest = max(map(len, known), default=0)
        for b in batches:
            held = [sorted({f for w in used_words(t, restorer, known, longest) for f in features(w) if f in known}) for t, _, restorer in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string())), b.column("toxic")], ["features", "toxic"])

    held = rows.mapInArrow(present, "features array<string>, toxic int")
    stats = held.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a > b").collect()
    weights = {}
    for feature, a, b in stats:
        odds = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (n - toxic + 1))
        spread = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if math.log(odds) - spread > math.log(ODDS):
            weights[feature] = min(6.0, math.log(odds))
    if not weights:
        return base
    lexicon = spark.sparkContext.broadcast(Scorer(weights, base.curve))

    def weighed(batches):
        s = lexicon.value
        for b in batches:
            got = []
            for text, _, restorer in texts(b):
                got.append(s.evidence(s.plain(text) | {w for x in restorer.known.values() for w in s.heavy(x)}))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.float64()), b.column("toxic")], ["strong", "weak", "toxic"])

    # The curve: logistic regression on two numbers for each row of the bounded sample, by Newton steps.
    data = np.array(rows.mapInArrow(weighed, "strong double, weak double, toxic int").collect(), float)
    x, y = np.column_stack([np.ones(len(data)), data[:, :2]]), data[:, 2]
    curve, ridge = np.array([base.curve[0], 0.0, 0.0]), np.array([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * curve)
        curve = curve + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return Scorer(weights, tuple(curve.tolist()))


def score(docs: DataFrame, scorer: Scorer, words: DataFrame) -> DataFrame:
    """doc_id, score of every row, from its text alone. words: row, token, word of the texts' disguised tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(scorer)

    def heavy(batches):
        s = held.value
        for b in batches:
            got = [(row, w) for row, word in zip(b.column("row").to_pylist(), b.column("word").to_pylist()) for w in s.heavy(word)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], ["row", "word"])

    def run(batches):
        s = held.value
        for b in batches:
            got = [s.score(s.evidence(s.plain(t) | set(more or ()))) for t, more in zip(b.column("text").to_pylist(), b.column("more").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    hits = words.select("row", "word").mapInArrow(heavy, "row long, word string")
    hits = keep(hits.groupBy("row").agg(F.collect_set("word").alias("more")))  # of a lexicon learnt from a bounded sample
    rows = only(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    return with_few(rows, "row", hits).select("doc_id", "text", "more").mapInArrow(run, "doc_id long, score double")
