"""Language identification by prediction by partial matching: exact code lengths under frozen byte context trees.

A context tree of a language counts the bytes that follow each context of 0 to 4 bytes. After a context met n times with
u different next bytes, a byte met c times there costs -log2(c / (n + u)) bits; any other costs the escape
-log2(u / (n + u)) and then what the next shorter context charges (without exclusions). A context that the language never
met charges nothing and passes on; below the empty context every byte costs 8 bits. The language with the shortest code
for the whole text wins; of equal ones the first by name.

The trees are fitted on a bounded sample: for each language the TRAIN_TEXTS texts (fewer beyond ALL_TEXTS in all languages,
LEAST_TEXTS at least) whose doc_id has the smallest hash, each whole or, if longer, in a stretch of TRAIN_CHARS characters from
a hashed place. They are frozen then, and every byte of every text is scored.

Null text, text without a letter, or no language to learn: "und" with score 0. The score is the share of the winner if the
languages' code lengths are taken as log likelihoods over at most SCORE_BYTES bytes. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.runtime import only, small_batches
from lectern.llm.words import U, as_bytes, lean

ORDER = 4
TRAIN_TEXTS, LEAST_TEXTS, ALL_TEXTS, TRAIN_CHARS = 400, 25, 8_000, 32_768
#: Bytes that count fully for the score, and bytes scored at once.
SCORE_BYTES, AT_ONCE = 64, 4_000_000
UNKNOWN = "und"
#: What stands before a text.
PAD = b"\n" * ORDER
_SPREAD = U(0x9E3779B97F4A7C15)
_LETTER = re.compile("[A-Za-z]")


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes up to each place as a number, from the place size - 1 on."""
    out = np.zeros(len(data) - size + 1, U)
    for k in range(size):
        out = (out << U(8)) | data[k : len(data) - size + 1 + k].astype(U)
    return out


class Table:
    """Rows of floats by number: a direct hash table for most keys, a sorted list for those that collide."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        self.bits = max(8, int(2 * max(1, len(keys))).bit_length() + 1)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[self._hash(keys)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.slot[self._hash(keys)] != np.arange(len(keys)))
        self.rest, self.rest_keys = lost, keys[lost]  # keys ascend, so do these

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD) >> U(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self.slot[self._hash(keys)]
        at = np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)
        if len(self.rest):
            miss = np.flatnonzero(at < 0)
            k = np.minimum(np.searchsorted(self.rest_keys, keys[miss]), len(self.rest) - 1)
            at[miss] = np.where(self.rest_keys[k] == keys[miss], self.rest[k], -1)
        return at


@dataclass
class Trees:
    """Costs of all languages: by order the grams (context and byte) and the escapes from contexts."""

    langs: list[str]
    grams: list[Table]
    escapes: list[Table]

    def costs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits that each language pays for the last byte of each gram of order + 1 bytes."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        at = self.grams[order].find(grams)
        out = self.grams[order].rows[at] if len(self.grams[order].keys) else np.zeros((len(grams), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self.passed(grams[miss], order) + self.costs(grams[miss] & U((1 << 8 * order) - 1), order - 1)
        return out

    def passed(self, grams: np.ndarray, order: int) -> np.ndarray:
        """The escape from the gram's context; nothing where a language never met it."""
        at = self.escapes[order].find(grams >> U(8))
        if not len(self.escapes[order].keys):
            return np.zeros((len(grams), len(self.langs)), np.float32)
        return np.where((at >= 0)[:, None], self.escapes[order].rows[at], np.float32(0))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        k = 0
        while k < len(texts):
            first, total = k, 0
            while k < len(texts) and (k == first or total + len(texts[k]) <= AT_ONCE):
                total += len(texts[k])
                k += 1
            data = np.frombuffer(b"".join(PAD + t for t in texts[first:k]), np.uint8)
            size = np.array([len(t) for t in texts[first:k]])
            starts = np.cumsum(size + ORDER) - size - ORDER  # of the grams that end on a text's first byte
            for i, (at, n) in enumerate(zip(starts.tolist(), size.tolist())):
                if n > AT_ONCE // 8:  # long texts by themselves, piece by piece
                    piece = AT_ONCE // 8
                    out[first + i] = sum(self.costs(codes(data[at + j : at + min(j + piece, n) + ORDER], ORDER + 1)).sum(0, dtype=np.float64) for j in range(0, n, piece))
            short = np.flatnonzero((size > 0) & (size <= AT_ONCE // 8))
            if len(short):
                bits = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self._all(data), axis=0)])
                out[first + short] = bits[starts[short] + size[short]] - bits[starts[short]]
        return out

    def _all(self, data: np.ndarray) -> np.ndarray:
        grams, step = codes(data, ORDER + 1), AT_ONCE // 8
        return np.concatenate([self.costs(grams[i : i + step]) for i in range(0, len(grams), step)]).astype(np.float64)


def grow(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Trees:
    """Trees from each language's (grams, counts) by order."""
    langs = sorted(counts)
    trees = Trees(langs, [], [])
    for order in range(ORDER + 1):
        keys = np.unique(np.concatenate([counts[x][order][0] for x in langs] or [np.empty(0, U)]))
        contexts = np.unique(keys >> U(8))
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        rows = np.zeros((len(keys), len(langs)), np.float32)
        seen = np.zeros((len(keys), len(langs)), bool)
        for j, x in enumerate(langs):
            grams, n = counts[x][order]
            at = np.searchsorted(contexts, grams >> U(8))
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            met = total > 0
            escape[met, j] = -np.log2(kinds[met] / (total + kinds)[met])
            k = np.searchsorted(keys, grams)
            rows[k, j] = -np.log2(n / (total + kinds)[at])
            seen[k, j] = True
        trees.escapes.append(Table(contexts, escape))
        trees.grams.append(Table(keys[:0], rows[:0]))  # so that passed() and lower orders can be asked
        if len(keys):
            lower = trees.passed(keys, order) + trees.costs(keys & U((1 << 8 * order) - 1), order - 1)
            trees.grams[order] = Table(keys, np.where(seen, rows, lower).astype(np.float32))
    return trees


def fit(rows) -> Trees:
    """Trees from (lang, text bytes) pairs."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    counts = {}
    for lang, held in texts.items():
        data = [np.frombuffer(PAD + t, np.uint8) for t in held if t]
        counts[lang] = [np.unique(np.concatenate([codes(x[ORDER - k :], k + 1) for x in data] or [np.empty(0, U)]), return_counts=True) for k in range(ORDER + 1)]
    return grow(counts)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def training_sample(docs: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """lang, text (or a stretch of it) of at most TRAIN_TEXTS rows for each language, whatever their length."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length("text") > 0))
    count = {x: n for x, n in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # a row for each language
    each = max(LEAST_TEXTS, min(TRAIN_TEXTS, ALL_TEXTS // max(1, len(count))))
    share = F.create_map(*[F.lit(v) for x, n in count.items() for v in (x, min(1.0, (1.5 * each + 60) / n))]) if count else None
    if share is None:
        return rows.select(F.col(lang).alias("lang"), "text")
    spot = F.xxhash64(F.col(key).cast("string"), "text")
    rows = rows.where(F.pmod(spot, F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30))
    more = F.greatest(F.lit(0), F.length("text") - TRAIN_CHARS)
    stretch = F.substring("text", F.pmod(F.xxhash64("text"), more.cast("long") + 1).cast("int") + 1, F.lit(TRAIN_CHARS))
    order = Window.partitionBy("lang").orderBy("spot")  # over 700 rows a language or so
    return rows.select(F.col(lang).alias("lang"), stretch.alias("text"), spot.alias("spot")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("lang", "text")


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(trees)

    def run(batches):
        lean()
        t = held.value
        for b in batches:
            plain = b.column("text").to_pylist()
            known = np.array([bool(t.langs) and has_letter(x) for x in plain], bool)
            texts = [x if k else b"" for x, k in zip(as_bytes(b.column("text")), known)]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known.any():
                bits = t.lengths(texts)
                size = np.array([len(x) for x in texts])
                bits -= bits.min(1, keepdims=True)
                share = np.exp2(-bits * (SCORE_BYTES / np.maximum(size, SCORE_BYTES))[:, None])
                score = np.where(known, share.max(1) / share.sum(1), 0.0)
                best = [t.langs[j] if k else UNKNOWN for j, k in zip(bits.argmin(1), known)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
