"""Best-fit packing with large-item matching.

1. Texts become token ids and these become pieces; a piece leaves as a short row (document, piece, start, length, crc).
2. Only the number of pieces of each length decides how bins are filled, and there are at most 1024 lengths. The plan is
   made from that histogram: pieces above a third of the capacity, of which a bin holds two at most, are matched greedily,
   the longest first, each with the longest partner that fits; then the shorter ones, the longest first, go to the fullest
   bin with room. The plan's size hangs on the capacity alone: it lists (length, ranks from-to, first bin, offset).
3. Each piece gets its rank among those of its length: ranks within (length, hash slice), a slice holding a bounded number
   of pieces, plus the sums of the slices before. The plan turns rank into bin and offset.

Null and empty texts are the end token alone. Repeated rows are packed as often as they stand. Pieces rank by document,
piece, start and crc, so that only rows alike in all of these can change places if a task is worked out again; rows without
a doc_id spread over the slices by their crc. An empty table gives no rows.

Token ids are those of the tokenizers file. For texts within code points up to U+024F that don't hold a special token's
string, the same vocabulary is applied by tiktoken, which gives the same ids (tests compare the two over that range) in a
quarter of the time; all other texts go through tokenizers itself.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.runtime import keep, only, small_batches
from lectern.llm.words import lean

CAPACITY, END = 1024, 2
#: Pieces in a hash slice of a length, about.
SLICE = 1000
#: The highest code point of texts that take the fast path.
_PLAIN = re.compile("[^\x00-ɏ]")
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """ids(text) by a tokenizers file; ranks is the same vocabulary for tiktoken, if there is one."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(*spec) -> Encoder:
    """One encoder a worker."""
    if spec not in _encoders:
        _encoders[spec] = Encoder(*spec)
    return _encoders[spec]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but the first, which takes what remains."""
    first = n % capacity or capacity
    return [(0, first)] + [(x, capacity) for x in range(first, n, capacity)]


def _pieces(spec: tuple, capacity: int):
    def run(batches):
        lean()
        enc = encoder(*spec)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(END)).astype("<u4")
                out += [(doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first bin, offset): pieces of that length and these ranks lie in consecutive bins."""
    left = {n: c for n, c in count.items() if c > 0}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    bins = 0
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first bin, number) of bins

    def put(n: int, m: int, at: int, offset: int) -> None:
        out.append((n, taken[n], m, at, offset))
        taken[n] += m
        left[n] -= m

    def fill(n: int, m: int, free: int) -> None:
        """m pieces into bins that have exactly ``free`` tokens of room."""
        runs = room[free]
        while m:
            at, k = runs.pop()
            if k > m:
                runs.append((at + m, k - m))
                k = m
            put(n, k, at, capacity - free)
            if free > n:
                room.setdefault(free - n, []).append((at, k))
            m -= k
        if not runs:
            del room[free]

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, n in enumerate(large):
        for other in large[i:]:
            if not left[n]:
                break
            if n + other > capacity or not left[other]:
                continue
            m = left[n] // 2 if other == n else min(left[n], left[other])
            if m:
                put(n, m, bins, 0)
                put(other, m, bins, n)
                if n + other < capacity:
                    room.setdefault(capacity - n - other, []).append((bins, m))
                bins += m
        if m := left[n]:
            put(n, m, bins, 0)
            if n < capacity:
                room.setdefault(capacity - n, []).append((bins, m))
            bins += m
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            free = min((f for f in room if f >= n), default=None)
            if free is None:  # as many new bins as these pieces fill, one piece each; the others follow into them
                m = -(-left[n] // (capacity // n))
                room[capacity] = [(bins, m)]
                bins += m
                free = capacity
            fill(n, min(left[n], sum(k for _, k in room[free])), free)
    return out


def pack(docs: DataFrame, spec: tuple, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of every row of docs.

    spec: (tokenizers file) or (tokenizers file, tiktoken file, pattern), paths on the executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = keep(only(docs, "doc_id", "text").mapInArrow(_pieces(spec, capacity), _SCHEMA))
    # One row for each of at most ``capacity`` lengths.
    count = dict(pieces.groupBy("length").agg(F.count("*").alias("n")).collect())
    # The plan as a table by length, with the lists of its runs; ranks find their run by the run starts that lie before.
    by: dict[int, list[tuple[int, int, int]]] = {}
    for n, first, _, at, offset in plan(count, capacity):
        by.setdefault(n, []).append((first, at, offset))
    rows = [(n, -(-count[n] // SLICE), [x[0] for x in r], [x[1] for x in r], [x[2] for x in r]) for n, r in by.items()]
    table = spark.createDataFrame(rows, "length long, slices long, firsts array<long>, bins array<long>, offsets array<long>")
    slices = F.broadcast(table.select("length", "slices"))  # both broadcasts: at most ``capacity`` rows
    ranked = pieces.join(slices, "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("slices"))).drop("slices")
    sums = ranked.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = ranked.withColumn("rank", within - 1).join(sums, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("base"))
    run = F.expr("size(filter(firsts, x -> x <= rank)) - 1")
    out = ranked.join(F.broadcast(table.drop("slices")), "length").withColumn("run", run)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("bins[run] + rank - firsts[run]").alias("sequence_id"), F.expr("offsets[run]").alias("offset"))
