"""N-gram Jaccard join: blocked products of the sparse document-by-shingle incidence matrix.

1. Each text becomes its set of distinct five-word shingles (64-bit names) and a fingerprint of that set. Texts with one
   set are one row of the matrix from here on.
2. The matrix is dealt out by columns (hash ranges of shingles, in two steps if they are many). A range tells, for each
   document, which of its shingles occur in another document of a fitting size, and in how many, and deals that back by
   document. A document with fewer than 3/4 of its shingles so shared has no partner: its overlap with anything stays below
   the bound that its size sets. Shingles that a bounded hashed sample of the texts shows to be very frequent don't meet in
   their range: they count as shared, and as the most frequent ones, which loses no pair and keeps ranges small. On this way a
   shingle goes by its range and 32 bits; two that fall together are both kept and only look shared, and step 4 tells them apart.
3. Of the documents left, the rarest n - ceil(3n/4) + 1 shingles must meet a partner's. Shingles that meet span candidate
   components; nothing is emitted per pair.
4. In each candidate component the product of incidence blocks (128 documents a side) accumulates overlap counts; pairs
   below 100 * overlap >= 75 * union are dropped, and of the others only a spanning forest leaves the task. In large
   components the blocks on the diagonal come first, each with the same few pivots; then only pairs of blocks whose
   documents aren't already linked to one another and, where that makes fewer, that have one of those rarest shingles in common.
5. Links make components; copies of a set get the component of the set.

Null text, empty text and text of white space: an empty set, linked with nothing. Texts under five words: the whole word
sequence is the one shingle. Repeated rows stay repeated. A row without doc_id keeps its set's component, but where all
rows of a set are without one, the set is not compared with others. Ties in size or frequency fall back on the shingle's name.
Names are 64-bit hashes: two different shingles of one size class share one with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.dealing import by_range, deal, groups, joined, schema
from lectern.llm.runtime import keep, likely, only, parts_for, small_batches, width
from lectern.llm.words import U, as_bytes, grams, hashes, lean, mix, prefix, split_words

SHINGLE = 5
#: Overlap bound as 100 * intersection >= PER_CENT * union.
PER_CENT = 75
#: Shingles in one range of columns, shingles gathered before a map task sends blobs, documents on a side of a block.
RANGE, FLUSH, BLOCK = 2_000_000, 500_000, 128
#: Sets that a map task remembers to have sent.
SEEN = 500_000
#: Shingles in the sample for frequent ones: one in SHARE, within these bounds; sets of it that make a shingle frequent.
SHARE, LEAST_SAMPLE, MOST_SAMPLE, FREQUENT = 32, 2_000_000, 64_000_000, 32
#: What stands for the number of sets with a frequent shingle.
MANY = 0xFFFFFFFF
_IDS = {"fps": np.int64, "sizes": np.int32}
_NAMES, _FOUND = {"names": np.uint32}, {"names": U, "dfs": np.uint32}
CHUNK = 4096
#: Names of a block that are looked at together.
PASS = 2_000_000


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle names of a text."""
    words = split_words(text.lower() if text else text)  # bytes.lower() touches A-Z alone
    n = len(words)
    if not n:
        return np.empty(0, U)
    size = min(k, n)
    return np.unique(grams(prefix(hashes(words)), np.arange(n - size + 1), size) + U(size))


def fingerprint(names: np.ndarray) -> int:
    """A name for a set: a signed 64-bit hash of its sorted elements."""
    return int(mix(grams(prefix(names), np.array([0]), len(names)) + U(len(names))).astype(np.int64)[0])


def _sets(batches):
    lean()
    for b in batches:
        got = [shingles(t) for t in as_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in got], pa.int64()), pa.array([fingerprint(x) if len(x) else None for x in got], pa.int64())],
            ["doc_id", "n_shingles", "fp"],
        )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (null for an empty set) of every row."""
    return only(docs, "doc_id", "text").mapInArrow(_sets, "doc_id long, n_shingles long, fp long")


def frequent_shingles(docs: DataFrame, total: int) -> np.ndarray:
    """Names of shingles that FREQUENT or more sets of a hashed sample have, sorted; there are at most MOST_SAMPLE / FREQUENT."""
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, total // SHARE))

    def sets(batches):
        lean()
        for b in batches:
            got = {fingerprint(x): x for x in map(shingles, as_bytes(b.column("text"))) if len(x)}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["fp", "names"])

    def count(batches):
        lean()
        held, total = [], 0

        def send():
            names, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n)], ["name", "n"])

        for b in batches:
            for x in b.column("names").to_pylist():
                held.append(np.frombuffer(x, U))
                total += len(held[-1])
                if total >= FLUSH:
                    yield send()
                    held, total = [], 0
        if held:
            yield send()

    if total <= LEAST_SAMPLE:  # any range holds all of a shingle's entries with ease
        return np.empty(0, U)
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, size / total) * (1 << 30)))
    once = picked.mapInArrow(sets, "fp long, names binary").groupBy("fp").agg(F.first("names").alias("names"))
    names = once.select("names").mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([x for (x,) in names.select("name").collect()], np.int64).astype(U))  # bounded by the sample


def _columns(parts: int, frequent):
    """Map side of step 2: blobs of (set, its shingles in a range); copies that the task has sent count once. Frequent
    shingles go to ranges of their sets, numbered from ``parts`` on."""
    fan, seen_most, flush = groups(2 * parts), SEEN, FLUSH

    def blobs(held: list[np.ndarray], fps: list[int], hot: np.ndarray):
        n = np.array([len(x) for x in held])
        names, owner, ids = np.concatenate(held), np.repeat(np.arange(len(held)), n), np.array(fps, np.int64)
        fine = ((names >> U(32)) % U(parts)).astype(np.int64)
        short = names.astype(np.uint32)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            known = hot[place] == names
            fine[known], short[known] = parts + ids[owner[known]] % parts, place[known]
        return deal(2 * parts, fan, fine, owner, {"fps": ids, "sizes": n.astype(np.int32)}, {"names": short})

    def run(batches):
        lean()
        hot = frequent.value
        held, fps, seen, total = [], [], set(), 0
        for b in batches:
            for t in as_bytes(b.column("text")):
                names = shingles(t)
                if len(names) and (fp := fingerprint(names)) not in seen:
                    if len(seen) >= seen_most:
                        seen.clear()
                    seen.add(fp)
                    held.append(names)
                    fps.append(fp)
                    total += len(names)
                    if total >= flush:
                        yield blobs(held, fps, hot)
                        held, fps, total = [], [], 0
        if held:
            yield blobs(held, fps, hot)

    return run


def _shared(parts: int):
    """Reduce side of step 2, for one range: its shingles that another set of a fitting size also has, dealt to ranges of sets."""
    fan = groups(parts)

    def run(table: pa.Table) -> pa.Table:
        lean()
        fps, sizes, counts, names = joined(table, "fps", np.int64), joined(table, "sizes", np.int32), joined(table, "counts", np.int32), joined(table, "names", np.uint32)
        part = table.column("part")[0].as_py()
        if part >= parts:  # frequent shingles, by their place among them
            part = (1 << 31) - 1
            owner, df = np.repeat(np.arange(len(fps)), counts), np.full(len(names), MANY, np.uint32)
        else:
            order = np.lexsort((fps, sizes))
            order = order[np.append(True, fps[order][1:] != fps[order][:-1])]  # copies from other tasks go
            begins = (np.cumsum(counts) - counts)[order]
            fps, sizes, counts = fps[order], sizes[order], counts[order]
            ends = np.cumsum(counts)
            names = names[np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1])]
            owner = np.repeat(np.arange(len(fps)), counts)
            order = np.argsort(names, kind="stable")  # stays by size within a name: the nearest sizes are neighbours
            names, owner = names[order], owner[order]
            same = names[1:] == names[:-1]
            near = same & (100 * sizes[owner[:-1]].astype(np.int64) >= PER_CENT * sizes[owner[1:]].astype(np.int64))
            hit = np.append(False, near) | np.append(near, False)
            group = np.append(0, np.cumsum(~same))
            df = np.minimum(np.bincount(group), MANY - 1)[group][hit].astype(np.uint32)
            names, owner = names[hit], owner[hit]
        names = names.astype(U) | U(part << 32)
        return pa.Table.from_batches([deal(parts, fan, fps[owner] % parts, owner, {"fps": fps, "sizes": sizes}, {"names": names, "dfs": df})])

    return run


def _prefixes(table: pa.Table) -> pa.Table:
    """Step 3, for one range of sets: of each that may have a partner, the shared shingles among its rarest n - ceil(3n/4) + 1."""
    lean()
    fps, sizes, counts, names, df = joined(table, "fps", np.int64), joined(table, "sizes", np.int32).astype(np.int64), joined(table, "counts", np.int32), joined(table, "names", U), joined(table, "dfs", np.uint32)
    fps, at, which = np.unique(fps, return_index=True, return_inverse=True)
    n = sizes[at]
    owner = np.repeat(which, counts)
    hot = np.flatnonzero(df == MANY)  # copies of a set in several tasks sent these more than once
    if len(hot):
        order = hot[np.lexsort((names[hot], owner[hot]))]
        again = np.append(False, (names[order][1:] == names[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
        stay = np.ones(len(names), bool)
        stay[order[again]] = False
        names, df, owner = names[stay], df[stay], owner[stay]
    have = np.bincount(owner, minlength=len(n))
    alive = (100 * have >= PER_CENT * n)[owner]
    names, df, owner = names[alive], df[alive], owner[alive]
    order = np.lexsort((names, df, owner))
    names, owner = names[order], owner[order]
    begins = np.searchsorted(owner, np.arange(len(n)))
    first = n - -(-PER_CENT * n // 100) + 1 - (n - have)
    take = np.arange(len(owner)) - begins[owner] < first[owner]
    return pa.table([pa.array(fps[owner[take]]), pa.array(names[take].astype(np.int64))], names=["fp", "name"])


def _spanning(n: int, pairs, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The pairs that join what is not yet joined; equal labels count as joined."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels.tolist()):
            up[i] = first.setdefault(x, i)
    out = []
    for i, j in pairs:
        x, y = top(i), top(j)
        if x != y:
            up[y] = x
            out.append((i, j))
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many names any two of the sorted sets have in common: ranges of names one after the other, so that what is worked
    out beside the sets is bounded, whatever their size."""
    total = sum(map(len, sets))
    passes = max(1, -(-total // PASS))
    bounds = np.array([(k << 64) // passes for k in range(1, passes)], U)
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]) for s in sets]
    overlap = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(passes):
        held = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in held])
        _, column, df = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        met = df[column] > 1
        doc, column = doc[met], column[met]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
            i, j = np.searchsorted(column, (lo, lo + CHUNK))
            block = np.zeros((len(sets), CHUNK), np.float32)
            block[doc[i:j], column[i:j] - lo] = 1
            overlap += (block @ block.T).astype(np.int64)  # up to CHUNK, so the product is exact
    return overlap


def _product(table: pa.Table) -> pa.Table:
    """Step 4 for one group of documents: overlap counts of all of them, and the links that span them."""
    lean()
    fps = np.array(table.column("fp").to_pylist(), np.int64)
    fps, at = np.unique(fps, return_index=True)
    label = np.array(table.column("label").to_pylist(), np.int64)[at]
    names = table.column("names")
    sets = [np.frombuffer(names[int(i)].as_buffer(), U) for i in at]  # where they lie, not copied
    n = np.array([len(x) for x in sets])
    overlap = _overlaps(sets)
    near = (100 * overlap >= PER_CENT * (n[:, None] + n[None, :] - overlap)) & (label[:, None] != label[None, :])
    links = _spanning(len(sets), zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))), label)
    return pa.table([pa.array([fps[i] for i, _ in links], pa.int64()), pa.array([fps[j] for _, j in links], pa.int64())], names=["a", "b"])


def _named_sets(batches):
    lean()
    for b in batches:
        got = [shingles(t) for t in as_bytes(b.column("text"))]
        own = pa.array([len(x) > 0 and fingerprint(x) == fp for x, fp in zip(got, b.column("fp").to_pylist())], pa.bool_())  # other rows of the doc_id
        yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("cand"), pa.array([x.tobytes() for x in got], pa.binary())], ["fp", "cand", "names"]).filter(own)


def _products(members: DataFrame, met: DataFrame) -> DataFrame:
    """Links between the sets of each candidate component; members: fp, cand, names; met: fp, name of their rarest shingles."""
    size = keep(members.groupBy("cand").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))  # at most a row for each BLOCK
    members = members.join(size, "cand", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("label", F.col("fp"))
    spread = F.pmod(F.xxhash64("fp"), F.ceil(F.col("m") / BLOCK))
    plain = members.withColumn("block", F.when(F.col("m") > BLOCK, spread).otherwise(F.lit(0)))
    large = members.where(F.col("m") > BLOCK)
    columns = ["fp", "label", "names"]
    pivots = large.groupBy("cand", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(16)).alias("slot")).agg(F.min("fp").alias("fp"), F.first("m").alias("m"))
    pivots = pivots.join(members.select("fp", "names"), "fp").withColumn("label", F.col("fp"))
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK) - 1)))
    first = plain.select("cand", "block", *columns).unionByName(pivots.select("cand", "block", *columns))
    first = keep(first.groupBy("cand", "block").applyInArrow(_product, "a long, b long"))
    if large.isEmpty():
        return first
    # Second round: blocks of one label, and blocks that hold several small labels; pairs of blocks with one label are done.
    known = components(first).select(F.col("node").alias("fp"), F.col("comp").alias("known"))
    large = large.drop("label").join(known, "fp", "left").withColumn("label", F.coalesce("known", "fp")).drop("known")
    held = keep(large.groupBy("cand", "label").agg(F.count("*").alias("held")))
    large = large.join(held, ["cand", "label"])
    big = F.col("held") > BLOCK // 2
    small = keep(large.where(~big).groupBy("cand").agg(F.count("*").alias("small")))
    large = large.join(small, "cand", "left")
    large = keep(
        large.select(
            "cand", *columns,
            F.when(big, F.col("label")).alias("of"),
            F.when(big, F.pmod(F.xxhash64("fp"), F.ceil(F.col("held") / BLOCK))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / BLOCK))).alias("no"),
        )
    )
    blocks = large.select("cand", "fp", F.coalesce(F.col("of").cast("string"), F.lit("")).alias("of"), "no")
    held = keep(met.join(blocks, "fp").groupBy("cand", "name", "of", "no").agg(F.lit(1).alias("one")).drop("one"))
    blocks = keep(blocks.select("cand", "of", "no").distinct())
    # Pairs of blocks with a shingle in common, if they are fewer than all pairs.
    dense = blocks.groupBy("cand").agg((F.count("*") * F.count("*")).alias("every"))
    sparse = held.groupBy("cand", "name").agg(F.count("*").alias("b")).groupBy("cand").agg(F.sum(F.col("b") * F.col("b")).alias("some"))
    few = keep(dense.join(sparse, "cand", "left").select("cand", F.coalesce(F.col("some") < F.col("every"), F.lit(True)).alias("few")))
    one = lambda x: F.struct(F.col(f"{x}.of").alias("of"), F.col(f"{x}.no").alias("no"))
    pair = [F.col("x.cand").alias("cand"), one("x").alias("p"), one("y").alias("q")]
    every = blocks.join(few.where("NOT few"), "cand")
    shared = held.join(few.where("few"), "cand")
    todo = every.alias("x").join(every.alias("y"), F.col("x.cand") == F.col("y.cand")).select(*pair)
    todo = todo.unionByName(shared.alias("x").join(shared.alias("y"), (F.col("x.cand") == F.col("y.cand")) & (F.col("x.name") == F.col("y.name"))).select(*pair))
    order = (F.col("p.of") < F.col("q.of")) | ((F.col("p.of") == F.col("q.of")) & (F.col("p.no") <= F.col("q.no")))
    todo = todo.where(order & ((F.col("p.of") != F.col("q.of")) | (F.col("p.of") == ""))).distinct()
    todo = todo.select("cand", F.col("p.of").alias("o1"), F.col("p.no").alias("n1"), F.col("q.of").alias("o2"), F.col("q.no").alias("n2"))
    todo = todo.select("cand", F.xxhash64("cand", "o1", "n1", "o2", "n2").alias("pair"), F.explode(F.array_distinct(F.array(F.struct(F.col("o1").alias("of"), F.col("n1").alias("no")), F.struct(F.col("o2").alias("of"), F.col("n2").alias("no"))))).alias("s"))
    todo = todo.select("cand", "pair", F.col("s.of").alias("of"), F.col("s.no").alias("no"))
    rows = large.withColumn("of", F.coalesce(F.col("of").cast("string"), F.lit(""))).join(todo, ["cand", "of", "no"])
    second = keep(rows.select("cand", "pair", *columns).groupBy("cand", "pair").applyInArrow(_product, "a long, b long"))
    return first.unionByName(second)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of 100 * intersection >= 75 * union."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text")
    sets = keep(shingle_sets(docs))
    reps = keep(sets.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n")))
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    parts = parts_for(total, RANGE)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, total))
    blobs = by_range(docs.mapInArrow(_columns(parts, frequent), schema(_IDS, _NAMES)), 2 * parts, _IDS, _NAMES)
    found = by_range(blobs.groupBy("part").applyInArrow(_shared(parts), schema(_IDS, _FOUND)), parts, _IDS, _FOUND)
    met = keep(found.groupBy("part").applyInArrow(_prefixes, "fp long, name long"))
    head = keep(met.groupBy("name").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1"))
    star = met.join(head, "name").select("fp", "head").where("fp <> head").distinct()
    cand = components(star, "fp", "head").select(F.col("node").alias("fp"), F.col("comp").alias("cand"))
    # Sets of candidates only, each from the text of its first document.
    chosen = keep(cand.join(reps.select("fp", F.col("first").alias("doc_id")), "fp"))
    members = keep(likely(docs, "doc_id", chosen).join(chosen, "doc_id").select("fp", "cand", "text").repartition(width(spark), "fp").mapInArrow(_named_sets, "fp long, cand long, names binary"))
    first = reps.select("fp", "first")
    linked = keep(components(_products(members, met)).select(F.col("node").alias("fp"), "comp").join(first, "fp"))
    smallest = keep(linked.groupBy("comp").agg(F.min("first").alias("component_id")))
    linked = linked.join(smallest, "comp").select("fp", "component_id")
    named = keep(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return sets.join(named, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

