"""The prefix trie of conversations: sorted turn arrays, longest common prefixes of neighbours, a stack sweep, stitched stacks.

1. A turn is known by NAME bytes of the SHA-256 of its role and text, and by its number of words. The packed names of a
   conversation's turns sort as the turn arrays do, a prefix before what goes on after it. Texts are read once, in the scan;
   what is shuffled is some 40 bytes a turn.
2. (names, conv_id) are dealt out by range, so the copies of a hot conversation, or all that begin with a hot turn, spread
   over as many ranges as they fill, and sorted within each.
3. A task sweeps its stretch with a stack of the open nodes, those that the last conversation begins with. The next one's
   common prefix with it tells which nodes close and which open. A closed node knows its subtree's sums; its row leaves
   when its parent closes, as the parent's smallest member is known then.
4. Nodes on the path of a stretch's first or last conversation may go on in a neighbour. They leave as one row a task, the
   open stack; their closed children leave with the parent's name instead of its conv_id. One more sweep over the stacks,
   in order of the stretches, merges them. It reads a row a stretch, whatever the number of conversations.
5. Ids of members that end at an open node leave as text in chunks of a bounded size; a digest of many chunks is fed them in
   order, a chunk at a time.

Like a text, one conversation is one record: a task must hold its packed names (24 bytes a turn with the words, so 10 million
turns take 240 MB), never more of them than one Arrow batch.

Null role or text is the empty one, rows without conv_id belong to no conversation and are left out, turns of one number
are ordered by their names, and repeated rows are turns as often as they stand. Empty tables give no rows, since a node has
members. Further columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.runtime import keep, only, width, with_few
from lectern.llm.words import lean

#: Bytes of a turn's name. Two different turns of 10^12 share one with a chance of some 10^-15.
NAME = 16
#: Every conversation starts with turns of the one whose number is the next multiple of BLOCK below.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that a range holds, about; rows of an output batch; characters of ids in a chunk.
STRETCH, ROWS, CHUNK = 100_000, 2_000, 1 << 20
#: Conversations of an input batch, whose packed turns are held at once.
BATCH = 1_000

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"kind string, {_NODES}, name binary, stretch int, chunk long, ids string, first binary, last binary, open array<long>"
_COLUMNS = [x.split()[0] for x in _NODES.split(", ")]
_NOBODY = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of name and words): the turns of each conversation in order. Rows with the same
    conv_id - conv_id % BLOCK are in the same partition."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * NAME))
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", base("conv_id").alias("base"), F.struct("turn", name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("one"))
    held = rows.repartition(width(conversations.sparkSession), "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return held.select("base", "conv_id", F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["words"].alias("words"))).alias("turns"))


def base(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % BLOCK


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of the conversation at the block's start, then the own ones after the first h;
    h is crc32(conv_id) % HEADS. The blocks lie together already, so nothing is shuffled."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    # Of a block, one row has a head of HEADS - 1 turns at most; the largest value passes over the nulls.
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy("base"))
    none = F.slice("turns", 1, 0)
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return turns.withColumn("h", h).withColumn("head", head).select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), own).alias("turns"))


def _packed(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["name"])), "")).alias("names"), F.transform("turns", lambda x: x["words"]).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two packed arrays begin with alike."""
    n = min(len(a), len(b)) // NAME
    if a[: n * NAME] == b[: n * NAME]:
        return n
    k = 0
    while a[k * NAME : (k + 1) * NAME] == b[k * NAME : (k + 1) * NAME]:
        k += 1
    return k


def path_names(packed: bytes) -> list[bytes]:
    """A name for each prefix, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()]
    for k in range(0, len(packed), NAME):
        h.update(packed[k : k + NAME])
        out.append(h.copy().digest())
    return out


class Node:
    """An open node: members that end here and below, and the sums over its closed subtrees."""

    __slots__ = ("children", "ends", "kids", "leaves", "least", "n", "saved", "words")

    def __init__(self, words: int):
        self.words, self.n, self.least, self.children, self.leaves, self.saved = words, 0, _NOBODY, 0, 0, 0
        self.ends: list[str] = []
        self.kids: list[tuple] = []  # rows of closed children, without their parent's conv_id

    def sums(self) -> list[int]:
        return [self.words, self.n, self.least, self.children, self.leaves, self.saved]

    def merge(self, other: list[int]) -> None:
        _, n, least, children, leaves, saved = other
        self.n, self.least = self.n + n, min(self.least, least)
        self.children, self.leaves, self.saved = self.children + children, self.leaves + leaves, self.saved + saved


def close(stack: list[Node]) -> Node:
    """Take the deepest node, complete by now, off the stack and count it into its parent."""
    node = stack.pop()
    node.leaves += not node.children
    node.saved += (node.n - 1) * node.words
    if stack:
        stack[-1].merge([0, node.n, node.least, 1, node.leaves, node.saved])
    return node


def sweep(rows, stretch: int):
    """Rows of a sorted stretch of (names, words, conv_id): closed nodes, chunks of ids at open ones, and the open stack."""
    stack: list[Node] = []
    first = last = None
    left: list[list[int]] = []  # sums of the nodes on the first one's path, by depth, as they close on the right
    edge = 0  # depth down to which the stack lies on the first one's path
    names: list[bytes] = []  # of the first one's path

    def chunks(name: bytes, ids: list[str]):
        held, size, k = [], 0, 0
        for x in ids:
            held.append(x)
            size += len(x) + 1
            if size >= CHUNK:
                yield dict(kind="ids", name=name, stretch=stretch, chunk=k, ids=",".join(held))
                held, size, k = [], 0, k + 1
        if held:
            yield dict(kind="ids", name=name, stretch=stretch, chunk=k, ids=",".join(held))

    def opened(node: Node, name: bytes):
        for kid in node.kids:
            yield dict(kind="node", name=name, **dict(zip(_COLUMNS, kid)))
        yield from chunks(name, node.ends)

    def pop():
        nonlocal edge
        depth = len(stack) - 1
        if depth <= edge:  # it may have begun in a stretch before
            node = stack.pop()
            edge = depth - 1
            left[depth] = node.sums()
            yield from opened(node, names[depth])
            return
        node = close(stack)
        for kid in node.kids:
            yield dict(kind="node", **dict(zip(_COLUMNS, (*kid[:2], node.least, *kid[3:]))))
        ends = hashlib.sha256(",".join(node.ends).encode()).hexdigest() if node.ends else _EMPTY
        stack[-1].kids.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, ends))

    for packed, words, conv in rows:
        if first is None:
            first = last = packed
            names = path_names(first)
            edge = len(names) - 1
            left = [[] for _ in names]
            stack = [Node(0), *(Node(w) for w in words)]
        else:
            depth = common(last, packed)
            while len(stack) > depth + 1:
                yield from pop()
            stack += [Node(w) for w in words[depth:]]
            last = packed
        node = stack[-1]
        node.n += 1
        node.least = min(node.least, conv)
        node.ends.append(str(conv))
    if first is None:
        return
    right = path_names(last)
    sums = []
    for depth, node in enumerate(stack):
        yield from opened(node, right[depth])
        if depth <= edge:
            left[depth] = node.sums()
        else:
            sums.append(node.sums())
    yield dict(kind="open", stretch=stretch, first=first, last=last, open=[x for s in (*left, *sums) for x in s])


def stitch(stacks):
    """The nodes that were open at an end of some stretch, from the open stacks in order: (names, row)."""
    stack: list[Node] = []
    path = b""
    names: list[bytes] = []

    def pop():
        depth = len(stack) - 1
        node = close(stack)
        for name, kid in node.kids:
            yield name, (*kid[:2], node.least, *kid[3:])
        row = (node.least, depth, None, node.n, node.children, node.leaves, node.saved)
        if stack:
            stack[-1].kids.append((names[depth], row))
        else:
            yield names[0], row

    for first, last, flat in stacks:
        sums = [flat[k : k + 6] for k in range(0, len(flat), 6)]
        size = len(first) // NAME + 1
        shared = common(first, last)
        for packed, own in ((first, sums[:size]), (last, [None] * (shared + 1) + sums[size:])):
            depth = common(path, packed) if stack else -1
            while len(stack) > depth + 1:
                yield from pop()
            path, names = packed, path_names(packed)
            for k, s in enumerate(own):
                if k == len(stack):
                    stack.append(Node(s[0]))
                if s:
                    stack[k].merge(s)
    while stack:
        yield from pop()


def _batches(rows, schema: pa.Schema):
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("ids") or "")
        if len(held) >= ROWS or size >= 4 * CHUNK:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _swept(batches):
    lean()

    def rows():
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                yield from zip(part.column("names").to_pylist(), part.column("words").to_pylist(), part.column("conv_id").to_pylist())

    yield from _batches(sweep(rows(), TaskContext.get().partitionId()), _arrow(_SWEPT))


_STITCHED = ", ".join(["name binary", *_NODES.split(", ")[:-1]])


def _stitched(batches):
    stacks = ((x["first"], x["last"], x["open"]) for b in batches for x in b.select(["first", "last", "open"]).to_pylist())
    yield from _batches((dict(zip(("name", *_COLUMNS), (name, *row))) for name, row in stitch(stacks)), _arrow(_STITCHED))


def _digests(batches):
    """One digest a name, of chunks that come sorted by name, stretch and chunk."""

    def rows():
        name, digest = None, None
        for b in batches:
            for x, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist()):
                if x == name:
                    digest.update(b"," + ids.encode())
                    continue
                if name is not None:
                    yield {"name": name, "digest": digest.hexdigest()}
                name, digest = x, hashlib.sha256(ids.encode())
        if name is not None:
            yield {"name": name, "digest": digest.hexdigest()}

    yield from _batches(rows(), _arrow("name binary, digest string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns): conv_id and depth, which tell where to read a node's turns,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A row of turns is a member."""
    spark = turns.sparkSession
    packed = keep(_packed(only(turns, "conv_id", "turns")))
    stretches = max(width(spark), -(-packed.count() // STRETCH))
    dealt = packed.repartitionByRange(stretches, "names", "conv_id").sortWithinPartitions("names", "conv_id")
    swept = keep(dealt.mapInArrow(_swept, _SWEPT))
    # A row a stretch.
    stacks = swept.where("kind = 'open'").select("stretch", "first", "last", "open").repartition(1).sortWithinPartitions("stretch")
    opened = keep(stacks.mapInArrow(_stitched, _STITCHED))
    chunks = swept.where("kind = 'ids'").select("name", "stretch", "chunk", "ids").repartition(width(spark), "name").sortWithinPartitions("name", "stretch", "chunk")
    digests = chunks.select("name", "ids").mapInArrow(_digests, "name binary, digest string")
    open_nodes = opened.join(digests, "name", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_EMPTY))).select(*_COLUMNS)
    nodes = swept.where("kind = 'node'")
    whole = nodes.where("name IS NULL").select(*_COLUMNS)
    # A parent at an end of a stretch: two paths a stretch.
    parents = opened.select("name", F.col("conv_id").alias("parent"))
    edge = with_few(nodes.where("name IS NOT NULL").drop("parent_conv_id"), "name", parents).withColumnRenamed("parent", "parent_conv_id").select(*_COLUMNS)
    return whole.unionByName(edge).unionByName(open_nodes)
