"""Dealing entries out by range as packed blobs: a row for each range and sender, whatever the number of entries.

An entry belongs to an owner (a document, with a few numbers of its own) and has a few numbers itself. A task sends, for each
range it has entries for, the owners' numbers, how many entries each has, and the entries' numbers. Ranges may be many more than
a task's entries: beyond FAN of them, entries go to groups of ranges first, and a second step deals each group to its ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.words import lean

#: Ranges that a task deals to at once; entries gathered in the second step.
FAN, FLUSH = 8192, 500_000


def schema(ids: dict[str, type], cols: dict[str, type]) -> str:
    return ", ".join(["part int", *(f"{x} binary" for x in (*ids, "counts", *cols, "fine"))])


def groups(ranges: int) -> int:
    """What a first step deals to: the ranges, or FAN groups of them. Worked out on the driver, for deal() on the executors."""
    return ranges if ranges <= FAN else FAN


def deal(ranges: int, fan: int, fine: np.ndarray, owner: np.ndarray, ids: dict[str, np.ndarray], cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Blobs of the entries by range, or by group of ranges (fine % fan) if there are more than fan. Each owner
    counts into ids; its entries of a range are kept together, in the order given. Only ranges with entries are visited."""
    whole = ranges <= fan
    part = fine if whole else fine % fan
    order = np.lexsort((owner, part))
    owner, part, fine = owner[order], part[order], fine[order].astype(np.int32)
    cols = {k: v[order] for k, v in cols.items()}
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
    rows: dict[str, list] = {x: [] for x in ("part", *ids, "counts", *cols, "fine")}
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
        heads = lo + np.flatnonzero(np.append(True, owner[lo + 1 : hi] != owner[lo : hi - 1]))
        rows["part"].append(int(part[lo]))
        for k, v in ids.items():
            rows[k].append(v[owner[heads]].tobytes())
        rows["counts"].append(np.diff(np.append(heads, hi)).astype(np.int32).tobytes())
        for k, v in cols.items():
            rows[k].append(v[lo:hi].tobytes())
        rows["fine"].append(None if whole else fine[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in rows.items()], list(rows))


def joined(table, name: str, kind) -> np.ndarray:
    """A column of blobs as one array."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def by_range(blobs: DataFrame, ranges: int, ids: dict[str, type], cols: dict[str, type]) -> DataFrame:
    """The blobs that deal() made for that many ranges, by single range."""
    if ranges <= FAN:
        return blobs

    def again(batches):
        lean()
        held, total, group = [], 0, None

        def send():
            table = pa.table({k: pa.array([x[k] for x in held], pa.binary()) for k in (*ids, "counts", *cols, "fine")})
            who = {k: joined(table, k, t) for k, t in ids.items()}
            owner = np.repeat(np.arange(len(next(iter(who.values())))), joined(table, "counts", np.int32))
            return deal(ranges, ranges, joined(table, "fine", np.int32).astype(np.int64), owner, who, {k: joined(table, k, t) for k, t in cols.items()})

        for b in batches:
            for x in b.to_pylist():
                if held and (x["part"] != group or total >= FLUSH):
                    yield send()
                    held, total = [], 0
                group = x["part"]
                held.append(x)
                total += len(x["fine"]) // 4
        if held:
            yield send()

    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(again, schema(ids, cols))
