"""Chunking at section borders, and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import CHUNK_START
from lectern.functions.text import _c, strip


def _packed(parts: Column, most: int) -> Column:
    """Neighbouring texts joined while they stay within ``most``; a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > most) & (acc["cur"] != "")
        return F.when(full, F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), p.alias("cur"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], p).alias("cur")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))


def chunks(x, most: int) -> Column:
    """Texts of at most ``most`` characters, cut before level-2 headings where that will do and between lines elsewhere.

    A line longer than ``most`` stays whole. Chunks that had to be cut between lines end in a line feed.
    """
    sections = F.filter(F.split(_c(x), CHUNK_START, -1), lambda s: strip(s) != "")
    by_line = lambda c: _packed(F.transform(F.split(c, "\n", -1), lambda line: F.concat(line, F.lit("\n"))), most)
    return F.flatten(F.transform(_packed(sections, most), lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(by_line(c))))


def context_window(rows: DataFrame, key: str, order: str, text: str = "text", reach: int = 2, most: int = 300) -> DataFrame:
    """rows with context: the texts around a row that aren't blank, joined by spaces, cut to ``most`` characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    near = F.filter(F.transform(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w), lambda t: strip(t)), lambda t: t != "")
    return rows.withColumn("context", F.substring(F.array_join(near, " "), 1, most))
