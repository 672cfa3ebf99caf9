"""Incremental state: which files are pending, what was done last, and where outputs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import path_parts, with_suffix
from lectern.operators import order
from lectern.shared import keep


def pending(files: DataFrame, progress: DataFrame) -> DataFrame:
    """Files without a progress row of the same path and modification time."""
    return files.join(progress.select("rel_path", "mtime"), ["rel_path", "mtime"], "left_anti")


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The last row of each key by the given columns, in one pass with partial aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_l")).select(*key, "_l.*")


def upsert(progress: DataFrame, done: DataFrame) -> DataFrame:
    """The progress table with the rows of done put in place of those of the same path."""
    return progress.join(done.select("rel_path"), "rel_path", "left_anti").unionByName(done.select(*progress.columns))


def outputs(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """files with out_path, collision (others map to it) and wins (the last of them by path order is the one written)."""
    out = files.withColumn("out_path", with_suffix(path, ".md"))
    same = Window.partitionBy("out_path")
    last = F.row_number().over(same.orderBy(path_parts(path).desc())) == 1
    return out.withColumn("wins", last).withColumn("collision", F.count("*").over(same) > 1)


def format_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("format").agg(F.count("*").alias("files"))


def run_counts(files: DataFrame) -> DataFrame:
    """discovered, pending, processed, failed, skipped of a run's files by status."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    return files.agg(F.count("*").alias("discovered"), n("processed", "failed").alias("pending"), n("processed").alias("processed"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def path_rank(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """files with place: how many files come before it in path order, plus 1; equal paths share a place, a null path has none."""
    paths = files.where(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("_n")).withColumn("_parts", path_parts(path))
    ranked = order.before(paths, ["_parts"], F.col("_n"), "_before")
    return files.join(ranked.select(path, (F.col("_before") + 1).alias("place")), path, "left")


#: Names of colliding outputs that are broadcast; more of them are joined otherwise.
FEW = 500_000


def winners(docs: DataFrame, path: str = "rel_path", then: list[Column] | None = None) -> DataFrame:
    """docs with out_path, one row for each: of those that map to one output the last by path order, then by the given columns.

    Only names are grouped to find which outputs collide; rows of all others are neither shuffled nor sorted. Rows without a
    path have no output and are left out.
    """
    out = docs.where(F.col(path).isNotNull()).withColumn("out_path", with_suffix(path, ".md"))
    twice = keep(out.groupBy("out_path").agg(F.count("*").alias("_n")).where("_n > 1").select("out_path"))
    n = twice.count()
    if not n:
        return out
    names = F.broadcast(twice) if n <= FEW else twice
    last = Window.partitionBy("out_path").orderBy(path_parts(path).desc(), *[c.desc() for c in then or []])
    decided = out.join(names, "out_path", "left_semi").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    return out.join(names, "out_path", "left_anti").unionByName(decided)
