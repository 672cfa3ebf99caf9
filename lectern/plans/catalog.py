"""The catalogue of a body of texts as tables: pages (cleaned and linted Markdown), what the index says of each, and the index.

Everything is written by Spark's writers, partitioned by group (the first folder of a path), to any file system that Spark
can write to. Groups of any size are written by as many tasks as they need.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import count_tokens, headings, path_parts, stem, title, top_group
from lectern.operators import lint, order, progress, sections

#: What the index says of a page.
ENTRY = "path string, title string, headings array<string>, word_count long, fixed_count long, remaining long, digest string"
PAGES = f"{ENTRY}, markdown string, group string"


def pages(docs: DataFrame, compat: bool = False) -> DataFrame:
    """Schema PAGES, a row for each output of docs (rel_path, format, markdown): filtered, linted and described.

    digest is that of the text as it came, so an unchanged text is known without its page being made. Of rows with one output
    the last by path wins, then by digest. Rows with a null path or text are no documents and are left out; an empty text is
    a page of one line feed.
    """
    docs = docs.where("markdown IS NOT NULL").withColumn("digest", F.md5("markdown"))
    final = lint.lint(sections.filter_content(progress.winners(docs, then=[F.col("digest")]), compat=compat), compat=compat)
    path = F.col("out_path")
    return final.select(
        path.alias("path"), title("markdown", stem(path)).alias("title"), headings("markdown").alias("headings"), count_tokens("markdown").alias("word_count"),
        "fixed_count", F.size("remaining_failures").cast("long").alias("remaining"), "digest", "markdown", top_group(path).alias("group"),
    )


def write(rows: DataFrame, path: str, *by: str, fmt: str = "parquet", whole: bool = False) -> None:
    """rows into partitions of a table, each written anew; whole: the partitions that rows have no part in go. Small ones are
    written by one task, large ones by several."""
    mode = "static" if whole else "dynamic"
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).format(fmt).save(path)


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table of the catalogue; an empty one if there is none yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(entries: DataFrame) -> DataFrame:
    """entries with place, from 1, in path order over all groups."""
    return order.before(entries, [path_parts("path")], to="_n").withColumn("place", F.col("_n") + 1).drop("_n")


def write_index(entries: DataFrame, path: str) -> None:
    """The index as text: in each group's folder a heading and a line for each entry, in path order over its files.

    A group may fill several files, whose names sort as their lines do.
    """
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")"))
    lines = entries.select("group", F.lit(1).alias("_k"), path_parts("path").alias("_p"), link.alias("value"))
    heads = entries.select("group").distinct().select("group", F.lit(0).alias("_k"), F.array().cast("array<string>").alias("_p"), F.concat(F.lit("## "), F.col("group"), F.lit("\n")).alias("value"))
    rows = order.spread(lines.unionByName(heads), ["group", "_k", "_p"]).select("group", "value")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("group").text(path)


def summary(entries: DataFrame) -> DataFrame:
    """group, pages, words, fixed, remaining."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return entries.groupBy("group").agg(F.count("*").alias("pages"), total("word_count").alias("words"), total("fixed_count").alias("fixed"), total("remaining").alias("remaining"))


def changed(arrived: DataFrame, log: DataFrame, batch: int) -> DataFrame:
    """The rows of arrived (rel_path, markdown, ...) whose text differs from the newest one of the batches before, if there is
    one; log is the table of pages with group and batch. Texts aren't read from it, and only groups that something arrived in."""
    rows = arrived.withColumn("_out", progress.with_suffix("rel_path", ".md")).withColumn("_digest", F.md5("markdown"))
    groups = rows.select(top_group("_out").alias("group")).distinct()
    old = log.where(F.col("batch") < batch).join(groups, "group", "left_semi")
    newest = old.groupBy("path").agg(F.max_by("digest", "batch").alias("_had"))
    same = (F.col("_out") == F.col("path")) & (F.col("_digest") == F.col("_had"))
    return rows.join(newest, same, "left_anti").drop("_out", "_digest")


def current(log: DataFrame, groups: DataFrame) -> DataFrame:
    """The newest entry of each path of the given groups, and how many versions there have been."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    rows = log.join(groups, "group", "left_semi")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("group", *names[1:]), "batch").alias("_e"), F.count("*").alias("versions"))
    return newest.select("path", *[f"_e.{x}" for x in names[1:]], "versions", "_e.group")
