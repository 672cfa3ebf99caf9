"""Index and manifest of the outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import count_tokens, file_name, headings, path_parts, stem, title, top_group


def manifest(outputs: DataFrame, path: str = "path", text: str = "markdown") -> DataFrame:
    """path, title, group, headings, word_count of every output that isn't an index."""
    rows = outputs.where(file_name(path) != "index.md")
    return rows.select(F.col(path).alias("path"), title(text, stem(path)).alias("title"), top_group(path).alias("group"), headings(text).alias("headings"), count_tokens(text).alias("word_count"))


def _groups(entries: DataFrame) -> DataFrame:
    """group, lines, n of each group: its links in path order and their number. A group's links are all that is gathered."""
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")"))
    got = F.array_sort(F.collect_list(F.struct(path_parts("path").alias("p"), link.alias("l"))))
    return entries.groupBy("group").agg(F.array_join(F.transform(got, lambda x: x["l"]), "\n").alias("lines"), F.count("*").alias("n"))


def index_lines(entries: DataFrame) -> DataFrame:
    """group, lines: each group's list of links, in path order."""
    return _groups(entries).select("group", "lines")


def index_text(entries: DataFrame, heading: str = "Knowledge Index") -> DataFrame:
    """One row with the whole index; none if there is nothing to list.

    Items already end in line feeds before they are joined by one, so headings stand apart by two.
    """
    part = lambda x: F.concat(F.lit("\n## "), x["group"], F.lit("\n\n"), x["lines"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "lines"))), part), "\n")
    whole = _groups(entries).agg(F.sum("n").alias("n"), body.alias("body")).where("n > 0")
    return whole.select(F.concat(F.lit(f"# {heading}\n\n**"), F.col("n").cast("string"), F.lit(" documents extracted**\n\n"), F.col("body")).alias("text"))


#: The order of the index's lines and of the manifest's.
INDEX_ORDER, MANIFEST_ORDER = ["_head", "_group", "_kind", "_parts"], ["_kind", "_parts"]


def index_rows(entries: DataFrame, n: int, heading: str = "Knowledge Index") -> DataFrame:
    """value and the columns of INDEX_ORDER: the lines of the index of n entries, in no order. No group is gathered."""
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, head: int, group, kind: int, parts, value) -> DataFrame:
        return df.select(F.lit(head).alias("_head"), group.alias("_group"), F.lit(kind).alias("_kind"), parts.alias("_parts"), value.alias("value"))

    top = entries.sparkSession.range(1)
    links = rows(entries, 1, F.col("group"), 1, path_parts("path"), F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")")))
    groups = rows(entries.select("group").distinct(), 1, F.col("group"), 0, none, F.concat(F.lit("\n## "), F.col("group"), F.lit("\n")))
    return rows(top, 0, F.lit(""), 0, none, F.lit(f"# {heading}\n\n**{n} documents extracted**\n")).unionByName(groups).unionByName(links)


def manifest_rows(entries: DataFrame) -> DataFrame:
    """value and the columns of MANIFEST_ORDER: the lines of a JSON array of the entries."""
    none = F.array().cast("array<string>")
    first = entries.agg(F.min(path_parts("path"))).head()[0]
    one = F.to_json(F.struct("path", "title", "group", "headings", "word_count"), {"ignoreNullFields": "false"})
    comma = F.when(F.col("path") == "/".join(first or []), F.lit("  ")).otherwise(F.lit(", "))
    body = entries.select(F.lit(1).alias("_kind"), path_parts("path").alias("_parts"), F.concat(comma, one).alias("value"))
    ends = entries.sparkSession.createDataFrame([(0, "["), (2, "]")], "_kind int, value string").select("_kind", none.alias("_parts"), "value")
    return ends.unionByName(body)
