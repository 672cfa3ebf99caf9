"""Grids to Markdown tables, and ordered assembly of blocks into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import _c, strip


def padded(rows) -> Column:
    """Rows filled up with empty cells to the longest."""
    width = F.coalesce(F.array_max(F.transform(_c(rows), lambda r: F.size(r))), F.lit(0))
    return F.transform(_c(rows), lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def non_blank(rows) -> Column:
    """Rows in which some cell isn't empty; a space or a zero counts as content. Null cells are empty."""
    filled = F.transform(_c(rows), lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit(""))))
    return F.filter(filled, lambda r: F.exists(r, lambda v: v != ""))


def without_repeats(row: Column) -> Column:
    """A row with each cell that equals the one before it emptied (what merged cells look like)."""
    return F.transform(row, lambda v, i: F.when((i > 0) & (v == F.get(row, i - 1)), "").otherwise(v))


def unmerged(rows) -> Column:
    return F.transform(_c(rows), without_repeats)


def one_line_cells(rows) -> Column:
    """Cells stripped, with line feeds turned into spaces."""
    return F.transform(_c(rows), lambda r: F.transform(r, lambda v: F.replace(strip(F.coalesce(v, F.lit(""))), F.lit("\n"), F.lit(" "))))


def markdown_table(rows) -> Column:
    """Header, rule and body, without line ends around them; cells aren't escaped. No rows give an empty text."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    r = _c(rows)
    rule = line(F.transform(r[0], lambda v: F.lit("---")))
    body = F.array_join(F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), line), "\n")
    return F.when(F.size(r) == 0, "").otherwise(F.concat(line(r[0]), F.lit("\n"), rule, F.lit("\n"), body))


def ordered_concat(rows: DataFrame, key: list[str], order: list[str], text: str = "text", by: str = "\n", to: str = "markdown") -> DataFrame:
    """key and the texts of each key's rows, joined in order; null texts are left out."""
    got = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    joined = F.array_join(F.transform(F.filter(got, lambda x: x["_t"].isNotNull()), lambda x: x["_t"]), by)
    return rows.groupBy(*key).agg(joined.alias(to))


def sheets_to_markdown(cells: DataFrame) -> DataFrame:
    """rel_path, markdown of a workbook's cells: a heading for each sheet, a table if it has a row that isn't blank."""
    rows = cells.where("row_no IS NOT NULL").groupBy("rel_path", "sheet_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "values"))).alias("r"))
    rows = rows.withColumn("r", padded(non_blank(F.transform("r", lambda x: x["values"]))))
    names = cells.select("rel_path", "sheet_no", "sheet").distinct()
    s = names.join(rows, ["rel_path", "sheet_no"], "left").withColumn("r", F.coalesce("r", F.array().cast("array<array<string>>")))
    head = F.concat(F.lit("\n## "), F.col("sheet"), F.lit("\n"))
    s = s.withColumn("text", F.when(F.size("r") == 0, head).otherwise(F.concat(head, F.lit("\n"), markdown_table("r"), F.lit("\n"))))
    return ordered_concat(s, ["rel_path"], ["sheet_no"])


def block_text() -> Column:
    """The Markdown of a block (kind, level, text, grid)."""
    kind, text = F.col("kind"), F.col("text")
    boxed = lambda inner: F.concat(F.lit("\n"), inner, F.lit("\n"))
    grid = F.coalesce(F.col("grid"), F.array().cast("array<array<string>>"))
    return (
        F.when(kind == "heading", F.when(F.col("level") <= 3, boxed(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))).otherwise(text))
        .when(kind == "table", F.when(F.size(grid) == 0, "").otherwise(boxed(F.concat(markdown_table(one_line_cells(grid)), F.lit("\n")))))
        .when(kind == "merged_table", F.when(F.size(grid) == 0, "").otherwise(boxed(F.concat(markdown_table(unmerged(one_line_cells(grid))), F.lit("\n")))))
        .when(kind == "notes", F.when(strip(text) != "", boxed(F.concat(F.lit("> **Notes:** "), strip(text)))))
        .when(kind == "slide", boxed(F.concat(F.lit("## Slide "), text)))
        .when(kind == "page", boxed(F.concat(F.lit("## Page "), text)))
        .when(kind == "image", boxed(F.concat(F.lit("![image]("), text, F.lit(")"))))
        .when(kind == "ocr", boxed(F.concat(F.lit("![ocr]("), text, F.lit(")"))))
        .when(text != "", text)
    )


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """rel_path, markdown: blocks in order, joined by line feeds; empty paragraphs are left out."""
    return ordered_concat(blocks.withColumn("text", block_text()), ["rel_path"], ["seq"])
