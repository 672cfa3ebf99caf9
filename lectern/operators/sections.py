"""Sections, lines and the content filter.

``compat`` follows the historic rules to the letter; without it, title slides are slide 1 alone and lines that Markdown
itself repeats (formula fences, code fences, table rules) are never taken for page furniture.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import SECTION_HEAD, SECTION_START
from lectern.functions.text import _c, count_words, let, strip, without_images

TITLE_WORDS, REPEATS, SHORT = 20, 3, 100
#: Lines that repeat by nature.
FURNITURE = r"\A(?:\$\$|```.*|\|(?: *:?-{3,}:? *\|)+)\z"


def split_sections(x) -> Column:
    """The text cut before each level-2 heading line; what precedes the first heading is a section of its own."""
    return F.filter(F.split(_c(x), SECTION_START, -1), lambda s: s != "")


def header_of(section: Column) -> Column:
    """The heading line of a section, "" for the part before the first heading."""
    return F.regexp_extract(section, SECTION_HEAD, 1)


def sections(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """docs without its text, with section_no (from 0), header and body: one row for each section."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.posexplode(split_sections(text)).alias("section_no", "_s"))
    head = header_of(F.col("_s"))
    return rows.select(*rest, F.col("section_no").cast("long").alias("section_no"), head.alias("header"), F.expr("substring(_s, length(regexp_extract(_s, r'" + SECTION_HEAD + "', 1)) + 1)").alias("body"))


def is_title_slide(fmt: Column, header: Column, body: Column, compat: bool = False) -> Column:
    """A slide 1 with under 20 words besides images. compat: any header that contains "Slide 1"."""
    first = header.contains("Slide 1") if compat else header.rlike(r"\bSlide 1\b")
    return (fmt == "pptx") & (header != "") & first & (count_words(without_images(body)) < TITLE_WORDS)


def is_image_only(header: Column, body: Column) -> Column:
    """A section with an image reference and nothing else."""
    return (header != "") & (strip(without_images(body)) == "") & body.contains("![image]")


def kept_sections(x, fmt: Column, compat: bool = False) -> Column:
    """The text without title slides and image-only sections, as one expression. Without slides and images it is as it was."""

    def dropped(s: Column) -> Column:
        head = header_of(s)
        body = F.substr(s, F.length(head) + 1)
        return is_title_slide(fmt, head, body, compat) | is_image_only(head, body)

    may = F.coalesce(fmt == "pptx", F.lit(False)) | _c(x).contains("![image]")
    return F.when(may, F.array_join(F.filter(split_sections(x), lambda s: ~F.coalesce(dropped(s), F.lit(False))), "")).otherwise(_c(x))


def countable(stripped: Column, compat: bool = False) -> Column:
    """Whether a stripped line is looked at as page furniture."""
    ok = (stripped != "") & ~stripped.startswith("#") & ~stripped.startswith("!")
    furniture = (stripped.startswith("$$") | stripped.startswith("```") | stripped.startswith("|")) & stripped.rlike(FURNITURE)
    return ok if compat else ok & ~furniture


def repeated(x, compat: bool = False) -> Column:
    """The distinct stripped lines, under 100 characters, that a text has three times or more: sorted runs, no nested loop."""
    stripped = F.filter(F.transform(F.split(_c(x), "\n", -1), lambda line: strip(line)), lambda s: (F.length(s) < SHORT) & countable(s, compat))
    # In a sorted array a value stands REPEATS times if the value REPEATS - 1 places further on equals it.
    runs = lambda a: F.array_distinct(F.filter(a, lambda s, i: F.coalesce(F.get(a, i + (REPEATS - 1)) == s, F.lit(False))))
    return F.transform(F.array(F.array_sort(stripped)), runs)[0]


def without_repeated(x, compat: bool = False) -> Column:
    """The text without the lines that repeat: lines sorted by what they say, marked by their neighbours, put back in order."""

    def rows(line: Column, i: Column) -> Column:
        return let(strip(line), lambda s: F.struct(F.when((F.length(s) < SHORT) & countable(s, compat), s).alias("says"), i.alias("at"), line.alias("line")))

    def marked(a: Column) -> Column:
        # A line is one of REPEATS alike if it begins, ends or lies within a run of that length.
        alike = lambda s, i, k: F.coalesce(F.get(a, i + k)["says"] == F.get(a, i + (k + REPEATS - 1))["says"], F.lit(False)) & F.coalesce(F.get(a, i + k)["says"] == s["says"], F.lit(False))
        gone = lambda s, i: reduce(lambda p, q: p | q, [alike(s, i, -k) for k in range(REPEATS)])
        return F.transform(a, lambda s, i: F.struct(s["at"].alias("at"), s["line"].alias("line"), gone(s, i).alias("gone")))

    kept = lambda a: F.array_join(F.transform(F.filter(F.array_sort(a), lambda s: ~s["gone"]), lambda s: s["line"]), "\n")
    cut = kept(let(F.array_sort(F.transform(F.split(_c(x), "\n", -1), rows)), marked))
    return F.when(F.size(repeated(x, compat)) == 0, _c(x)).otherwise(cut)


def filter_content(docs: DataFrame, text: str = "markdown", fmt: str = "format", compat: bool = False) -> DataFrame:
    """docs with title slides, image-only sections and repeated lines taken out of its text."""
    return docs.withColumn(text, kept_sections(text, F.col(fmt), compat)).withColumn(text, without_repeated(text, compat))


def removals(docs: DataFrame, key: str, text: str = "markdown", fmt: str = "format", compat: bool = False) -> DataFrame:
    """key, rule, detail: what filter_content takes out."""
    s = sections(docs.select(key, fmt, text), text)
    titles = s.where(is_title_slide(F.col(fmt), F.col("header"), F.col("body"), compat)).select(key, F.lit("title_slide").alias("rule"), strip("header").alias("detail"))
    images = s.where(is_image_only(F.col("header"), F.col("body")) & ~is_title_slide(F.col(fmt), F.col("header"), F.col("body"), compat)).select(key, F.lit("image_only").alias("rule"), strip("header").alias("detail"))
    lines = docs.select(key, F.explode(repeated(kept_sections(text, F.col(fmt), compat), compat)).alias("line")).select(key, F.lit("repeated_line").alias("rule"), F.substring("line", 1, 50).alias("detail"))
    return titles.unionByName(images).unionByName(lines)


def repeated_lines(docs: DataFrame, key: str, text: str = "markdown", compat: bool = False) -> DataFrame:
    """key, line, n by relation: grouped counts, so a text's length doesn't bound the work of one expression."""
    rows = docs.select(key, F.explode(F.split(text, "\n", -1)).alias("line")).select(key, strip("line").alias("line"))
    rows = rows.where(countable(F.col("line"), compat) & (F.length("line") < SHORT))
    return rows.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)
