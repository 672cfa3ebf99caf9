"""Mathematical spans, their regions on a page, and markers for them in the page's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import MATH_FONTS, NOT_MATH
from lectern.functions.text import _c, strip

#: Share of mathematical characters; gaps of a region in heights and page widths; least width; shares of line and page.
RATIO, Y_GAP, X_GAP, MIN_WIDTH, OF_LINE, OF_PAGE = 0.3, 1.5, 0.3, 10.0, 0.7, 0.3
PADDING = 4.0


def math_chars(x) -> Column:
    return F.length(F.regexp_replace(_c(x), NOT_MATH, "")).cast("long")


def is_math(text, font=None) -> Column:
    """By font name, by share of mathematical characters, or a lone sign. Blank text is none."""
    t = _c(text)
    by_chars = (math_chars(t).cast("double") / F.length(t) > F.lit(RATIO)) | ((F.length(strip(t)) <= 2) & (math_chars(t) >= 1))
    if font is not None:
        name = F.lower(F.coalesce(_c(font), F.lit("")))
        by_font = F.lit(False)
        for part in MATH_FONTS:
            by_font = by_font | name.contains(part)
        by_chars = by_chars | by_font
    return F.coalesce((strip(t) != "") & by_chars, F.lit(False))


_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
_REGION = f"struct<box: {_BOX}, line: {_BOX}>"


def _union(a: str, b: str) -> str:
    return f"named_struct('x0', least({a}.x0, {b}.x0), 'y0', least({a}.y0, {b}.y0), 'x1', greatest({a}.x1, {b}.x1), 'y1', greatest({a}.y1, {b}.y1))"


def merged_regions(spans: str, page_width: str) -> Column:
    """Regions of an array of spans (y0, x0, seq, box, line): a fold in reading order that grows the last region.

    The height that bounds the gap is the grown region's, so no comparison of neighbours alone can express it.
    """
    near = f"s.box.y0 - acc.cur.box.y1 < (acc.cur.box.y1 - acc.cur.box.y0) * {Y_GAP}D AND s.box.x0 - acc.cur.box.x1 < {page_width} * {X_GAP}D"
    grown = f"named_struct('box', {_union('acc.cur.box', 's.box')}, 'line', {_union('acc.cur.line', 's.line')})"
    fresh = "named_struct('box', s.box, 'line', s.line)"
    fold = f"""aggregate(array_sort({spans}), named_struct('done', cast(array() AS array<{_REGION}>), 'cur', cast(null AS {_REGION})),
      (acc, s) -> CASE WHEN acc.cur IS NULL THEN named_struct('done', acc.done, 'cur', {fresh})
        WHEN {near} THEN named_struct('done', acc.done, 'cur', {grown})
        ELSE named_struct('done', array_append(acc.done, acc.cur), 'cur', {fresh}) END,
      acc -> CASE WHEN acc.cur IS NULL THEN acc.done ELSE array_append(acc.done, acc.cur) END)"""
    return F.expr(f"filter({fold}, r -> r.box.x1 - r.box.x0 > {MIN_WIDTH}D)")


def is_inline(width: Column, line_width: Column, page_width: Column) -> Column:
    """Wide against its line: on its own. Else narrow against the page: inline."""
    return F.when((line_width > 0) & (width / line_width > OF_LINE), F.lit(False)).when(width / page_width < OF_PAGE, F.lit(True)).otherwise(F.lit(False))


def regions(spans: DataFrame) -> DataFrame:
    """rel_path, page, formula_idx, bbox, is_inline of the mathematical regions of text spans.

    A page's spans meet in one array; a page bounds their number.
    """
    math = spans.where("block_type = 0").where(is_math("text", "font"))
    arr = F.collect_list(F.struct(F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "seq", F.col("bbox").alias("box"), F.col("line_bbox").alias("line")))
    pages = math.groupBy("rel_path", "page").agg(arr.alias("spans"), F.max("page_width").alias("page_width"))
    rows = pages.select("rel_path", "page", "page_width", F.posexplode(merged_regions("spans", "page_width")).alias("pos", "r"))
    idx = F.row_number().over(Window.partitionBy("rel_path").orderBy("page", "pos")) - 1
    width = F.col("r.box.x1") - F.col("r.box.x0")
    inline = is_inline(width, F.col("r.line.x1") - F.col("r.line.x0"), F.col("page_width"))
    return rows.select("rel_path", "page", idx.cast("long").alias("formula_idx"), F.col("r.box").alias("bbox"), inline.alias("is_inline"))


def clip_box(bbox: str, page_width: str, page_height: str) -> Column:
    """The region widened by PADDING within its page; null if it has no extent of at least a point."""
    b = f"named_struct('x0', greatest(0D, {bbox}.x0 - {PADDING}D), 'y0', greatest(0D, {bbox}.y0 - {PADDING}D), 'x1', least({page_width}, {bbox}.x1 + {PADDING}D), 'y1', least({page_height}, {bbox}.y1 + {PADDING}D))"
    return F.expr(f"transform(array({b}), b -> CASE WHEN b.x1 - b.x0 >= 1 AND b.y1 - b.y0 >= 1 THEN b END)[0]")


def line_at(y_center, page_height, n_lines) -> Column:
    """The line a height on the page falls on, by proportion."""
    at = (_c(y_center) / _c(page_height) * _c(n_lines)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(_c(n_lines).cast("long") - 1, at))


def insert_markers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages (rel_path, page, text, height) with a marker for each region: inline ones at the end of their line, the others
    on lines of their own after it, the later region first."""
    lines = pages.select("rel_path", "page", F.split("text", "\n", -1).alias("l"), "height")
    spots = found.join(lines.select("rel_path", "page", "height", F.size("l").alias("n")), ["rel_path", "page"])
    spots = spots.select("rel_path", "page", "formula_idx", "is_inline", line_at((F.col("bbox.y0") + F.col("bbox.y1")) / 2, "height", "n").alias("line"))
    marker = F.concat(F.lit("<<FORMULA:"), F.col("formula_idx").cast("string"), F.lit(">>"))
    extra = spots.select("rel_path", "page", "line", (~F.col("is_inline")).cast("int").alias("own"), F.when(F.col("is_inline"), F.col("formula_idx")).otherwise(-F.col("formula_idx")).alias("o"), F.when(F.col("is_inline"), F.concat(F.lit(" "), marker)).otherwise(F.concat(F.lit("\n"), marker)).alias("t"))
    base = lines.select("rel_path", "page", F.posexplode("l").alias("line", "t"))
    base = base.select("rel_path", "page", F.col("line").cast("long").alias("line"), F.lit(-1).alias("own"), F.lit(0).cast("long").alias("o"), F.concat(F.when(F.col("line") > 0, "\n").otherwise(""), "t").alias("t"))
    rows = base.unionByName(extra)
    got = F.array_sort(F.collect_list(F.struct("line", "own", "o", "t")))
    return rows.groupBy("rel_path", "page").agg(F.array_join(F.transform(got, lambda x: x["t"]), "").alias("text"))


#: Height of the buckets in which spans and regions of a page meet, and how many a page has at most.
BUCKET, BUCKETS = 48.0, 10_000


def _buckets(lo: Column, hi: Column) -> Column:
    """The buckets that a stretch of a page touches; null if an end is."""
    at = lambda y: F.least(F.greatest(F.floor(y / BUCKET), F.lit(0)), F.lit(BUCKETS)).cast("int")
    return F.when(lo.isNotNull() & hi.isNotNull(), F.sequence(F.least(at(lo), at(hi)), F.greatest(at(lo), at(hi))))


def region_context(found: DataFrame, spans: DataFrame, reach: float = 2.0, most: int = 300) -> DataFrame:
    """found with context: the page's text within ``reach`` heights above and below a region, in reading order, cut to
    ``most`` characters.

    Spans and regions meet by buckets of height that they touch, so a page's spans aren't held against all of its regions; a
    pair that shares several buckets meets in the first of them. A region goes with its columns, also where nothing meets it,
    so found is worked out once. formula_idx is unique within a file.
    """
    key = ["rel_path", "page", "formula_idx"]
    rest = [c for c in found.columns if c not in key]
    height = F.col("bbox.y1") - F.col("bbox.y0")
    r = found.select(*key, F.struct(*rest).alias("_f"), F.greatest(F.lit(0.0), F.col("bbox.y0") - reach * height).alias("_lo"), (F.col("bbox.y1") + reach * height).alias("_hi"))
    s = spans.where("block_type = 0").select(F.col("rel_path").alias("_path"), F.col("page").alias("_page"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), F.col("bbox.x0").alias("x0"), "seq", "text")
    r = r.withColumn("_b", _buckets(F.col("_lo"), F.col("_hi"))).select("*", F.array_min("_b").alias("_r"), F.explode_outer("_b").alias("_bucket")).drop("_b")
    s = s.withColumn("_b", _buckets(F.col("y0"), F.col("y1"))).select("*", F.array_min("_b").alias("_s"), F.explode("_b").alias("_at")).drop("_b")
    same = (F.col("rel_path") == F.col("_path")) & (F.col("page") == F.col("_page")) & (F.col("_bucket") == F.col("_at"))
    near = r.join(s, same & (F.col("_bucket") == F.greatest("_r", "_s")) & (F.col("y1") > F.col("_lo")) & (F.col("y0") < F.col("_hi")), "left")
    got = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("y0", "x0", "seq", "text"))))
    texts = near.groupBy(*key).agg(F.first("_f").alias("_f"), F.array_join(F.transform(got, lambda x: x["text"]), " ").alias("context"))
    return texts.select("rel_path", "formula_idx", *[c if c in key else F.col("_f")[c].alias(c) for c in found.columns if c not in ("rel_path", "formula_idx")], F.substring(strip("context"), 1, most).alias("context"))
