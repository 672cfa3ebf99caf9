"""Registered queries: each operator over whole driver tables, beside the SQL that must give the same rows.

The tables hold plain prose, so headings, markers, grids and boxes are made from their columns by expressions that mean
the same in both engines. Nothing is filtered away to make a query cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.patterns import LINE_END, MATH_RANGES, MATH_SIGNS, WS
from lectern.operators import assets, chunks, formulas, index, lint, markers, metrics, model, order, progress, sections, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: What the compared engine needs instead of Java's flags and anchors.
def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources and state ----------------------------------------------------------------------------------------------------

_ENDING = "CASE page_id % 9 WHEN 0 THEN 'docx' WHEN 1 THEN 'PPTX' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'pdf' WHEN 4 THEN 'JPG' WHEN 5 THEN 'jpeg' WHEN 6 THEN 'png' WHEN 7 THEN 'txt' ELSE 'Pdf' END"
_DIR = "CASE WHEN page_id % 10 = 0 THEN '.git/' ELSE '' END"
_TREE = f"concat('tree/', {_DIR}, 'd', cast(length(html) % 7 AS varchar(9)), '/p', cast(length(url) % 40 AS varchar(9)), '.', {_ENDING})"
_FORMAT_SQL = "CASE lower(regexp_extract(rel_path, '[.][^.]+$')) WHEN '.docx' THEN 'docx' WHEN '.pptx' THEN 'pptx' WHEN '.xlsx' THEN 'xlsx' WHEN '.pdf' THEN 'pdf' WHEN '.jpg' THEN 'image' WHEN '.jpeg' THEN 'image' WHEN '.png' THEN 'image' END"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.expr(_TREE).alias("rel_path"))
    files = files.withColumn("format", T.format_of("rel_path"))
    return files.where(F.col("format").isNotNull() & ~F.arrays_overlap(T.path_parts("rel_path"), F.array(*map(F.lit, T.SKIPPED_DIRS))))


_TREE_SQL = f"(SELECT page_id, rel_path, {_FORMAT_SQL} AS format FROM (SELECT page_id, {_TREE} AS rel_path FROM pages) WHERE format IS NOT NULL AND NOT list_contains(string_split(rel_path, '/'), '.git'))"


@query(f"SELECT page_id, rel_path, format, rank() OVER (ORDER BY string_split(rel_path, '/')) AS place FROM {_TREE_SQL}")
def discover_files(spark, sf_dir):
    """Files of known formats outside skipped directories, and their place in path order (a report over all files)."""
    return progress.path_rank(_tree(spark, sf_dir)).select("page_id", "rel_path", "format", "place")


@query(f"SELECT format, count(*) AS files FROM {_TREE_SQL} GROUP BY format")
def discover_formats(spark, sf_dir):
    return progress.format_counts(_tree(spark, sf_dir))


_DONE = ("concat('o/', cast(o_orderkey AS varchar(20))) AS rel_path", "o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS mtime")


@query(f"""WITH files AS (SELECT concat('o/', cast(o_orderkey AS varchar)) AS rel_path, o_totalprice AS mtime FROM orders),
done AS (SELECT {', '.join(_DONE)} FROM orders WHERE o_orderstatus = 'F')
SELECT rel_path, mtime FROM files f WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.rel_path = f.rel_path AND d.mtime = f.mtime)""")
def pending_anti_join(spark, sf_dir):
    """Orders as files; those with status F were done, the urgent ones at another time."""
    orders = table(spark, sf_dir, "orders")
    files = orders.selectExpr("concat('o/', cast(o_orderkey AS varchar(20))) AS rel_path", "o_totalprice AS mtime")
    done = orders.where("o_orderstatus = 'F'").selectExpr(*_DONE)
    return progress.pending(files, done)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def progress_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return progress.latest(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT concat('o/', cast(o_orderkey AS varchar)) AS rel_path, o_totalprice AS mtime, o_orderstatus AS output FROM orders WHERE o_orderstatus <> 'O'),
d AS (SELECT concat('o/', cast(o_orderkey AS varchar)) AS rel_path, o_totalprice + 1 AS mtime, 'new' AS output FROM orders WHERE o_orderpriority < '3')
SELECT * FROM d UNION ALL SELECT * FROM p WHERE rel_path NOT IN (SELECT rel_path FROM d)""")
def progress_upsert(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), "concat('o/', cast(o_orderkey AS varchar(20))) AS rel_path"
    old = orders.where("o_orderstatus <> 'O'").selectExpr(path, "o_totalprice AS mtime", "o_orderstatus AS output")
    return progress.upsert(old, orders.where("o_orderpriority < '3'").selectExpr(path, "o_totalprice + 1 AS mtime", "'new' AS output"))


@query(f"""WITH f AS (SELECT DISTINCT rel_path FROM {_TREE_SQL}), o AS (SELECT rel_path, regexp_replace(rel_path, '[.][^.]+$', '.md') AS out_path FROM f)
SELECT rel_path, out_path, count(*) OVER (PARTITION BY out_path) > 1 AS collision, row_number() OVER (PARTITION BY out_path ORDER BY string_split(rel_path, '/') DESC) = 1 AS wins FROM o""")
def output_collision_last_wins(spark, sf_dir):
    return progress.outputs(_tree(spark, sf_dir).select("rel_path").distinct()).select("rel_path", "out_path", "collision", "wins")


@query("""SELECT count(*) AS discovered, count(*) FILTER (o_orderstatus <> 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS processed,
  count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped FROM orders""")
def run_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "failed").otherwise("skipped")
    return progress.run_counts(table(spark, sf_dir, "orders").select(status.alias("status")))


@query("""SELECT page_id, concat(replace(substr(s, 1, 40), ' ', '_'), '_', substr(md5(url), 1, 8)) AS dir, s AS stem, x AS suffix FROM (SELECT page_id, url,
  regexp_extract(n, '^.+([.][^.]+)$', 1) AS x, CASE WHEN x = '' THEN n ELSE regexp_extract(n, '^(.+)[.][^.]+$', 1) END AS s FROM (SELECT page_id, url, string_split(url, '/')[-1] AS n FROM pages))""")
def asset_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.asset_dir("url").alias("dir"), T.stem("url").alias("stem"), T.suffix("url").alias("suffix"))


@query("""WITH f AS (SELECT p_partkey, concat(lower(replace(p_name, ' ', '_')), CASE p_size % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.gif' WHEN 4 THEN '.bmp' WHEN 5 THEN '.tiff' WHEN 6 THEN '.webp' ELSE '' END) AS ref FROM part)
SELECT p_partkey, CASE lower(regexp_extract(ref, '[.]([^.]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' WHEN 'tiff' THEN 'image/tiff' ELSE 'image/png' END AS page_mime,
  CASE lower(regexp_extract(ref, '[.]([^.]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' ELSE 'image/png' END AS formula_mime FROM f""")
def media_types(spark, sf_dir):
    ending = "CASE p_size % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.gif' WHEN 4 THEN '.bmp' WHEN 5 THEN '.tiff' WHEN 6 THEN '.webp' ELSE '' END"
    ref = F.expr(f"concat(lower(replace(p_name, ' ', '_')), {ending})")
    return table(spark, sf_dir, "part").select("p_partkey", T.media_type(ref).alias("page_mime"), T.media_type(ref, T.FORMULA_MIME).alias("formula_mime"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS format, text FROM documents WHERE lang {c}" for f, c in (("docx", "= 'en'"), ("pptx", "= 'de'"), ("xlsx", "= 'fr'"), ("pdf", "= 'es'"), ("image", "NOT IN ('en', 'de', 'fr', 'es')"))))
def union_branches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = None
    for fmt, test in (("docx", "lang = 'en'"), ("pptx", "lang = 'de'"), ("xlsx", "lang = 'fr'"), ("pdf", "lang = 'es'"), ("image", "lang NOT IN ('en', 'de', 'fr', 'es')")):
        part = docs.where(test).select("doc_id", F.lit(fmt).alias("format"), "text")
        out = part if out is None else out.unionByName(part)
    return out


# Sections and filters -------------------------------------------------------------------------------------------------

_MD = "replace(text, '. ', concat('.', chr(10), '## T '))"
_CUT = "SELECT doc_id, {cols} unnest(range(len(p))) AS section_no, unnest(list_transform(range(1, len(p) + 1), lambda i: concat(CASE WHEN i > 1 THEN '## ' ELSE '' END, p[i], CASE WHEN i < len(p) THEN chr(10) ELSE '' END))) AS s FROM (SELECT *, string_split({md}, concat(chr(10), '## ')) AS p FROM documents)"


@query(f"""SELECT doc_id, section_no, regexp_extract(s, '^(## .+)', 1) AS header, substr(s, length(regexp_extract(s, '^(## .+)', 1)) + 1) AS body FROM ({_CUT.format(cols="", md=_MD)}) WHERE s <> ''""")
def section_split(spark, sf_dir):
    return sections.sections(table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD).alias("markdown")))


@query(r"""WITH s AS (SELECT source AS deck, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS slide, text FROM documents)
SELECT deck, slide, contains(concat('## Slide ', slide), 'Slide 1') AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 20 AS compat_drop, slide = 1 AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 20 AS strict_drop FROM s""")
def title_slide_filter(spark, sf_dir):
    """Each source as a deck, its documents as slides by length."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("deck"), n.cast("long").alias("slide"), "text")
    head = F.concat(F.lit("## Slide "), F.col("slide").cast("string"))
    drop = lambda compat: sections.is_title_slide(F.lit("pptx"), head, F.col("text"), compat)
    return s.select("deck", "slide", drop(True).alias("compat_drop"), drop(False).alias("strict_drop"))


_IMAGED = "CASE WHEN doc_id % 14 = 0 THEN concat(chr(10), '![image](a/b (1).png)', chr(160), chr(10), '![image](c.png)') WHEN doc_id % 14 = 2 THEN concat(chr(10), '![image](c.png) ', chr(10)) WHEN doc_id % 14 = 3 THEN '![ocr](p.png)' WHEN doc_id % 7 = 0 THEN concat(text, ' ![image](x.png)') ELSE text END"


@query(f"""SELECT doc_id, {_strip(r"regexp_replace(b, '!\[image\]\(.+?\)', '', 'g')")} = '' AND contains(b, '![image]') AS image_only FROM (SELECT doc_id, {_IMAGED} AS b FROM documents)""")
def image_only_sections(spark, sf_dir):
    body = F.expr(_IMAGED.replace("chr(160)", "decode(X'C2A0', 'UTF-8')"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("b")).select("doc_id", sections.is_image_only(F.lit("## x"), F.col("b")).alias("image_only"))


_SLIDES = "replace(text, '. ', concat('.', chr(10), '## Slide 1', chr(10)))"


def _line(text: str, rows: str) -> str:
    return f"(SELECT doc_id, n, line, {_strip('line')} AS t FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM {rows})))"


_COUNTED = "t <> '' AND t NOT LIKE '#%' AND t NOT LIKE '!%' AND length(t) < 100"


@query(rf"""WITH s AS MATERIALIZED (SELECT doc_id, section_no, s, regexp_extract(s, '^(## .+)', 1) AS head, substr(s, length(regexp_extract(s, '^(## .+)', 1)) + 1) AS body FROM ({_CUT.format(cols="", md=_SLIDES)}) WHERE s <> ''),
k AS (SELECT doc_id, coalesce(string_agg(s, '' ORDER BY section_no), '') AS md FROM s WHERE NOT (head <> '' AND len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+')) < 20) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(md, '') AS md FROM documents LEFT JOIN k USING (doc_id)),
l AS MATERIALIZED {_line("md", "d")},
r AS (SELECT doc_id, t FROM l WHERE {_COUNTED} GROUP BY doc_id, t HAVING count(*) >= 3),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS md FROM l ANTI JOIN r USING (doc_id, t) GROUP BY doc_id)
SELECT doc_id, coalesce(o.md, '') AS markdown FROM documents LEFT JOIN o USING (doc_id)""")
def content_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("pptx").alias("format"), F.expr(_SLIDES).alias("markdown"))
    return sections.filter_content(docs, compat=True).select("doc_id", "markdown")


@query(f"SELECT doc_id, t AS line, count(*) AS n FROM {_line('text', 'documents')} WHERE {_COUNTED} GROUP BY doc_id, t HAVING count(*) >= 3")
def repeated_lines(spark, sf_dir):
    return sections.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", compat=True)


@query(f"SELECT source, count(*) AS lines, sum(n)::bigint AS rows, max(n) AS most FROM (SELECT source, doc_id, t, count(*) AS n FROM {_line('text', 'documents')} JOIN documents USING (doc_id) WHERE {_COUNTED} GROUP BY source, doc_id, t HAVING count(*) >= 3) GROUP BY source")
def repeated_line_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sections.repeated_lines(docs.select("doc_id", "text"), "doc_id", "text", compat=True)
    return got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("lines"), F.sum("n").alias("rows"), F.max("n").alias("most"))


@query(f"""SELECT doc_id, 'repeated_line' AS rule, substr(t, 1, 50) AS detail FROM {_line("text", "documents")} WHERE {_COUNTED} GROUP BY doc_id, t HAVING count(*) >= 3""")
def removal_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("pdf").alias("format"), F.col("text").alias("markdown"))
    return sections.removals(docs, "doc_id", compat=True)


# Scalars --------------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words, len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')) AS tokens FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words("text").alias("words"), T.count_tokens("text").alias("tokens"))


_HEADED = "replace(text, '. ', concat('.', chr(10), '## '))"
_TITLED = f"CASE WHEN n_chars % 3 = 0 THEN concat('intro', chr(10), '# ', {_HEADED}) ELSE {_HEADED} END"


def _headings(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?m)^#{{1,3}}{WS}+(.+)$', 1)"




@query(f"SELECT doc_id, array_to_string(list_slice({_headings(_HEADED)}, 1, 20), chr(10)) AS headings FROM documents")
def headings_top20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.headings(F.expr(_HEADED)), "\n").alias("headings"))




def _lines(x: str) -> str:
    return rf"string_split_regex({x}, '{LINE_END}')"


def _title(x: str, otherwise: str) -> str:
    return f"coalesce({_strip(f"substr(list_filter(list_slice({_lines(x)}, 1, 20), lambda l: starts_with(l, '# '))[1], 3)")}, {otherwise})"




@query(f"SELECT doc_id, {_title('m', 'source')} AS title FROM (SELECT *, {_TITLED} AS m FROM documents)")
def title_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_TITLED).alias("m")).select("doc_id", T.title("m", "source").alias("title"))


_OUT_PATH = "CASE WHEN doc_id % 50 = 0 THEN concat('top', cast(doc_id AS varchar(20)), '.md') WHEN doc_id % 50 = 1 THEN concat(source, '/index.md') ELSE concat(source, '/', lang, '/d', cast(doc_id AS varchar(20)), '.md') END"
_OUTPUTS_SQL = f"(SELECT {_OUT_PATH} AS path, {_TITLED} AS m FROM documents)"
_MANIFEST_SQL = f"""SELECT path, {_title("m", "regexp_extract(string_split(path, '/')[-1], '^(.+)[.][^.]+$', 1)")} AS title, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'Root' END AS "group",
array_to_string(list_slice({_headings("m")}, 1, 20), chr(10)) AS headings, len(list_filter(string_split_regex(m, '{WS}+'), lambda w: w <> '')) AS word_count FROM {_OUTPUTS_SQL} WHERE string_split(path, '/')[-1] <> 'index.md'"""


def _outputs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(_OUT_PATH).alias("path"), F.expr(_TITLED).alias("markdown"))


@query(_MANIFEST_SQL)
def manifest(spark, sf_dir):
    """The flagship: which documents there are, in which group, with which title, headings and words."""
    return index.manifest(_outputs(spark, sf_dir)).withColumn("headings", F.array_join("headings", "\n"))


@query(f"""SELECT "group", string_agg(concat('- [', title, '](', path, ')'), chr(10) ORDER BY string_split(path, '/')) AS lines FROM ({_MANIFEST_SQL}) GROUP BY "group" """)
def index_lines(spark, sf_dir):
    return index.index_lines(index.manifest(_outputs(spark, sf_dir)))


@query(f"""WITH g AS (SELECT "group", count(*) AS n, string_agg(concat('- [', title, '](', path, ')'), chr(10) ORDER BY string_split(path, '/')) AS lines FROM ({_MANIFEST_SQL}) GROUP BY "group")
SELECT concat('# Knowledge Index', chr(10), chr(10), '**', sum(n)::bigint, ' documents extracted**', chr(10), chr(10), string_agg(concat(chr(10), '## ', "group", chr(10), chr(10), lines), chr(10) ORDER BY "group")) AS text FROM g""")
def index_text(spark, sf_dir):
    return index.index_text(index.manifest(_outputs(spark, sf_dir)))


@query(f"""WITH m AS MATERIALIZED ({_MANIFEST_SQL}), r AS (SELECT 0 AS head, '' AS g, 0 AS kind, []::varchar[] AS p, concat('# Knowledge Index', chr(10), chr(10), '**', count(*), ' documents extracted**', chr(10)) AS value FROM m
  UNION ALL SELECT DISTINCT 1, "group", 0, []::varchar[], concat(chr(10), '## ', "group", chr(10)) FROM m UNION ALL SELECT 1, "group", 1, string_split(path, '/'), concat('- [', title, '](', path, ')') FROM m)
SELECT value, coalesce(sum(octet_length(encode(value)) + 1) OVER (ORDER BY head, g, kind, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset_bytes FROM r""")
def index_places(spark, sf_dir):
    """The index as lines, each with the byte at which it stands: no group, and no index, in one row or one task."""
    entries = index.manifest(_outputs(spark, sf_dir))
    rows = index.index_rows(entries, entries.count())
    return order.before(rows, index.INDEX_ORDER, F.octet_length("value") + 1, "offset_bytes").select("value", "offset_bytes")


@query("""SELECT doc_id, concat('doc ', doc_id) AS a, CASE WHEN upper(t) IN ('BLANK_PAGE') THEN '' ELSE t END AS reply FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Blank_Page' ELSE source END AS t FROM documents)""")
def sentinel_replies(spark, sf_dir):
    raw = "CASE WHEN doc_id % 3 = 0 THEN concat(' Blank_Page', chr(10)) ELSE source END"
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(raw).alias("t"))
    return t.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("a"), F.when(T.is_sentinel("t", "BLANK_PAGE"), "").otherwise(T.strip("t")).alias("reply"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN concat('x_', p_size, chr(10), 'y') ELSE concat('x_', p_size) END AS latex FROM part""")
def reply_unwrap(spark, sf_dir):
    raw = "CASE p_size % 5 WHEN 0 THEN concat('$x_', p_size, '$') WHEN 1 THEN concat('```latex', chr(10), 'x_', p_size, chr(10), '```') WHEN 2 THEN concat('```', chr(10), '$$x_', p_size, chr(10), 'y$$') WHEN 3 THEN concat('  $$ x_', p_size, ' $$ ') ELSE concat('x_', p_size) END"
    return table(spark, sf_dir, "part").select("p_partkey", T.unwrap_reply(F.expr(raw)).alias("latex"))


# Lint -----------------------------------------------------------------------------------------------------------------

_DIRTY = "replace(text, '. ', concat('.', chr(9), ' ', chr(10), chr(10), chr(10), '#'))"
_FIXED_SQL = r"""concat(rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({0}, '(?m)[ \t]+$', '', 'g'), chr(9), '    '), '\n{{3,}}', concat(chr(10), chr(10)), 'g'),
 '(?m)^(#{{1,6}})([^ #\n])', '\1 \2', 'g'), '([^\n])\n(#{{1,6}} )', concat('\1', chr(10), chr(10), '\2'), 'g'), '(?m)^(#{{1,6}} .+)\n([^\n#])', concat('\1', chr(10), chr(10), '\2'), 'g'), chr(10)), chr(10))"""
_SPLIT_SQL = "(CASE WHEN {0}[-1] = '' THEN {0}[:-2] ELSE {0} END)"
_CHANGED_SQL = f"""SELECT doc_id, CASE WHEN m = f THEN 0 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)) END AS fixed_count FROM (
SELECT doc_id, m, f, {_SPLIT_SQL.format("x")} AS a, {_SPLIT_SQL.format("y")} AS b FROM (SELECT doc_id, m, f, {_lines("m")} AS x, {_lines("f")} AS y FROM (SELECT doc_id, {_DIRTY} AS m, {_FIXED_SQL.format(_DIRTY)} AS f FROM documents)))"""


@query(f"SELECT doc_id, {_FIXED_SQL.format(_DIRTY)} AS markdown FROM documents")
def fast_lint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lint.fixed(F.expr(_DIRTY)).alias("markdown"))


@query(_CHANGED_SQL)
def lint_fixed_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY).alias("markdown"))
    return lint.lint(docs).select("doc_id", "fixed_count")


#: Failures of each rule over the lines l of a text t.
_FOUND_SQL = {
    "md009": r"len(list_filter(l, lambda x: regexp_matches(x, '[ \t]+$')))",
    "md010": "len(list_filter(l, lambda x: contains(x, chr(9))))",
    "md012": "len(list_filter(range(2, len(l)), lambda i: l[i] = '' AND l[i - 1] = ''))",
    "md018": "len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}[^ #]')))",
    "md019": "len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}  ')))",
    "md022": "len(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{1,6} ') AND ((i > 1 AND l[i - 1] <> '') OR (i < len(l) AND l[i + 1] <> ''))))",
    "md023": "len(list_filter(l, lambda x: regexp_matches(x, '^ {1,3}#{1,6} ')))",
    "md047": "(CASE WHEN l[-1] = '' AND len(l) > 1 AND l[-2] <> '' THEN 0 ELSE 1 END)",
}


@query(f"""SELECT count(*) AS files, sum(fixed_count)::bigint AS fixed, sum({" + ".join(_FOUND_SQL.values())})::bigint AS remaining, count(*) FILTER (fixed_count > 0) AS files_with_fixes
FROM (SELECT doc_id, string_split({_FIXED_SQL.format(_DIRTY)}, chr(10)) AS l FROM documents) JOIN ({_CHANGED_SQL}) USING (doc_id)""")
def lint_totals(spark, sf_dir):
    return lint.lint_totals(lint.lint(table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY).alias("markdown"))))


@query(f"SELECT doc_id, {', '.join(f'{x} AS {rule}' for rule, x in _FOUND_SQL.items())} FROM (SELECT doc_id, string_split({_DIRTY}, chr(10)) AS l FROM documents)")
def lint_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", lint.failures(F.expr(_DIRTY)).alias("f"))
    n = lambda rule: F.size(F.filter("f", lambda x: x.startswith(rule + ":"))).cast("long").alias(rule.lower())
    return docs.select("doc_id", *[n(rule.upper()) for rule in _FOUND_SQL])


#: Every third sentence end opens a fence and the next closes it; what stands between is as dirty as the rest.
_FENCED = "array_to_string(list_transform(string_split(text, '. '), lambda s, i: concat(s, CASE i % 3 WHEN 1 THEN concat('.', chr(9), ' ', chr(10), chr(10), chr(10), '#') WHEN 2 THEN concat('. ', chr(10), '```py', chr(10), '#') ELSE concat(chr(9), chr(10), chr(10), chr(10), '```', chr(10)) END)), '')"
#: The same in Spark, whose arrays count from 0.
_FENCED_SPARK = _FENCED.replace("array_to_string(list_transform(string_split(text, '. '), lambda s, i: ", "array_join(transform(split(text, '[.] ', -1), (s, i) -> ").replace("i % 3", "(i + 1) % 3")
_MARK = "chr(57344)"
#: Pieces between fences: every second one is inside, and the last line of an open one goes on to the end.
_PIECES = f"(SELECT doc_id, t, p FROM (SELECT doc_id, t, string_split(t, '```') AS p FROM (SELECT doc_id, {_FENCED} AS t FROM documents)))"
_SKELETON = f"array_to_string(list_transform(p, lambda s, i: CASE WHEN i % 2 = 1 THEN s ELSE concat({_MARK}, CASE WHEN i = len(p) THEN regexp_extract(s, chr(10) || '*$') ELSE '' END) END), '')"
_BLOCKS = "list_transform(list_filter(range(1, len(p) + 1), lambda i: i % 2 = 0), lambda i: concat('```', CASE WHEN i = len(p) THEN regexp_replace(p[i], chr(10) || '*$', '') ELSE concat(p[i], '```') END))"


@query(f"""SELECT doc_id, array_to_string(list_transform(range(1, len(f) + 1), lambda i: concat(f[i], coalesce(b[i], ''))), '') AS markdown
FROM (SELECT doc_id, string_split({_FIXED_SQL.format(_SKELETON)}, {_MARK}) AS f, {_BLOCKS} AS b FROM {_PIECES})""")
def lint_outside_fences(spark, sf_dir):
    """Texts with fenced stretches, of which some are never closed: nothing in a fence changes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FENCED_SPARK).alias("markdown"))
    return lint.lint(docs).select("doc_id", "markdown")


# Tables and assembly --------------------------------------------------------------------------------------------------


@query("""SELECT concat('r', r_regionkey) AS rel_path, concat(chr(10), '## ', r_name, chr(10), chr(10), string_agg(l, chr(10) ORDER BY n), chr(10)) AS markdown FROM (
  SELECT n_regionkey AS r_regionkey, n_nationkey AS n, concat('| ', n_nationkey, ' | ', n_name, ' | ', CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE '' END, ' |') AS l FROM nation
  UNION ALL SELECT r, k + 0.5, '| --- | --- | --- |' FROM (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY n_regionkey)) JOIN region USING (r_regionkey) GROUP BY r_regionkey, r_name""")
def md_table_from_rows(spark, sf_dir):
    """Regions as workbooks of one sheet; odd nations have a cell less, and a blank row stands in between."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("rel_path"), F.lit(0).cast("long").alias("sheet_no"), F.col("r_name").alias("sheet"), "n_nationkey", "n_name")
    even = F.array(F.col("n_nationkey").cast("string"), "n_name", F.lit("even"))
    rows = base.select("rel_path", "sheet_no", "sheet", (2 * F.col("n_nationkey")).cast("long").alias("row_no"), F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(F.slice(even, 1, 2)).alias("values"))
    blank = base.select("rel_path", "sheet_no", "sheet", (2 * F.col("n_nationkey") + 1).cast("long").alias("row_no"), F.array(F.lit(""), F.lit(None).cast("string")).alias("values"))
    return tables.sheets_to_markdown(rows.unionByName(blank))


@query("""SELECT l_orderkey, string_agg(CASE WHEN p = l_returnflag THEN '' ELSE l_returnflag END, '|' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM (
  SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS p FROM lineitem) GROUP BY l_orderkey""")
def merged_cell_blanking(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_returnflag"]).alias("r"))
    return got.select("l_orderkey", F.array_join(tables.without_repeats(F.col("r")), "|").alias("flags"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    return tables.ordered_concat(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query("""SELECT conv_id::varchar AS rel_path, string_agg(CASE WHEN turn % 5 = 0 THEN concat(chr(10), repeat('#', (1 + turn % 3)::int), ' ', role, chr(10)) WHEN turn % 5 = 1 THEN concat(chr(10), '> **Notes:** ', trim(text, ' '), chr(10)) WHEN turn % 5 = 2 THEN concat(chr(10), '![image](i', turn, '.png)', chr(10)) ELSE text END, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def block_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.expr("CASE turn % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'notes' WHEN 2 THEN 'image' ELSE 'para' END")
    text = F.expr("CASE turn % 5 WHEN 0 THEN role WHEN 2 THEN concat('i', turn, '.png') ELSE text END")
    blocks = c.select(F.col("conv_id").cast("string").alias("rel_path"), F.col("turn").alias("seq"), kind.alias("kind"), (1 + F.col("turn") % 3).cast("int").alias("level"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("grid"))
    return tables.blocks_to_markdown(blocks)


# Windows, chunks and contexts -----------------------------------------------------------------------------------------


@query(f"""SELECT conv_id, turn, substr(coalesce(string_agg(CASE WHEN t = '' THEN NULL ELSE t END, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ''), 1, 300) AS context
FROM (SELECT conv_id, turn, {_strip("text")} AS t FROM conversations)""")
def context_window_pm2(spark, sf_dir):
    return chunks.context_window(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "context")


_MARKED = "concat(substr(text, 1, cast(floor(n_chars / 2) AS int)), '![image](m.png)', substr(text, cast(floor(n_chars / 2) AS int) + 1))"


@query(rf"""SELECT doc_id, {_strip("concat(substr(t, greatest(1, p - 200), p - greatest(1, p - 200)), substr(t, p + 15, 200))")} AS context FROM (SELECT doc_id, m AS t, strpos(m, '![image](m.png)') AS p FROM (SELECT doc_id, {_MARKED} AS m FROM documents))""")
def context_200_chars(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MARKED).alias("markdown"))
    return markers.context_around(docs, "doc_id", F.lit("![image](m.png)"))


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, n, concat(t, chr(10)) AS t FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 500 AND NOT starts_with(text, '## ')))),
f AS (SELECT doc_id, n, length(t) AS cur, 1 AS chunk FROM l WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, CASE WHEN f.cur + length(l.t) > 500 AND f.cur > 0 THEN length(l.t) ELSE f.cur + length(l.t) END, f.chunk + CASE WHEN f.cur + length(l.t) > 500 AND f.cur > 0 THEN 1 ELSE 0 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id, chunk - 1 AS chunk_no, string_agg(l.t, '' ORDER BY n) AS chunk FROM f JOIN l USING (doc_id, n) GROUP BY ALL
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 500 AND trim(text) <> ''""")
def greedy_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.chunks("text", 500)).alias("chunk_no", "chunk"))
    return docs.withColumn("chunk_no", F.col("chunk_no").cast("int"))


# Markers and replies --------------------------------------------------------------------------------------------------

_WITH_MARKS = "concat('a <<FORMULA:', doc_id % 5, '>> b <<FORMULA:1>> ', source)"


@query("""WITH d AS (SELECT doc_id, source, doc_id % 5 AS k FROM documents), f AS (SELECT p_size AS size, min(p_name) AS latex FROM part WHERE p_size BETWEEN 1 AND 3 GROUP BY p_size),
r AS (SELECT size - 1 AS idx, CASE WHEN size = 2 THEN concat(chr(10), '$$', chr(10), latex, chr(10), '$$', chr(10)) ELSE concat('$', latex, '$') END AS t FROM f)
SELECT doc_id, concat('a ', coalesce(x.t, concat('<<FORMULA:', k, '>>')), ' b ', coalesce(y.t, '<<FORMULA:1>>'), ' ', source) AS markdown FROM d LEFT JOIN r x ON x.idx = k LEFT JOIN r y ON y.idx = 1""")
def marker_join(spark, sf_dir):
    """Markers for formulas 0 to 4, of which three exist; the others stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WITH_MARKS).alias("markdown"))
    latex = table(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 3").groupBy("p_size").agg(F.min("p_name").alias("latex"))
    latex = latex.select((F.col("p_size") - 1).cast("long").alias("formula_idx"), "latex", (F.col("p_size") != 2).alias("is_inline"))
    found = markers.markers(docs, "doc_id", "formula").withColumn("formula_idx", F.col("ref").cast("long")).join(latex, "formula_idx")
    return markers.splice(docs, "doc_id", found.select("doc_id", "ordinal", markers.formula_text(F.col("latex"), F.col("is_inline")).alias("new")), "formula")


@query("""SELECT doc_id, concat('x ', CASE k WHEN 0 THEN '![image](p.png)' WHEN 1 THEN '' WHEN 2 THEN concat(chr(10), '```mermaid', chr(10), 'g', chr(10), '```', chr(10)) ELSE concat(chr(10), 'Figure: ', source, chr(10)) END, ' y ', CASE k WHEN 0 THEN '![ocr](q.png)' WHEN 1 THEN '' ELSE concat('T$1', source) END) AS markdown
FROM (SELECT *, doc_id % 4 AS k FROM documents)""")
def three_state_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("x ![image](p.png) y ![ocr](q.png)").alias("markdown"))
    figure = F.expr("CASE doc_id % 4 WHEN 1 THEN '' WHEN 2 THEN concat(chr(10), '```mermaid', chr(10), 'g', chr(10), '```') WHEN 3 THEN source END")
    page = F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('T$1', source) END")
    first = lambda new: docs.select("doc_id", F.lit(0).cast("long").alias("ordinal"), new.alias("new"))
    out = markers.splice(docs, "doc_id", first(markers.figure_text(figure)), "image")
    return markers.splice(out, "doc_id", first(markers.ocr_text(page)), "ocr").select("doc_id", "markdown")


_EACH = "array_join(transform(split(text, '[.] ', -1), (s, i) -> concat(s, '. ', {0}, ' ')), '')"
_EACH_SQL = "array_to_string(list_transform(string_split(text, '. '), lambda s, i: concat(s, '. ', {0}, ' ')), '')"


@query("SELECT doc_id, " + _EACH_SQL.format(f"CASE (i - 1) % 7 WHEN 0 THEN concat('$', source, '_{{', doc_id, '}}$') WHEN 1 THEN concat(chr(10), '$$', chr(10), lang, chr(10), '$$', chr(10)) WHEN 3 THEN concat(chr(10), '$$', chr(10), source, chr(10), '$$', chr(10)) WHEN 5 THEN '<<FORMULA:5>>' WHEN 6 THEN '<<FORMULA:6>>' ELSE '{markers.FAILED}' END") + " AS markdown FROM documents")
def formulas_in_texts(spark, sf_dir):
    """A marker after every sentence of every text, as a run has them: looked up, replies unwrapped, spliced. Formulas 5 and 6 aren't there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(_EACH.format("concat('<<FORMULA:', cast(i % 7 AS string), '>>')")).alias("markdown"))
    reply = "CASE formula_idx WHEN 0 THEN concat('$', source, '_{', doc_id, '}$') WHEN 1 THEN concat('```latex\\n', lang, '\\n```') WHEN 2 THEN ' Unclear\\n' WHEN 3 THEN concat('  $$ ', source, ' $$ ') ELSE '' END"
    known = docs.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("formula_idx"))
    known = known.select("doc_id", "formula_idx", (F.col("formula_idx") % 2 == 0).alias("is_inline"), F.expr(reply).alias("reply"))
    found = markers.formula_lookup(docs.select("doc_id", "markdown"), known, "doc_id").where("reply IS NOT NULL")
    latex = F.when(T.is_sentinel("reply", "UNCLEAR"), None).otherwise(T.unwrap_reply("reply"))
    new = found.select("doc_id", "ordinal", markers.formula_text(latex, F.col("is_inline")).alias("new"))
    return markers.splice(docs.select("doc_id", "markdown"), "doc_id", new, "formula").select("doc_id", "markdown")


_PICTURE = "concat('![image](img/', (i - 1) % 4, '.png)')"
#: What stands around the i-th marker: 200 characters on either side, of which a dozen sentences hold all.
_SENTENCE = "concat(p[j], '. ', CASE WHEN {0} THEN concat('![image](img/', (j - 1) % 4, '.png) ') ELSE '' END)"
_AROUND = rf"""{_strip(r"regexp_replace(concat(right(array_to_string(list_transform(range(greatest(1, i - 12), i + 1), lambda j: " + _SENTENCE.format("j < i") + r"), ''), 200), left(concat(' ', array_to_string(list_transform(range(i + 1, least(len(p), i + 12) + 1), lambda j: " + _SENTENCE.format("true") + r"), '')), 200)), '!\[image\]\(.+?\)', '', 'g')")}"""


@query(f"""SELECT doc_id, array_to_string(list_transform(p, lambda s, i: concat(s, '. ', CASE (i - 1) % 4 WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), '```mermaid', chr(10), 'g', chr(10), '```', chr(10)) WHEN 2 THEN concat(chr(10), 'Figure: ', md5({_AROUND}), chr(10)) ELSE {_PICTURE} END, ' ')), '') AS markdown
FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)""")
def pictures_in_texts(spark, sf_dir):
    """A picture after every sentence of every text, as a run has them: of four one isn't there, one only decorates, one is a
    diagram, and one is described by what stands around it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EACH.format("concat('![image](img/', cast(i % 4 AS string), '.png)')")).alias("markdown"))
    assets_there = spark.range(3).select(F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")).alias("ref"))
    found = markers.existing(markers.contexts(docs, "doc_id"), assets_there)
    reply = F.expr("CASE ref WHEN 'img/0.png' THEN ' decorative ' WHEN 'img/1.png' THEN '```mermaid\\ng\\n```' ELSE md5(context) END")
    new = found.withColumn("reply", model.sentinel_to_empty(reply, "DECORATIVE")).select("doc_id", "ordinal", markers.figure_text(F.col("reply")).alias("new"))
    return markers.splice(docs, "doc_id", new, "image").select("doc_id", "markdown")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS extracted, count(*) FILTER (o_orderstatus = 'P') AS blank, count(*) FILTER (o_orderstatus = 'O') AS failed, sum(CASE WHEN o_orderstatus = 'F' THEN length(o_orderpriority) ELSE 0 END)::bigint AS chars FROM orders")
def ocr_outcomes(spark, sf_dir):
    reply = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "P", "")
    return metrics.reply_outcomes(table(spark, sf_dir, "orders").select(reply.alias("reply")))


_PART = "length(encode({0})) || ':' || sha256({0})"


@query(f"""SELECT sha256('any|' || {_PART.format("'cleanup'")} || '|' || {_PART.format("line").replace("length(encode(line))", "octet_length(encode(line))")} || '|-|-|-') AS name, min(doc_id) AS asked_by, count(*) AS requests
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""".replace("length(encode('cleanup'))", "'7'"))
def requests_by_content(spark, sf_dir):
    """Each line of each document as a request to tidy it: equal ones have one name and are asked once."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    null = lambda t: F.lit(None).cast(t)
    rows = lines.select("doc_id", F.lit("cleanup").alias("kind"), "text", null("string").alias("context"), null("binary").alias("image"), null("string").alias("mime"))
    return model.by_content(rows, "any").groupBy("name").agg(F.min("doc_id").alias("asked_by"), F.count("*").alias("requests"))


@query("SELECT count(*) AS calls, sum(p)::bigint AS prompt_tokens, sum(c)::bigint AS completion_tokens, sum(coalesce(p, 0) + coalesce(c, 0))::bigint AS total_tokens, round(sum(value), 4) AS cost FROM (SELECT user_id % 500 AS p, CASE WHEN event_type = 'click' THEN NULL ELSE user_id % 90 END AS c, value FROM events)")
def model_usage_totals(spark, sf_dir):
    calls = table(spark, sf_dir, "events").selectExpr("user_id % 500 AS prompt_tokens", "CASE WHEN event_type = 'click' THEN NULL ELSE user_id % 90 END AS completion_tokens", "value AS cost")
    return metrics.usage_totals(calls)


# Geometry -------------------------------------------------------------------------------------------------------------

_X0, _Y0 = "cast(l_partkey % 500 AS double)", "cast((l_suppkey * 7) % 200 AS double)"
_X1, _Y1 = f"{_X0} + 3 + l_quantity", f"{_Y0} + 6 + l_linenumber"
_BOXES = f"""b AS MATERIALIZED (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, l_linenumber, l_partkey) AS n, * FROM (SELECT *, {_X0} AS x0, {_Y0} AS y0, {_X1} AS x1, {_Y1} AS y1 FROM lineitem)),
f AS (SELECT o, n, x0, y0, x1, y1, 1 AS r FROM b WHERE n = 1
  UNION ALL SELECT b.o, b.n, CASE WHEN j THEN least(fx0, b.x0) ELSE b.x0 END, CASE WHEN j THEN least(fy0, b.y0) ELSE b.y0 END, CASE WHEN j THEN greatest(fx1, b.x1) ELSE b.x1 END, CASE WHEN j THEN greatest(fy1, b.y1) ELSE b.y1 END, r + CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT b.*, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, f.r, b.y0 - f.y1 < (f.y1 - f.y0) * 1.5 AND b.x0 - f.x1 < 600 * 0.3 AS j FROM f JOIN b ON b.o = f.o AND b.n = f.n + 1) b),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o, r ORDER BY n DESC) = 1),
k AS (SELECT o, r, x0, y0, x1, y1 FROM g WHERE x1 - x0 > 10)"""


def _order_regions(spark, sf_dir) -> DataFrame:
    """Orders as pages 600 wide, line items as spans whose line is 150 wide."""
    box = f"named_struct('x0', {_X0}, 'y0', {_Y0}, 'x1', {_X1}, 'y1', {_Y1})"
    spans = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey AS string) AS rel_path", "0L AS page", "l_linenumber * 1000000L + l_partkey AS seq", "0 AS block_type", "'∑' AS text", "'' AS font", f"{box} AS bbox",
        f"named_struct('x0', {_X0}, 'y0', {_Y0}, 'x1', {_X0} + 150, 'y1', {_Y1}) AS line_bbox", "600D AS page_width", "800D AS page_height",
    )
    return formulas.regions(spans)


@query(f"WITH RECURSIVE {_BOXES} SELECT o::varchar AS rel_path, row_number() OVER (PARTITION BY o ORDER BY r) - 1 AS formula_idx, x0, y0, x1, y1 FROM k")
def region_merge(spark, sf_dir):
    return _order_regions(spark, sf_dir).select("rel_path", "formula_idx", "bbox.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, w / lw > 0.7 AS fills_line, CASE WHEN lw > 0 AND w / lw > 0.7 THEN false WHEN w / 600 < 0.3 THEN true ELSE false END AS is_inline
FROM (SELECT *, cast(l_quantity AS double) * 6 AS w, cast(l_linenumber * 60 AS double) AS lw FROM lineitem)""")
def inline_display(spark, sf_dir):
    w, lw = F.col("l_quantity").cast("double") * 6, (F.col("l_linenumber") * 60).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (w / lw > 0.7).alias("fills_line"), formulas.is_inline(w, lw, F.lit(600.0)).alias("is_inline"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w >= 1 AND h >= 1 THEN w END AS width FROM (SELECT *, least(400, x0 + l_quantity - 9 + 4) - greatest(0, x0 - 4) AS w, least(300, y0 + 3 + 4) - greatest(0, y0 - 4) AS h
  FROM (SELECT *, cast(l_partkey % 500 AS double) AS x0, cast((l_suppkey * 7) % 400 AS double) AS y0 FROM lineitem))""")
def clip_boxes(spark, sf_dir):
    box = "named_struct('x0', cast(l_partkey % 500 AS double), 'y0', cast((l_suppkey * 7) % 400 AS double), 'x1', cast(l_partkey % 500 AS double) + l_quantity - 9, 'y1', cast((l_suppkey * 7) % 400 AS double) + 3)"
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{box} AS bbox")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", formulas.clip_box("bbox", "400D", "300D").alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("c.x1") - F.col("c.x0")).alias("width"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(l_linenumber + 10 - 1, trunc(l_quantity / 40 * (l_linenumber + 10))))::bigint AS line_no FROM lineitem")
def position_join(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber") + 10)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", formulas.line_at("l_quantity", F.lit(40.0), "n").alias("line_no"))


@query(f"""WITH RECURSIVE {_BOXES}, i AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY r) - 1 AS idx, (y0 + y1) / 2 AS y, x1 - x0 AS w FROM k),
p AS (SELECT o_orderkey AS o, string_split('a b c d e f', ' ') AS l FROM orders),
s AS (SELECT i.*, greatest(0, least(5, trunc(y / 200 * 6)))::int AS line, NOT (w / 150 > 0.7) AND w / 600 < 0.3 AS inl FROM i),
t AS (SELECT o, n AS line, -1 AS own, 0 AS ord, concat(CASE WHEN n > 0 THEN chr(10) ELSE '' END, l[n + 1]) AS t FROM p, (SELECT unnest(range(6)) AS n)
  UNION ALL SELECT o, line, CASE WHEN inl THEN 0 ELSE 1 END, CASE WHEN inl THEN idx ELSE -idx END, concat(CASE WHEN inl THEN ' ' ELSE chr(10) END, '<<FORMULA:', idx, '>>') FROM s)
SELECT o::varchar AS rel_path, string_agg(t.t, '' ORDER BY line, own, ord) AS text FROM t SEMI JOIN p USING (o) GROUP BY o""")
def page_regions_join(spark, sf_dir):
    """Orders as pages of six lines; their regions become markers at proportional places."""
    pages = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS rel_path", "0L AS page", "'a\\nb\\nc\\nd\\ne\\nf' AS text", "200D AS height")
    found = _order_regions(spark, sf_dir)
    wide = F.col("bbox.x1") - F.col("bbox.x0")
    found = found.withColumn("is_inline", formulas.is_inline(wide, F.lit(150.0), F.lit(600.0)))
    return formulas.insert_markers(pages, found).select("rel_path", "text")


_MATHED = "CASE doc_id % 4 WHEN 0 THEN concat(source, ' ∑α') WHEN 1 THEN '∫x∈ℝ∂' WHEN 2 THEN ' ≤' ELSE concat('x', source, '𝑥𝑦') END"


@query(rf"""SELECT doc_id, length(regexp_replace(t, '[^{MATH_RANGES}{MATH_SIGNS}]', '', 'g')) AS math_chars, CASE WHEN lang = 'de' THEN true ELSE length(regexp_replace(t, '[^{MATH_RANGES}{MATH_SIGNS}]', '', 'g')) / length(t) > 0.3 OR (length(trim(t)) <= 2 AND length(regexp_replace(t, '[^{MATH_RANGES}{MATH_SIGNS}]', '', 'g')) >= 1) END AS is_math
FROM (SELECT doc_id, lang, {_MATHED} AS t FROM documents)""")
def math_span_filter(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", "CMMI10").otherwise("Helvetica").alias("font"), F.expr(_MATHED).alias("t"))
    return t.select("doc_id", formulas.math_chars("t").alias("math_chars"), formulas.is_math("t", "font").alias("is_math"))


@query(f"""WITH RECURSIVE {_BOXES}, i AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY r) - 1 AS idx, y0, y1 FROM k)
SELECT o::varchar AS rel_path, idx AS formula_idx, substr(coalesce(string_agg(concat('s', b.l_partkey), ' ' ORDER BY b.y0, b.x0, b.l_linenumber * 1000000 + b.l_partkey), ''), 1, 300) AS context
FROM i JOIN b USING (o) WHERE b.y1 > greatest(0, i.y0 - 2 * (i.y1 - i.y0)) AND b.y0 < i.y1 + 2 * (i.y1 - i.y0) GROUP BY ALL""")
def region_context(spark, sf_dir):
    """What stands within two heights of each region of an order's line items."""
    box = f"named_struct('x0', {_X0}, 'y0', {_Y0}, 'x1', {_X1}, 'y1', {_Y1})"
    spans = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS rel_path", "0L AS page", "l_linenumber * 1000000L + l_partkey AS seq", "0 AS block_type", "concat('s', l_partkey) AS text", f"{box} AS bbox")
    return formulas.region_context(_order_regions(spark, sf_dir), spans).select("rel_path", "formula_idx", "context")


# Images ---------------------------------------------------------------------------------------------------------------


@query("""SELECT rel_path, xref, page, pos, row_number() OVER (PARTITION BY rel_path ORDER BY page, pos, xref) - 1 AS asset_idx FROM (
  SELECT l_suppkey::varchar AS rel_path, l_partkey AS xref, l_orderkey AS page, l_linenumber AS pos, cast(l_quantity * 3 AS int) AS width, 100 AS height FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, cast(l_quantity * 3 AS int), l_extendedprice) = 1) WHERE width >= 50 AND height >= 50""")
def xref_dedup(spark, sf_dir):
    """Suppliers as documents, orders as pages, parts as image objects."""
    t = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey AS string) AS rel_path", "l_partkey AS xref", "l_orderkey AS page", "l_linenumber AS pos", "cast(l_quantity * 3 AS int) AS width", "100 AS height")
    return assets.embedded_images(t).select("rel_path", "xref", "page", "pos", "asset_idx")


@query("""WITH p AS (SELECT o_custkey AS c, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
i AS (SELECT user_id AS c, event_id AS image, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT c, n, place, image FROM p FULL JOIN i USING (c, n)""")
def ordinal_pairing(spark, sf_dir):
    """Customers' orders as drawings, users' events as images: paired by order, what is left over on either side kept."""
    p = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c", "o_orderkey AS place")
    i = table(spark, sf_dir, "events").selectExpr("user_id AS c", "event_id AS image")
    return assets.pair_by_order(p, i, "c", "place", "image").withColumn("n", F.col("n").cast("long"))


@query("SELECT source AS rel_path, count(*) AS pages, round(avg(CASE WHEN n_chars < 900 THEN 1.0 ELSE 0 END), 6) AS blank_ratio, avg(CASE WHEN n_chars < 900 THEN 1.0 ELSE 0 END) >= 0.8 AS is_scanned FROM documents GROUP BY source")
def scanned_ratio(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("source AS rel_path", "CASE WHEN n_chars < 900 THEN '  ' ELSE text END AS text")
    return assets.scanned(pages).withColumn("blank_ratio", F.round("blank_ratio", 6))


@query("SELECT doc_id, 0::bigint AS ordinal, concat('img/', source, '.png') AS ref FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)")
def existing_images(spark, sf_dir):
    """Each document refers to its source's picture; sources with a long document have one."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(F.lit("t ![image](img/"), "source", F.lit(".png) u")).alias("markdown"))
    have = docs.where("n_chars > 20000").select(F.concat(F.lit("img/"), "source", F.lit(".png")).alias("ref"))
    return markers.existing(markers.markers(marked, "doc_id", "image"), have).select("doc_id", "ordinal", "ref")


@query(f"SELECT doc_id, length({_FIXED_SQL.format(_DIRTY)}) AS chars, length({_FIXED_SQL.format(_DIRTY)}) - length({_DIRTY}) AS delta FROM documents")
def step_deltas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY).alias("markdown"))
    return metrics.step_deltas(docs, lint.lint(docs).select("doc_id", "markdown"), "doc_id")
