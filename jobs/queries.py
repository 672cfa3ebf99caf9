"""The jobs as registered queries, each beside the SQL of the output that it leaves after two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.publish_knowledge import MANIFEST, publish
from jobs.sync_knowledge import INDEX, sync
from lectern.functions.patterns import WS
from lectern.operators.sections import FURNITURE
from lectern.plans import catalog
from lectern.plans import queries as engine
from lectern.shared import new_dir


def job1_publish_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest that two runs over the same tables leave."""
    output = new_dir(spark, "job1")
    for _ in range(2):
        publish(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", output)
    return catalog.read(spark, f"{output}/manifest", MANIFEST, "json").withColumn("headings", F.array_join("headings", "\n"))


def job2_sync_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two runs, of which the second finds nothing new."""
    output = new_dir(spark, "job2")
    for _ in range(2):
        sync(spark, f"{sf_dir}/documents.parquet", output, f"{output}/checkpoint")
    return catalog.read(spark, f"{output}/index", INDEX, "json").withColumn("headings", F.array_join("headings", "\n"))


QUERIES = {f.__name__: f for f in (job1_publish_knowledge, job2_sync_knowledge)}

#: Paths and texts (doc_id, md) of documents and of transcripts.
_DOCUMENTS = "SELECT concat(coalesce(source, 'unknown'), '/', coalesce(lang, 'und'), '/d', coalesce(doc_id::varchar, md5(text)), '.md') AS doc_id, text AS md FROM documents WHERE text IS NOT NULL"
_TRANSCRIPTS = "SELECT concat('conversations/c', conv_id, '.md') AS doc_id, concat('# Conversation ', conv_id, chr(10), string_agg(concat(chr(10), '## ', coalesce(role, 'unknown'), chr(10), chr(10), coalesce(text, '')), chr(10) ORDER BY turn)) AS md FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"
_PLAIN = FURNITURE.replace(r"\A", "^").replace(r"\z", "$").replace("'", "''")


def _entries(source: str) -> str:
    """What the index says of the pages made of source: repeated lines out, linted, described. No text there has an image or
    is a deck, so no section goes."""
    line, counted = engine._line("md", "src"), f"{engine._COUNTED} AND NOT regexp_matches(t, '{_PLAIN}')"
    changed = f"CASE WHEN m = f THEN 0 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)) END"
    return rf"""
WITH src AS MATERIALIZED ({source}),
l AS MATERIALIZED {line},
r AS (SELECT doc_id, t FROM l WHERE {counted} GROUP BY doc_id, t HAVING count(*) >= 3),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS m FROM l ANTI JOIN r USING (doc_id, t) GROUP BY doc_id),
x AS (SELECT doc_id AS path, md5(md) AS digest, coalesce(m, '') AS m FROM src LEFT JOIN o USING (doc_id)),
y AS (SELECT *, {engine._FIXED_SQL.format("m")} AS f FROM x),
z AS (SELECT *, {engine._SPLIT_SQL.format("p")} AS a, {engine._SPLIT_SQL.format("q")} AS b, string_split(f, chr(10)) AS l FROM (SELECT *, {engine._lines("m")} AS p, {engine._lines("f")} AS q FROM y))
SELECT path, {engine._title("f", "regexp_extract(string_split(path, '/')[-1], '^(.+)[.][^.]+$', 1)")} AS title, array_to_string(list_slice({engine._headings("f")}, 1, 20), chr(10)) AS headings,
  len(list_filter(string_split_regex(f, '{WS}+'), lambda w: w <> '')) AS word_count, {changed} AS fixed_count, {" + ".join(engine._FOUND_SQL.values())} AS remaining, digest, string_split(path, '/')[1] AS "group" FROM z"""


SQL = {
    "job1_publish_knowledge": f"""SELECT *, rank() OVER (ORDER BY string_split(path, '/')) AS place FROM ({_entries(f"{_DOCUMENTS} UNION ALL {_TRANSCRIPTS}")})""",
    "job2_sync_knowledge": f"SELECT *, 1::bigint AS versions FROM ({_entries(_DOCUMENTS)})",
}
