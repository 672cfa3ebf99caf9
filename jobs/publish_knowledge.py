"""Publish a knowledge base: documents and conversation transcripts as cleaned, linted and indexed Markdown.

    python -m jobs.publish_knowledge [--config FILE] [--documents PATH] [--conversations PATH] [--output PATH] [--compat yes|no]

Below the output: pages (Parquet: the Markdown and what was found in it), manifest (JSON: title, headings, words and place of
each page), index (text: a link for each page in path order) and summary (JSON), all but the last partitioned by group. A
document's group is its source; transcripts are a group of their own. Every run publishes the whole again, so a rerun gives
the same, also after a run that broke off.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import session, settings
from lectern.operators import tables
from lectern.plans import catalog

log = logging.getLogger("jobs.publish_knowledge")
MANIFEST = f"{catalog.ENTRY}, place long, group string"


def document_files(documents: DataFrame) -> DataFrame:
    """rel_path, format, markdown: a document at source/lang/d<doc_id>. A row without doc_id is named by its text."""
    name = F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), name)
    return documents.select(path.alias("rel_path"), F.lit("text").alias("format"), F.col("text").alias("markdown"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """rel_path, format, markdown: a conversation as a heading and a section for each turn. Rows without conv_id belong to none."""
    said = F.concat(F.lit("\n## "), F.coalesce("role", F.lit("unknown")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", said.alias("text"))
    whole = tables.ordered_concat(rows, ["conv_id"], ["turn"])
    number = F.col("conv_id").cast("string")
    return whole.select(F.concat(F.lit("conversations/c"), number, F.lit(".txt")).alias("rel_path"), F.lit("text").alias("format"), F.concat(F.lit("# Conversation "), number, F.lit("\n"), F.col("markdown")).alias("markdown"))


def publish(spark: SparkSession, documents: str, conversations: str, output: str, compat: bool = False) -> dict[str, int]:
    """Publish the tables at the given paths below output. Returns how many rows were read and pages written."""
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    talks = spark.read.parquet(conversations).select("conv_id", "turn", "role", "text")
    pages = catalog.pages(document_files(docs).unionByName(transcripts(talks)), compat)
    # All partitions are written anew: those of a run before that nothing belongs to any more go.
    catalog.write(pages, f"{output}/pages", "group", whole=True)
    entries = catalog.read(spark, f"{output}/pages", catalog.PAGES).drop("markdown")
    # Counts of Parquet tables come from the files' ends.
    facts = {"documents read": docs.count(), "conversation turns read": talks.count(), "pages written": entries.count()}
    for name, n in facts.items():
        log.info("%s: %d", name, n)
    # From here on only what stands in the pages' short columns is read.
    catalog.write(catalog.manifest(entries), f"{output}/manifest", "group", fmt="json", whole=True)
    catalog.write_index(entries, f"{output}/index")
    catalog.summary(entries).write.mode("overwrite").json(f"{output}/summary")
    log.info("wrote pages, manifest, index and summary below %s", output)
    return facts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    held = settings("publish_knowledge", argv, documents="table of documents", conversations="table of conversations", output="folder of the knowledge base", compat="yes: follow the historic filter rules to the letter")
    own = spark is None
    spark = spark or session("publish_knowledge")
    try:
        publish(spark, held["documents"], held["conversations"], held["output"], held["compat"] == "yes")
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
