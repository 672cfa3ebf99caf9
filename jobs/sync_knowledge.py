"""Keep a knowledge base in step with documents that arrive: only new and changed ones are worked on.

    python -m jobs.sync_knowledge [--config FILE] [--arrivals PATH] [--output PATH] [--checkpoint PATH] [--files N]

A file stream with a checkpoint hands over the files that came since the last run, and the job ends when there are no more.
A document that comes again with another text is a new version of its page; one that comes with the same text is left alone.

Below the output: pages (Parquet, partitioned by group and batch: all versions, with their Markdown), index (JSON, partitioned
by group: the newest version of each page) and runs (JSON, partitioned by batch: what each batch was and did). A batch writes
only its own partitions of pages and runs, and works the index of the groups that it touched out anew from pages. So a batch
that is run again after a failure, whole or in part, leaves what a single run does, and a batch costs what arrived and the
short columns of the groups that it touched.
"""

from __future__ import annotations

import logging
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.publish_knowledge import document_files
from jobs.settings import session, settings
from lectern.operators import progress
from lectern.plans import catalog
from lectern.shared import exists, is_file, new_dir, remove, written

log = logging.getLogger("jobs.sync_knowledge")
DOCUMENTS = "doc_id long, text string, lang string, source string"
LOG = f"{catalog.PAGES}, batch long"
INDEX = f"{catalog.ENTRY}, versions long, group string"
RUNS = "arrived long, changed long, pages long, groups long, characters long, batch long"


def take(rows: DataFrame, batch: int, output: str) -> None:
    """One batch of arrivals: its pages, the index of the groups they are in, and a line in the log of runs."""
    spark = rows.sparkSession
    held = new_dir(spark, "arrived")
    try:
        _take(written(document_files(rows), held), batch, output)  # a batch's plan reads all of its columns each time it is used
    finally:
        remove(spark, held)


def _take(files: DataFrame, batch: int, output: str) -> None:
    spark = files.sparkSession
    arrived = progress.winners(files.where("markdown IS NOT NULL"), then=[F.md5("markdown")]).drop("out_path")
    had = catalog.read(spark, f"{output}/pages", LOG)
    fresh = catalog.changed(arrived, had, batch)
    made = catalog.pages(fresh).withColumn("batch", F.lit(batch).cast("long"))
    catalog.write(made, f"{output}/pages", "group", "batch")
    # What was written is read back, so the texts are worked on once; a batch without pages leaves no partition.
    pages = catalog.read(spark, f"{output}/pages", LOG)
    mine = pages.where(F.col("batch") == batch)
    groups = mine.select("group").distinct()
    catalog.write(catalog.current(pages.where(F.col("batch") <= batch), groups), f"{output}/index", "group", fmt="json")
    n = files.count()
    seen = mine.agg(F.count("*").alias("pages"), F.count_distinct("group").alias("groups"), F.coalesce(F.sum(F.length("markdown")), F.lit(0)).alias("characters"))
    facts = seen.select(F.lit(n).alias("arrived"), F.col("pages").alias("changed"), "pages", "groups", "characters", F.lit(batch).cast("long").alias("batch"))
    catalog.write(facts, f"{output}/runs", "batch", fmt="json")
    done = catalog.read(spark, f"{output}/runs", RUNS, "json").where(F.col("batch") == batch).drop("batch").head()  # the texts aren't read again
    log.info("batch %d: %s", batch, ", ".join(f"{v} {k}" for k, v in done.asDict().items()))


def sync(spark: SparkSession, arrivals: str, output: str, checkpoint: str, files: int = 1000) -> int:
    """Take all files below arrivals that no run with this checkpoint has taken. Returns the number of batches.

    Batches are numbered by the checkpoint, so an output that has batches of another one is refused.
    """
    if not exists(spark, f"{checkpoint}/metadata") and not catalog.read(spark, f"{output}/pages", LOG).isEmpty():
        raise ValueError(f"{output} has pages, but the checkpoint {checkpoint} isn't there: a new one would number its batches over theirs")
    reader = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files)
    if is_file(spark, arrivals):  # a stream watches folders; here it looks for the one name
        folder, _, name = arrivals.rstrip("/").rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(arrivals)
    query = stream.writeStream.foreachBatch(partial(take, output=output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sum(1 for p in query.recentProgress if p["numInputRows"])
    log.info("took %d batches from %s; the knowledge base is below %s", batches, arrivals, output)
    return batches


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    held = settings("sync_knowledge", argv, arrivals="folder or table of documents that grows", output="folder of the knowledge base", checkpoint="folder of the stream's checkpoint", files="files that one batch takes")
    own = spark is None
    spark = spark or session("sync_knowledge")
    try:
        sync(spark, held["arrivals"], held["output"], held["checkpoint"], int(held["files"]))
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
