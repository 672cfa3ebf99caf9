"""Incremental runs with Structured Streaming.

A file stream sees new files once. The progress log decides what is done: each micro-batch leaves what it finished as the
log's partition of its number, after its outputs, so a batch that is run again after a failure is known. If its partition is
there it was finished and nothing is done; if not, it is worked out again against the batches before it alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import format_of
from lectern.operators import lint, progress, sections
from lectern.plans.run import read_progress, write_progress
from lectern.shared import exists, new_dir, remove, written
from lectern.sinks import write_files

SCHEMA = "rel_path string, mtime double, markdown string"


def process_new(spark: SparkSession, source: str, state: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], fmt: str = "parquet", schema: str = SCHEMA, write: Callable[[DataFrame], None] | None = None):
    """Run ``process`` over documents (rel_path, mtime, ...) of files that arrived below source, and stop when all are done.

    process returns rel_path, mtime, output (and more) of what it finished. Its rows are worked out once, into the shared
    folder: ``write`` gets them from there, and the progress log below state after that.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        if exists(session, f"{state}/batch={number}"):
            return  # finished by a run that ended before the checkpoint knew
        done = read_progress(session, state, number)
        newest = progress.latest(rows, ["rel_path"], [F.col("mtime")])
        held = new_dir(session, "batch")
        try:
            finished = written(process(progress.pending(newest, done)), held)
            if write:
                write(finished)
            write_progress(finished, state, number)
        finally:
            remove(session, held)

    stream = spark.readStream.format(fmt).schema(schema).load(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tidy(compat: bool = False) -> Callable[[DataFrame], DataFrame]:
    """What to do with extracted texts that arrive: filter and lint them. For process_new, with outputs() to write them."""

    def process(rows: DataFrame) -> DataFrame:
        docs = rows.withColumn("format", F.coalesce(format_of("rel_path"), F.lit("")))
        return lint.lint(progress.outputs(sections.filter_content(docs, compat=compat)), compat=compat).withColumn("output", F.col("out_path"))

    return process


def outputs(root: str) -> Callable[[DataFrame], None]:
    """Writes the texts that tidy() finished below root."""
    return lambda finished: write_files(finished.where("wins AND markdown IS NOT NULL").select("out_path", "markdown"), root)


def arrivals(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, documents: arrivals by time window, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("documents"))
