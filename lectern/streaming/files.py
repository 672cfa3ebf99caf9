"""New and changed files of a tree as a stream.

A file stream of Spark's sees each name once; here a file comes again whenever its time changes. The stream's offset is a
moment: a batch holds the files whose time lies after the last offset and not after the new one, so the driver holds no list
and a checkpoint is one number. A batch that is run again looks at the same stretch of time; a file that changed meanwhile is
no longer in it and comes with a later one. Folders at the top are listed by tasks of their own.

A file that comes with an old time (moved or copied with it) isn't seen here; ``run`` without a stream, which compares the
whole tree with the progress log, takes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lectern.functions.text import FORMATS, SKIPPED_DIRS, format_of, path_parts, stem, suffix
from lectern.sources.tree import entries, opened

#: Seconds that a file must have been left alone before a batch takes it.
LAG = 2.0


class _Folder(InputPartition):
    def __init__(self, folder: str, after: float, until: float):
        self.folder, self.after, self.until = folder, after, until


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, lag: float):
        self.root, self.lag = root, lag

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": time.time() - self.lag}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, base = opened(self.root)
        top = [name for is_dir, name, *_ in entries(fs, base, "") if is_dir and name not in SKIPPED_DIRS]
        return [_Folder(x, start["until"], end["until"]) for x in ("", *top)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        fs, base = opened(self.root)
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            for is_dir, name, mtime, length in entries(fs, base, folder):
                if name in SKIPPED_DIRS:
                    continue
                path = f"{folder}/{name}" if folder else name
                if is_dir:
                    if partition.folder:  # the top's own files have a partition without its folders
                        todo.append(path)
                elif name.lower().endswith(tuple(FORMATS)) and partition.after < (mtime or 0.0) <= partition.until:
                    yield path, mtime, length

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""


class DocStream(DataSource):
    """``spark.readStream.format("docstream").option("lag", seconds).load(root)``: rel_path, mtime, length."""

    @classmethod
    def name(cls) -> str:
        return "docstream"

    def schema(self) -> str:
        return "rel_path string, mtime double, length long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], float(self.options.get("lag", LAG)))


def changed_files(spark: SparkSession, root: str, lag: float = LAG) -> DataFrame:
    """A stream of the files of known formats below root (schema FILES) that are new or changed."""
    spark.dataSource.register(DocStream)
    rows = spark.readStream.format("docstream").option("lag", str(lag)).load(root)
    out = rows.select("rel_path", path_parts("rel_path").alias("parts"), stem("rel_path").alias("stem"), suffix("rel_path").alias("ext"), format_of("rel_path").alias("format"), "mtime", "length")
    return out.where(F.col("format").isNotNull())


def watch(spark: SparkSession, root: str, checkpoint: str, take: Callable[[DataFrame], None], every: str | None = None, lag: float = LAG):
    """Hand batches of new and changed files to take: once, or every so often (``"1 minute"``) until the query is stopped."""
    writer = changed_files(spark, root, lag).writeStream.foreachBatch(lambda rows, _: take(rows)).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query
