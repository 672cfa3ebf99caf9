"""Sinks of files: one for each row, or one that many tasks write together.

Tables go through Spark's own writers (plans/catalog.py), which publish all of a job's output or none, to any file system that
Spark can write to. These are for readers who want plain files. A file is written under another name and then moved, so it is
there as a whole or not at all, and a task that is run again puts the same bytes in the same place.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import order
from lectern.sources.tree import is_local, opened


def write_files(rows: DataFrame, root: str) -> None:
    """rows (a path below root; text or bytes): a file each, written by the tasks that hold them."""

    def put(part) -> None:
        fs, base = opened(root)
        made: set[str] = set()
        for rel, data in part:
            path = f"{base}/{rel}"
            folder = path.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            new = f"{path}.{uuid.uuid4().hex}.new"
            with fs.open_output_stream(new) as f:
                f.write(data.encode() if isinstance(data, str) else bytes(data))
            fs.move(new, path)

    rows.foreachPartition(put)


def write_lines(lines: DataFrame, by: list, root: str, name: str) -> None:
    """The column value of lines as one text file, joined by line feeds in the order of by.

    The place of each line is known from the bytes before it, so on a mounted disk every task writes its own stretch of the
    one file. Elsewhere name is a folder of text files whose names sort as their lines do.
    """
    spark = lines.sparkSession
    if not is_local(root):
        order.spread(lines, by).select("value").write.mode("overwrite").text(f"{root}/{name}")
        return
    placed = order.before(lines, by, F.octet_length("value") + 1, "_from").select("_from", "value")
    size = placed.agg(F.max(F.col("_from") + F.octet_length("value"))).head()[0] or 0
    new = os.path.join(root, f"{name}.{uuid.uuid4().hex}.new")
    with open(new, "wb") as f:
        f.truncate(size)

    def put(part) -> None:
        with open(new, "r+b") as f:
            for at, value in part:
                f.seek(at)
                f.write(value.encode())
                if at + len(value.encode()) < size:
                    f.write(b"\n")

    placed.foreachPartition(put)
    os.replace(new, os.path.join(root, name))


def read_files(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """path, markdown of the listed files (rel_path) below root, read by tasks, one file at a time."""

    def read(batches):
        import pyarrow as pa

        fs, base = opened(root)
        for b in batches:
            for rel in b.column("rel_path").to_pylist():
                with fs.open_input_stream(f"{base}/{rel}") as f:
                    text = f.read().decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text])], ["path", "markdown"])

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return listed.select("rel_path").repartition(width).mapInArrow(read, "path string, markdown string")
