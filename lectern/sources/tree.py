"""Listing a tree level by level, off the driver.

The folders of a level are dealt out to tasks, which list them; what they find there that is a folder is the next level. Each
level is a table in the shared folder, so a level is listed once, and the driver holds no name, only the number of levels.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import keep

LISTED = "is_dir boolean, rel_path string, mtime double, length long"
#: Names that one output batch holds.
ROWS = 10_000


def is_local(root: str) -> bool:
    """Whether a root is a path of a disk that all machines mount, rather than a URI of another file system."""
    return "://" not in root and not root.startswith("file:")


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a root and the path in it."""
    if is_local(root):
        return arrow_fs.LocalFileSystem(), os.path.abspath(root)
    return arrow_fs.FileSystem.from_uri(root)


def entries(fs: arrow_fs.FileSystem, base: str, folder: str) -> Iterator[tuple[bool, str, float | None, int | None]]:
    """(is a folder, name, time, bytes) of what is in a folder. One that can't be listed has nothing; links to folders aren't followed."""
    path = f"{base}/{folder}" if folder else base
    if isinstance(fs, arrow_fs.LocalFileSystem):
        try:
            with os.scandir(path) as found:
                for x in found:
                    if x.is_dir(follow_symlinks=False):
                        yield True, x.name, None, None
                    elif x.is_file():
                        info = x.stat()
                        yield False, x.name, info.st_mtime, info.st_size
        except OSError:
            return
        return
    for x in fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)):
        if x.type == arrow_fs.FileType.Directory:
            yield True, x.base_name, None, None
        elif x.is_file:
            yield False, x.base_name, None if x.mtime_ns is None else x.mtime_ns / 1e9, x.size


def listing(spark: SparkSession, root: str, endings: tuple[str, ...], skipped: tuple[str, ...] = ()) -> DataFrame:
    """rel_path, mtime, length of the files below root whose names end so, in any case; nothing named as in skipped is looked at."""

    def run(batches):
        fs, base = opened(root)
        held: list[tuple] = []
        schema = pa.schema([("is_dir", pa.bool_()), ("rel_path", pa.string()), ("mtime", pa.float64()), ("length", pa.int64())])
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held) if held else [[]] * 4, schema)], schema=schema)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                for is_dir, name, mtime, length in entries(fs, base, folder):
                    if name not in skipped and (is_dir or name.lower().endswith(endings)):
                        held.append((is_dir, f"{folder}/{name}" if folder else name, mtime, length))
                        if len(held) >= ROWS:
                            yield send()
                            held.clear()
        yield send()

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    level = spark.createDataFrame([("",)], "folder string")
    out = spark.createDataFrame([], LISTED)
    while not level.isEmpty():
        found = keep(level.repartition(width, "folder").mapInArrow(run, LISTED))
        out = out.unionByName(found.where("NOT is_dir"))
        level = found.where("is_dir").select(F.col("rel_path").alias("folder"))
    return out.drop("is_dir")
