"""Tables in the folder that driver and executors share: lineage cuts that outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go if the session names no spark.checkpoint.dir (with a local master only).
LOCAL_FALLBACK = "/tmp/lectern-checkpoints"

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local master may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        named = LOCAL_FALLBACK
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, put there anew and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, there until the driver's Python ends."""
    path = new_dir(df.sparkSession, "lectern")
    _kept.append((df.sparkSession, path))
    return written(df, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file system, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of a few files at path."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether what is at path is one file rather than a folder of them."""
    names = [unquote(x).rpartition("/")[2] for x in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()]
    return names == [path.rstrip("/").rpartition("/")[2]]


def sweep() -> None:
    """Delete what keep() wrote in this process."""
    while _kept:
        with contextlib.suppress(Exception):  # a session that has ended can't delete; nothing else depends on it
            remove(*_kept.pop())


atexit.register(sweep)
