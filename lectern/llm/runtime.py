"""Shared folder, lineage cuts and small helpers that the operators have in common."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no spark.checkpoint.dir (local runs and tests only).
LOCAL_FALLBACK = "/tmp/lectern-checkpoints"
#: Rows that one Arrow batch holds; long texts come in batches of the same count, so it is well under Spark's default.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, with a local master only, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        named = LOCAL_FALLBACK
    return named.rstrip("/")


_kept: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back: cuts the lineage and outlives lost executors.

    Results are lazy and may read the table at any time, so it stays until sweep() or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete all kept tables of this process; what was made of them must have been written by then."""
    while _kept:
        spark, path = _kept.pop()
        with contextlib.suppress(Exception):  # a session that has ended can't delete; nothing else depends on it
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(sweep)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. A setting of the user's own is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def parts_for(n: int, each: int, least: int = 32) -> int:
    """Number of hash ranges so that one holds about ``each`` of ``n`` entries: it grows with the input."""
    return max(least, -(-int(n) // each))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash."""
    return df.select(*[F.col(f"`{x}`") for x in names])


#: Bits of the filter below: 16 a key up to 256 MB in all, whatever the number of keys.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 31
#: Rows of a (key, short value) table that is broadcast; a larger one is joined otherwise.
BROADCAST_ROWS = 500_000


def _marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with _hit: false only if the key is not among keys.

    A one-hash Bloom filter in 32768-bit bitmaps that grows with the number of keys up to MOST_BITS, so its broadcast has a
    fixed bound. It only saves shuffled rows ahead of a join on the key; with any number of keys the join's result is the same.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    spot = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(bits))
    marks = keys.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    held = df.withColumn("_spot", spot).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    held = held.join(F.broadcast(marks), "_bucket", "left").withColumn("_at", F.bitmap_bit_position("_spot").cast("int"))
    hit = F.expr("(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) AS int) & shiftleft(1, _at % 8)) <> 0")
    return held.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_spot", "_bucket", "_bits", "_at")


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key may be among keys: all that are, and few others as long as the bits aren't filled."""
    return _marked(df, key, keys).where("_hit").drop("_hit")


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is not among keys; only those that may be are shuffled."""
    marked = _marked(df, key, keys)
    return marked.where("NOT _hit").drop("_hit").unionByName(marked.where("_hit").drop("_hit").join(keys, key, "left_anti"))


def left_rare(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """df left joined with a kept table on the key: only rows whose key may be in the table are shuffled."""
    marked = _marked(df, key, table.select(key))
    plain = marked.where("NOT _hit").drop("_hit")
    return plain.unionByName(marked.where("_hit").drop("_hit").join(table, key, "left"), allowMissingColumns=True)


def with_few(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The same for a table of (key, short values): one of BROADCAST_ROWS or less is broadcast."""
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), key, "left")
    return left_rare(df, key, table)
