"""Global order without one task that sees all rows.

Rows are dealt out by range and sorted within each range, the ranges are counted, and what lies before a row is the sum of
the ranges before plus what lies before it in its own. Only one number a range comes to the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import keep


def spread(df: DataFrame, by: list, ranges: int | None = None) -> DataFrame:
    """df dealt out by range and sorted: partition k holds nothing that comes after a row of partition k + 1."""
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def before(df: DataFrame, by: list, weight: Column | None = None, to: str = "before", ranges: int | None = None) -> DataFrame:
    """df with a column: the sum of weight (else the number) of the rows that come before each, in the order of by.

    The order should be total; rows equal in it come one after the other, in any order, and share a range. The rows are
    written once, as ranges worked out a second time could differ; null weights count as 0.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = spread(df, by, ranges).withColumn("_part", part).withColumn("_at", at)
    rows = keep(rows.withColumn("_w", F.coalesce(F.lit(1) if weight is None else weight, F.lit(0)).cast("long")))
    sums = sorted(tuple(r) for r in rows.groupBy("_part").agg(F.sum("_w")).collect())  # a row a range
    starts = accumulate([0, *(n for _, n in sums)])
    table = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sums, starts)], "_part int, _start long")
    if weight is None:  # places within a partition are numbered as they are written: no window
        within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    else:
        within = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", within).join(F.broadcast(table), "_part").withColumn(to, F.col("_start") + F.col("_in")).drop("_part", "_at", "_w", "_in", "_start")
