"""Connected components of an edge table by repeated hooking and contraction, without a driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge (a, b); comp is the smallest node of its component.

    Each round hooks every root to its smallest smaller neighbour, shortens the chains and contracts the edges, so that
    the number of roots with an edge at least halves. Loops and repeated edges are allowed; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    live = keep(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    label = keep(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    live = live.where("a <> b")
    while not live.isEmpty():
        hook = keep(live.groupBy("a").agg(F.min("b").alias("p")))
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        hook = keep(hook)
        to = hook.select(F.col("a").alias("comp"), "p")
        label = keep(label.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        low = hook.select(F.col("a").alias("b"), F.col("p").alias("q"))
        moved = live.join(hook, "a").select(F.col("p").alias("x"), "b").join(low, "b", "left").select("x", F.coalesce("q", "b").alias("y"))
        live = keep(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return label
