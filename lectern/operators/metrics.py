"""Totals of a run, from tables of facts rather than counters that a retried task would raise twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_totals(calls: DataFrame) -> DataFrame:
    """calls, prompt_tokens, completion_tokens, total_tokens, cost over model calls."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg(F.count("*").alias("calls"), n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"), n(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"), F.round(n("cost"), 4).alias("cost"))


def reply_outcomes(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """extracted, blank, failed, chars over replies."""
    r = F.col(reply)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return replies.agg(n(F.coalesce(r != "", F.lit(False))).alias("extracted"), n(F.coalesce(r == "", F.lit(False))).alias("blank"), n(r.isNull()).alias("failed"), F.coalesce(F.sum(F.length(r).cast("long")), F.lit(0)).alias("chars"))


def step_deltas(before: DataFrame, after: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """key, chars, delta of each document over a step: characters after it, and how many it took or added."""
    b = before.select(key, F.length(text).cast("long").alias("was"))
    return after.select(key, F.length(text).cast("long").alias("chars")).join(b, key).select(key, "chars", (F.col("chars") - F.col("was")).alias("delta"))
