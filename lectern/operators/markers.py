"""Markers in texts and what replaces them, spliced by segments so that replacements are never read as patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import FORMULA_REF, IMAGE_REF, OCR_REF
from lectern.functions.text import let, strip, without_images

KINDS = {"formula": FORMULA_REF, "ocr": OCR_REF, "image": IMAGE_REF}
NO_KEY, FAILED = "[FORMULA: no API key]", "[FORMULA: conversion failed]"
AROUND = 200


def markers(docs: DataFrame, key: str, kind: str, text: str = "markdown") -> DataFrame:
    """key, ordinal (from 0), marker, ref: one row for each marker of a kind."""
    whole, ref = F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0)), F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(1))
    rows = docs.select(key, F.posexplode(F.arrays_zip(whole.alias("m"), ref.alias("r"))).alias("ordinal", "x"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.col("x.m").alias("marker"), F.col("x.r").alias("ref"))


def splice(docs: DataFrame, key: str, replaced: DataFrame, kind: str, text: str = "markdown") -> DataFrame:
    """docs with the markers of a kind replaced. replaced: key, ordinal, new; a null new keeps the marker, and of several for
    one marker the last by value counts."""
    pattern = KINDS[kind]
    news = replaced.groupBy(key, "ordinal").agg(F.max("new").alias("new")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "new"))).alias("_new"))
    out = docs.join(news, key, "left")
    segments = F.split(F.col(text), pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    put = F.transform(whole, lambda m, i: F.coalesce(F.element_at(F.col("_new"), i.cast("long")), m))
    woven = F.zip_with(segments, put, lambda s, m: F.concat(s, F.coalesce(m, F.lit(""))))
    return out.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.array_join(woven, ""))).drop("_new")


def formula_text(latex: Column, inline: Column, has_key: bool = True) -> Column:
    """LaTeX in its delimiters; a placeholder where there is none."""
    none = F.lit(FAILED if has_key else NO_KEY)
    return F.when(F.coalesce(latex, F.lit("")) == "", none).when(inline, F.concat(F.lit("$"), latex, F.lit("$"))).otherwise(F.concat(F.lit("\n$$\n"), latex, F.lit("\n$$\n")))


def ocr_text(reply: Column) -> Column:
    """Null keeps the marker, an empty reply removes it, any other takes its place."""
    return reply


def figure_text(reply: Column) -> Column:
    """Null keeps the reference, an empty reply removes it; a diagram stands as it is, other text as a figure."""
    t = strip(reply)
    return F.when(reply == "", "").when(t.startswith("```mermaid"), F.concat(F.lit("\n"), t, F.lit("\n"))).otherwise(F.concat(F.lit("\nFigure: "), t, F.lit("\n")))


def formula_lookup(docs: DataFrame, formulas: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """markers with their formulas' columns (null if the index is out of range)."""
    m = markers(docs, key, "formula", text).withColumn("formula_idx", F.col("ref").cast("long"))
    return m.join(formulas, [key, "formula_idx"], "left")


def contexts(docs: DataFrame, key: str, kind: str = "image", text: str = "markdown", around: int = AROUND) -> DataFrame:
    """key, ordinal, ref, context of every marker of a kind: the rule of context_around at each marker's own place.

    A marker has ten characters or more, so a few pieces on either side hold all that may be needed; no text is repeated. Most
    often the nearest ones do, and only where they fall short are more put together.
    """
    pattern, near, far = KINDS[kind], 4, around // 8 + 1
    left, right = lambda c: F.substring(c, -around, around), lambda c: F.substring(c, 1, around)
    cut = F.struct(F.split(F.col(text), pattern, -1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("r"))

    def sides(p: Column) -> Column:
        before = F.transform(p["m"], lambda m, i: F.concat(left(F.get(p["s"], i)), m))
        after = F.transform(p["m"], lambda m, i: F.concat(m, right(F.get(p["s"], i + 1))))
        return F.struct(before.alias("before"), after.alias("after"))

    def one(p: Column, q: Column, i: Column) -> Column:
        def back(k: int) -> Column:
            return F.concat(F.array_join(F.slice(q["before"], F.greatest(F.lit(0), i - k) + 1, F.least(i, F.lit(k))), ""), left(F.get(p["s"], i)))

        def on(k: int) -> Column:
            return F.concat(right(F.get(p["s"], i + 1)), F.array_join(F.slice(q["after"], i + 2, F.lit(k)), ""))

        before = let(back(near), lambda c: F.when((F.length(c) >= around) | (i <= near), c).otherwise(back(far)))
        after = let(on(near), lambda c: F.when((F.length(c) >= around) | (i + near >= F.size(p["m"]) - 1), c).otherwise(on(far)))
        return F.struct(F.get(p["r"], i).alias("ref"), strip(without_images(F.concat(left(before), right(after)))).alias("context"))

    found = let(cut, lambda p: let(sides(p), lambda q: F.transform(p["m"], lambda _, i: one(p, q, i))))
    rows = docs.select(key, F.posexplode(found).alias("ordinal", "x"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), "x.ref", "x.context")


def context_around(docs: DataFrame, key: str, marker: Column, text: str = "markdown", around: int = AROUND) -> DataFrame:
    """key, context: up to ``around`` characters on either side of a marker's first place, without image references."""
    d = docs.select(key, F.col(text).alias("t"), marker.alias("m")).withColumn("p", F.expr("cast(instr(t, m) AS int)")).where("p > 0")
    before = F.expr(f"substring(t, greatest(1, p - {around}), p - greatest(1, p - {around}))")
    after = F.expr(f"substring(t, p + length(m), {around})")
    return d.select(key, strip(without_images(F.concat(before, after))).alias("context"))


def existing(found: DataFrame, assets: DataFrame, *columns: str) -> DataFrame:
    """Markers whose reference is an asset, with the named columns of the asset; refs of assets are unique if there are any."""
    if columns:
        return found.join(assets.select("ref", *columns), "ref")
    return found.join(assets.select("ref").distinct(), "ref", "left_semi")
