"""Images of documents: which are kept, and which drawing they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

LEAST_SIDE, SCANNED = 50, 0.8


def first_by_xref(images: DataFrame, key: str, xref: str, order: list[str]) -> DataFrame:
    """Each object's first placement in its document, with a running number."""
    first = F.row_number().over(Window.partitionBy(key, xref).orderBy(*order))
    return images.withColumn("_n", first).where("_n = 1").drop("_n")


def large_enough(width: str = "width", height: str = "height") -> Column:
    return (F.col(width) >= LEAST_SIDE) & (F.col(height) >= LEAST_SIDE)


def embedded_images(images: DataFrame) -> DataFrame:
    """rel_path, page, pos, xref, asset_idx of the embedded images that are kept: the first placement, if large enough."""
    kept = first_by_xref(images, "rel_path", "xref", ["page", "pos", "width", "height"]).where(large_enough())
    return kept.withColumn("asset_idx", (F.row_number().over(Window.partitionBy("rel_path").orderBy("page", "pos", "xref")) - 1).cast("long"))


def blank(text: Column) -> Column:
    """Whether a page's text is nothing but white space of any kind."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def scanned(pages: DataFrame, key: str = "rel_path", text: str = "text") -> DataFrame:
    """key, pages, blank_ratio, is_scanned: at least 0.8 of the pages without text."""
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.avg(blank(F.col(text)).cast("double")).alias("blank_ratio")).withColumn("is_scanned", F.col("blank_ratio") >= SCANNED)


def pair_by_order(places: DataFrame, images: DataFrame, key: str, place: str, image: str) -> DataFrame:
    """key, n, place, image: the n-th place gets the n-th image; images beyond the last place have none, and the reverse."""
    p = places.select(key, place).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(place)))
    i = images.select(key, image).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(image)))
    return p.join(i, [key, "n"], "full")
