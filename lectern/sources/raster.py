"""Pictures of pages and formula regions, by a backend that the caller brings.

A backend is a function (content, page, clip, dpi) -> bytes or None: the file's bytes, a page from 1, a box in points or
None for the whole page. Without one, pictures are missing and what would have needed them stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import asset_dir
from lectern.operators.formulas import clip_box
from lectern.sources.doctree import with_content

Raster = Callable[[bytes, int, "tuple[float, float, float, float] | None", int], "bytes | None"]
SCANNED_DPI, BLANK_DPI, FORMULA_DPI = 200, 150, 200


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pictures wanted of pages without text. pages: rel_path, page, text, is_scanned, ref."""
    dpi = F.when(F.col("is_scanned"), SCANNED_DPI).otherwise(BLANK_DPI)
    return pages.where("text = ''").select("rel_path", "page", "ref", F.lit(None).cast(schemas.BBOX).alias("clip"), dpi.alias("dpi"))


def formula_regions(formulas: DataFrame, pages: DataFrame) -> DataFrame:
    """Pictures wanted of regions, with formula_idx; regions without extent are left out. pages: rel_path, page, width, height."""
    r = formulas.where("kind = 'region'").join(pages.select("rel_path", "page", "width", "height"), ["rel_path", "page"])
    name = F.concat(F.lit("formulas/"), F.regexp_replace(asset_dir("rel_path"), r"[()\[\]]", "_"), F.lit("/page"), F.col("page").cast("string"), F.lit("_formula"), F.col("formula_idx").cast("string"), F.lit(".png"))
    return r.select("rel_path", "page", "formula_idx", name.alias("ref"), clip_box("bbox", "width", "height").alias("clip"), F.lit(FORMULA_DPI).alias("dpi")).where("clip IS NOT NULL")


def render(files: DataFrame, root: str, wanted: DataFrame, raster: Raster) -> DataFrame:
    """rel_path, ref, ext, bytes of the pictures that the backend makes; each file is read once for all of its pictures."""
    per_file = wanted.groupBy("rel_path").agg(F.collect_list(F.struct("page", "ref", "clip", "dpi")).alias("wanted"))
    content = with_content(files.join(per_file.select("rel_path"), "rel_path", "left_semi"), root)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for rel, data, todo in zip(*(b.column(c).to_pylist() for c in ("rel_path", "content", "wanted"))):
                for w in todo if data is not None else []:
                    clip = w["clip"] and tuple(w["clip"][k] for k in ("x0", "y0", "x1", "y1"))
                    try:
                        got = raster(data, w["page"], clip, w["dpi"])
                    except Exception:  # noqa: BLE001  a page that can't be drawn has no picture
                        got = None
                    if got is not None:
                        out.append((rel, w["ref"], ".png", got))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["rel_path", "ref", "ext", "bytes"])

    return content.join(per_file, "rel_path").select("rel_path", "content", "wanted").mapInArrow(run, "rel_path string, ref string, ext string, bytes binary")
