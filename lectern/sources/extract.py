"""Files to relations: one row a file with what its reader found, written once; relations are cut from it natively.

A file that can't be read is a row with an error and nothing else; it never fails a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import asset_dir, strip
from lectern.operators import assets as A
from lectern.operators import formulas as M
from lectern.operators.tables import blocks_to_markdown, sheets_to_markdown
from lectern.sources.doctree import BATCH_BYTES

_BLOCK = "struct<seq: long, kind: string, level: int, text: string, grid: array<array<string>>>"
_FORMULA = "struct<formula_idx: long, omml: string, is_inline: boolean, context: string>"
_ASSET = "struct<asset_idx: long, ref: string, ext: string, bytes: binary>"
_CELL = "struct<sheet_no: long, sheet: string, row_no: long, values: array<string>>"
_PAGE = "struct<page: long, text: string, width: double, height: double>"
_SPAN = f"struct<page: long, seq: long, block_type: int, text: string, font: string, bbox: {schemas.BBOX}, line_bbox: {schemas.BBOX}, page_width: double>"
_IMAGE = "struct<page: long, pos: long, xref: long, width: int, height: int, ext: string, bytes: binary>"
EXTRACTED = f"rel_path string, format string, error string, blocks array<{_BLOCK}>, formulas array<{_FORMULA}>, assets array<{_ASSET}>, cells array<{_CELL}>, pages array<{_PAGE}>, spans array<{_SPAN}>, images array<{_IMAGE}>"


def _office(found) -> dict:
    return {
        "blocks": [{"seq": i, "kind": k, "level": n, "text": t, "grid": g} for i, (k, n, t, g) in enumerate(found.blocks)],
        "formulas": [{"formula_idx": i, "omml": x, "is_inline": inline, "context": c} for i, (x, inline, c) in enumerate(found.formulas)],
        "assets": [{"asset_idx": i, "ref": r, "ext": e, "bytes": b} for i, (r, e, b) in enumerate(found.assets)],
        "cells": [{"sheet_no": n, "sheet": s, "row_no": r, "values": v} for n, s, r, v in found.cells],
    }


def _pdf(content: bytes) -> dict:
    from lectern.sources.pdf import read_pdf

    box = lambda x0, y0, x1, y1: {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    pages, spans, images = [], [], []
    for n, p in enumerate(read_pdf(content), 1):
        pages.append({"page": n, "text": p.text, "width": p.width, "height": p.height})
        for line in p.lines:
            around = box(min(s.x0 for s in line), min(s.y0 for s in line), max(s.x1 for s in line), max(s.y1 for s in line))
            spans += [{"page": n, "seq": len(spans) + i, "block_type": 0, "text": s.text, "font": s.font, "bbox": box(s.x0, s.y0, s.x1, s.y1), "line_bbox": around, "page_width": p.width} for i, s in enumerate(line)]
        images += [{"page": n, "pos": i, "xref": x.xref, "width": x.width, "height": x.height, "ext": x.ext, "bytes": x.data} for i, x in enumerate(p.images)]
    return {"pages": pages, "spans": spans, "images": images}


def extract(files: DataFrame, compat: bool = False) -> DataFrame:
    """Schema EXTRACTED of files (rel_path, format, ext, content, error)."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(EXTRACTED))

    def run(batches):
        import pyarrow as pa

        from lectern.sources.ooxml import read_docx, read_pptx, read_xlsx

        readers = {"docx": lambda c: _office(read_docx(c, compat)), "pptx": lambda c: _office(read_pptx(c)), "xlsx": lambda c: _office(read_xlsx(c)), "pdf": _pdf}
        empty = {f.name: [] for f in schema if f.name not in ("rel_path", "format", "error")}
        for b in batches:
            rows, held = [], 0
            for rel, fmt, ext, content, error in zip(*(b.column(c).to_pylist() for c in ("rel_path", "format", "ext", "content", "error"))):
                row = dict(empty)
                if error is None:
                    try:
                        row |= readers[fmt](content) if fmt in readers else {"assets": [{"asset_idx": 0, "ref": rel.rpartition("/")[2], "ext": ext, "bytes": content}]}
                    except Exception as e:  # noqa: BLE001  whatever a broken file raises is that file's error
                        error, row = f"{type(e).__name__}: {e}", dict(empty)
                rows.append(row | {"rel_path": rel, "format": fmt, "error": error})
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("rel_path", "format", "ext", "content", "error").mapInArrow(run, EXTRACTED)


def _explode(x: DataFrame, column: str) -> DataFrame:
    return x.select("rel_path", "format", F.explode(column).alias("_x")).select("rel_path", "format", "_x.*")


def _ref(path, name):
    """Where an asset of a file lies; brackets in paths can't end a reference early, since only the hashed folder is used."""
    return F.concat(F.lit("images/"), F.regexp_replace(asset_dir(path), r"[()\[\]]", "_"), F.lit("/"), name)


def asset_table(x: DataFrame, drawn: bool = False) -> DataFrame:
    """rel_path, ref, ext, bytes of all assets: extracted pictures, kept embedded images of PDF files and, unless pages are
    drawn elsewhere, the largest image of each page of a scanned one."""
    own = _explode(x, "assets").select("rel_path", _ref(F.col("rel_path"), F.regexp_replace("ref", r"[()\[\]]", "_")).alias("ref"), "ext", "bytes")
    kept = A.embedded_images(_explode(x, "images"))
    name = F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_img"), F.col("asset_idx").cast("string"), F.lit("."), F.col("ext"))
    embedded = kept.select("rel_path", _ref(F.col("rel_path"), name).alias("ref"), F.concat(F.lit("."), F.col("ext")).alias("ext"), "bytes")
    if drawn:
        return own.unionByName(embedded)
    pages = x.where((F.col("format") == "pdf") & _scanned_flag()).select("rel_path", "images", F.explode("pages.page").alias("page"))
    pages = pages.select("rel_path", "page", _largest(F.col("images"), F.col("page")).alias("top")).where("top IS NOT NULL")
    shots = pages.select("rel_path", _shot(F.col("page"), F.col("top")["ext"]).alias("ref"), F.concat(F.lit("."), F.col("top")["ext"]).alias("ext"), F.col("top")["bytes"].alias("bytes"))
    return own.unionByName(embedded).unionByName(shots)


def _largest(images, page):
    """The image of a page with the most points, of equal ones the first; null without a usable one."""
    there = F.filter(images, lambda i: (i["page"] == page) & i["ext"].isin("png", "jpeg") & (i["width"] >= A.LEAST_SIDE) & (i["height"] >= A.LEAST_SIDE))
    order = F.transform(there, lambda i, k: F.struct((-i["width"].cast("long") * i["height"]).alias("size"), k.alias("k"), i["ext"].alias("ext"), i["bytes"].alias("bytes")))
    return F.get(F.array_sort(order), F.lit(0))


def _shot(page, ext):
    """Where a picture of a page lies."""
    return _ref(F.col("rel_path"), F.concat(F.lit("page"), page.cast("string"), F.lit("."), F.coalesce(ext, F.lit("png"))))


def formula_table(x: DataFrame) -> DataFrame:
    """Formulas of Office files (OMML) and of PDF files (regions, without a picture here)."""
    office = _explode(x, "formulas").select("rel_path", "formula_idx", F.lit("omml").alias("kind"), "omml", F.lit(None).cast("long").alias("page"), F.lit(None).cast(schemas.BBOX).alias("bbox"), "is_inline", "context", F.lit(None).cast("string").alias("image_ref"))
    spans = _explode(x.where(~_scanned_flag()), "spans")
    found = M.region_context(M.regions(spans), spans).select("rel_path", "formula_idx", F.lit("region").alias("kind"), F.lit(None).cast("string").alias("omml"), "page", "bbox", "is_inline", "context", F.lit(None).cast("string").alias("image_ref"))
    return office.unionByName(found)


def page_table(x: DataFrame, drawn: bool = False) -> DataFrame:
    """rel_path, page, text (stripped), width, height, is_scanned, ref (where a picture of the page lies) of PDF pages."""
    pages = x.where("format = 'pdf'").select("rel_path", _scanned_flag().alias("is_scanned"), "images", F.explode("pages").alias("p"))
    ext = F.when(F.col("is_scanned") & F.lit(not drawn), _largest(F.col("images"), F.col("p.page"))["ext"])
    pages = pages.select("rel_path", "is_scanned", ext.alias("_ext"), "p.*")
    return pages.withColumn("text", strip("text")).withColumn("ref", _shot(F.col("page"), F.col("_ext"))).drop("_ext")


def _scanned_flag():
    blank = F.size(F.filter("pages", lambda p: A.blank(p["text"])))
    return (F.size("pages") > 0) & (blank >= A.SCANNED * F.size("pages"))


def to_markdown(x: DataFrame, drawn: bool = False) -> DataFrame:
    """Schema DOCS of extracted files; files with errors are left out."""
    x = x.where("error IS NULL")
    ok = x.select("rel_path", "format")
    blocks = _explode(x.where(F.col("format").isin("docx", "pptx")), "blocks")
    named = F.when(F.col("kind") == "image", _ref(F.col("rel_path"), F.col("text"))).otherwise(F.col("text"))
    office = blocks_to_markdown(blocks.withColumn("text", named))
    sheets = sheets_to_markdown(_explode(x.where("format = 'xlsx'"), "cells"))
    pictures = x.where("format = 'image'").select("rel_path", F.concat(F.lit("![image]("), _ref(F.col("rel_path"), F.regexp_replace(F.col("assets")[0]["ref"], r"[()\[\]]", "_")), F.lit(")\n")).alias("markdown"))
    # PDF: page texts with markers for regions, or one reference for each page without text.
    pdf = x.where("format = 'pdf'").withColumn("is_scanned", _scanned_flag())
    pages = page_table(x, drawn)
    marked = M.insert_markers(pages.where("NOT is_scanned AND text <> ''").select("rel_path", "page", "text", "height"), M.regions(_explode(x.where(~_scanned_flag()), "spans")))
    body = pages.join(marked.withColumnRenamed("text", "marked"), ["rel_path", "page"], "left")
    shot = lambda kind: F.concat(F.lit(f"\n![{kind}]("), F.col("ref"), F.lit(")\n"))
    head = F.concat(F.lit("\n## Page "), F.col("page").cast("string"), F.lit("\n"))
    own = F.when(F.col("text") != "", F.coalesce("marked", "text")).otherwise(F.when(F.col("is_scanned"), shot("ocr")).otherwise(shot("image")))
    rows = body.select("rel_path", "page", F.lit(0).cast("long").alias("k"), F.concat_ws("\n", head, own).alias("text"))
    kept = A.embedded_images(_explode(x.where(~_scanned_flag()), "images"))
    name = F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_img"), F.col("asset_idx").cast("string"), F.lit("."), F.col("ext"))
    pics = kept.select("rel_path", "page", (F.col("asset_idx") + 1).alias("k"), F.concat(F.lit("\n![image]("), _ref(F.col("rel_path"), name), F.lit(")\n")).alias("text"))
    joined = rows.unionByName(pics).groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "k", "text"))), lambda s: s["text"]), "\n").alias("markdown"))
    text = office.unionByName(sheets).unionByName(pictures).unionByName(joined)
    flags = pdf.select("rel_path", "is_scanned")
    out = ok.join(text, "rel_path", "left").join(flags, "rel_path", "left")
    return out.select("rel_path", "format", F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("is_scanned", F.lit(False)).alias("is_scanned"), F.lit(None).cast("string").alias("error"))
