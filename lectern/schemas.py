"""Schemas of the engine's relations. Every relation is typed here; nothing is inferred."""

BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"
FILES = "rel_path string, parts array<string>, stem string, ext string, format string, mtime double, length long"
PROGRESS = "rel_path string, mtime double, output string"
BLOCKS = "rel_path string, seq long, kind string, level int, text string, grid array<array<string>>"
CELLS = "rel_path string, sheet_no long, sheet string, row_no long, values array<string>"
PAGES = "rel_path string, page long, text string, width double, height double"
SPANS = f"rel_path string, page long, seq long, block_type int, text string, font string, bbox {BBOX}, line_bbox {BBOX}, page_width double, page_height double"
FORMULAS = f"rel_path string, formula_idx long, kind string, omml string, page long, bbox {BBOX}, is_inline boolean, context string, image_ref string"
ASSETS = "rel_path string, asset_idx long, ref string, ext string, bytes binary, width int, height int, page long, xref long"
DOCS = "rel_path string, format string, markdown string, is_scanned boolean, error string"
LINT_RESULTS = "rel_path string, fixed_count long, remaining_failures array<string>, fast_mode boolean"
MANIFEST = "path string, title string, group string, headings array<string>, word_count long"
REPLIES = "status string, text string, prompt_tokens long, completion_tokens long, cost double"
