"""Scalar functions over text columns. All are built-in expressions; none needs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.patterns import FORMULA_REF, HEADING, IMAGE_REF, LINE_END, OCR_REF, RARE_LINE_ENDS, RARE_WS, WORD, WS, WS_CHARS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(x) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def has_any(x, parts) -> Column:
    """Whether a text has one of the given strings. Searches for bytes are several times faster than one for a pattern."""
    return reduce(lambda p, q: p | q, [_c(x).contains(s) for s in parts])


def has_any_char(x, chars: str) -> Column:
    """has_any for single characters: those beyond ASCII are only looked for in texts that aren't plain ASCII."""
    text, low, high = _c(x), [c for c in chars if c < "\x80"], [c for c in chars if c >= "\x80"]
    return has_any(text, low) | ((F.octet_length(text) != F.length(text)) & has_any(text, high))


def without_images(x) -> Column:
    """Without image references; a reference ends at its first closing bracket."""
    return F.regexp_replace(_c(x), IMAGE_REF, "")


def count_words(x) -> Column:
    """Runs of letters, digits and underscores."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(WORD), F.lit(0))).cast("long")


def count_tokens(x) -> Column:
    """Runs without white space. In most texts only line feeds and spaces part them, which takes no pattern."""
    filled = lambda words: F.size(F.filter(words, lambda w: w != ""))

    def spaced(t: Column) -> Column:
        single = F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
        return F.when(t.contains("  "), filled(F.split(t, " ", -1))).otherwise(single)

    plain = lambda t: let(F.trim(F.replace(t, F.lit("\n"), F.lit(" "))), spaced)
    return F.when(has_any_char(x, RARE_WS), filled(F.split(_c(x), f"{WS}+", -1))).otherwise(plain(_c(x))).cast("long")


def headings(x, most: int | None = 20) -> Column:
    """Texts of headings of level 1 to 3, the first ``most``. White space after the marks may run into the next line."""
    found = F.regexp_extract_all(_c(x), F.lit(HEADING), F.lit(1))
    return found if most is None else F.slice(found, 1, most)


def lines(x) -> Column:
    """Lines by any line end; a line end at the very end starts no line."""
    cut = lambda got: F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)
    return let(F.when(has_any_char(x, RARE_LINE_ENDS), F.split(_c(x), LINE_END, -1)).otherwise(F.split(_c(x), "\n", -1)), cut)


def title(x, otherwise, within: int = 20) -> Column:
    """The first level-1 heading among the first lines, else ``otherwise``."""
    found = F.filter(F.slice(F.split(_c(x), LINE_END, within + 1), 1, within), lambda line: line.startswith("# "))
    return F.when(_c(x).contains("# "), F.coalesce(let(found, lambda got: strip(F.substring(F.get(got, 0), 3, 1 << 30))), _c(otherwise))).otherwise(_c(otherwise))


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/", -1), -1)


def suffix(path) -> Column:
    """From the last dot on, with the dot; a name that begins or ends with its only dot has none."""
    return F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(path) -> Column:
    """The name without its suffix."""
    name = file_name(path)
    return F.when(suffix(path) == "", name).otherwise(F.regexp_extract(name, r"(?s)\A(.+)\.[^.]+\z", 1))


def with_suffix(path, new: str) -> Column:
    """The path with its suffix replaced."""
    p = _c(path)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(suffix(path))), F.lit(new))


def path_parts(path) -> Column:
    """The parts of a path: the order of files is the order of these arrays."""
    return F.split(_c(path), "/", -1)


def top_group(path) -> Column:
    """The first directory, or Root for a file at the top."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("Root"))


def asset_dir(path) -> Column:
    """Name of the folder for a file's images: shortened stem and a hash of the path."""
    return F.concat(F.translate(F.substring(stem(path), 1, 40), " ", "_"), F.lit("_"), F.substring(F.md5(_c(path)), 1, 8))


def formula_refs(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(FORMULA_REF), F.lit(1))


def ocr_refs(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(OCR_REF), F.lit(1))


def image_refs(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(IMAGE_REF), F.lit(1))


def is_sentinel(x, word: str) -> Column:
    """Whether a reply is nothing but the given word."""
    return F.upper(strip(x)) == word


def unwrap_reply(x) -> Column:
    """A formula reply without code fence, dollar signs and white space around it."""
    t = strip(x)
    rows = F.split(t, "\n", -1)
    inner = F.when(F.element_at(rows, -1).startswith("```"), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 2, F.lit(0)))).otherwise(F.slice(rows, F.lit(2), F.size(rows) - 1))
    t = F.when(t.startswith("```"), F.array_join(inner, "\n")).otherwise(t)
    return strip(F.regexp_replace(strip(t), r"\A\$+|\$+\z", ""))


#: Media types by file ending, and endings by media type.
IMAGE_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff"}
FORMULA_MIME = {k: IMAGE_MIME[k] for k in ("jpg", "jpeg", "png", "gif")}
IMAGE_ENDING = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff"}
#: Formats by suffix.
FORMATS = {".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".pdf": "pdf", ".jpg": "image", ".jpeg": "image", ".png": "image"}
SKIPPED_DIRS = (".git",)


def lookup(table: dict[str, str], key, default: str | None = None) -> Column:
    """The table's value for a key."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    got = F.element_at(pairs, _c(key))
    return got if default is None else F.coalesce(got, F.lit(default))


def media_type(path, table: dict[str, str] = IMAGE_MIME) -> Column:
    return lookup(table, F.lower(F.regexp_replace(suffix(path), r"^\.", "")), "image/png")


def format_of(path) -> Column:
    """The format that a path's suffix stands for, or null."""
    return lookup(FORMATS, F.lower(suffix(path)))
