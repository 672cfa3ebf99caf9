"""Readers of Word, PowerPoint and Excel files with the standard library: zip archives of XML.

They emit typed rows (blocks, formulas, assets, cells); Markdown is made from the rows by ``lectern.operators.tables``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from lectern.functions.text import IMAGE_ENDING

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
CONTEXT = 200


@dataclass
class Extracted:
    """Rows of one file: blocks (kind, level, text, grid), formulas (omml, is_inline, context), assets (ref, ext, bytes)."""

    blocks: list[tuple] = field(default_factory=list)
    formulas: list[tuple] = field(default_factory=list)
    assets: list[tuple] = field(default_factory=list)
    cells: list[tuple] = field(default_factory=list)

    def add(self, kind: str, text: str = "", level: int = 0, grid: list | None = None) -> None:
        self.blocks.append((kind, level, text, grid))

    def formula(self, element: ET.Element, inline: bool, context: str) -> str:
        self.formulas.append((ET.tostring(element, encoding="unicode"), inline, context))
        return f"<<FORMULA:{len(self.formulas) - 1}>>"


class Package:
    """Parts of an archive and the relations between them."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.types, self.endings = {}, {}
        if "[Content_Types].xml" in self.names:
            root = self.xml("[Content_Types].xml")
            self.types = {x.get("PartName", "").lstrip("/"): x.get("ContentType", "") for x in root.iter(CT + "Override")}
            self.endings = {x.get("Extension", "").lower(): x.get("ContentType", "") for x in root.iter(CT + "Default")}

    def xml(self, part: str) -> ET.Element:
        return ET.fromstring(self.zip.read(part))

    def relations(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, type, target, external) in file order; targets inside the package are full part names."""
        folder, name = posixpath.split(part)
        source = posixpath.join(folder, "_rels", name + ".rels")
        if source not in self.names:
            return []
        out = []
        for r in self.xml(source).iter(REL + "Relationship"):
            external, target = r.get("TargetMode") == "External", r.get("Target", "")
            if not external:
                target = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
            out.append((r.get("Id", ""), r.get("Type", ""), target, external))
        return out

    def content_type(self, part: str) -> str:
        return self.types.get(part) or self.endings.get(part.rpartition(".")[2].lower(), "")


def _formulas(element: ET.Element) -> tuple[list[ET.Element], list[ET.Element]]:
    """Display formulas, and inline ones (those that aren't right inside a display formula)."""
    display = list(element.iter(M + "oMathPara"))
    inside = {id(x) for d in display for x in d if x.tag == M + "oMath"}
    return display, [x for x in element.iter(M + "oMath") if id(x) not in inside]


# Word -----------------------------------------------------------------------------------------------------------------


def _run_text(run: ET.Element) -> str:
    out = []
    for x in run:
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif x.tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _paragraph_text(p: ET.Element) -> str:
    """Text of the runs of a paragraph, also of those in hyperlinks."""
    out = []
    for x in p:
        if x.tag == W + "r":
            out.append(_run_text(x))
        elif x.tag == W + "hyperlink":
            out += [_run_text(r) for r in x if r.tag == W + "r"]
    return "".join(out)


def _word_table(tbl: ET.Element) -> list[list[str]]:
    """Cells with merged ones repeated over what they span."""
    rows: list[list[str]] = []
    for tr in tbl.findall(W + "tr"):
        row: list[str] = []
        for tc in tr.findall(W + "tc"):
            props = tc.find(W + "tcPr")
            span, merge = 1, None
            if props is not None:
                if (g := props.find(W + "gridSpan")) is not None:
                    span = int(g.get(W + "val", "1"))
                merge = props.find(W + "vMerge")
            text = "\n".join(_paragraph_text(p) for p in tc.findall(W + "p"))
            if merge is not None and merge.get(W + "val") != "restart" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * span
        rows.append(row)
    return rows


def read_docx(content: bytes, compat: bool = False) -> Extracted:
    """Body paragraphs and tables in order. A drawing's image is the one it names; compat: the next in relation order."""
    pkg, out = Package(content), Extracted()
    part = next((t for _, kind, t, ext in pkg.relations("") or [] if kind.endswith("/officeDocument") and not ext), "word/document.xml")
    images, order = {}, []
    for i, (rid, kind, target, external) in enumerate(pkg.relations(part)):
        if "image" in kind and not external and target in pkg.names:
            ext = posixpath.splitext(target)[1]
            images[rid] = f"img_{i}{ext}"
            order.append(rid)
            out.assets.append((images[rid], ext, pkg.zip.read(target)))
    styles = {}
    folder = posixpath.dirname(part)
    if f"{folder}/styles.xml" in pkg.names:
        for s in pkg.xml(f"{folder}/styles.xml").iter(W + "style"):
            name = s.find(W + "name")
            styles[s.get(W + "styleId")] = name.get(W + "val", "") if name is not None else ""
    used: list[str] = []
    body = pkg.xml(part).find(W + "body")
    for element in body if body is not None else []:
        if element.tag == W + "tbl":
            out.add("merged_table", grid=_word_table(element))
            continue
        if element.tag != W + "p":
            continue
        drawn = [x for x in element.iter() if x.tag in (W + "drawing", W + "pict")]
        if drawn and compat:
            if len(used) < len(order):
                used.append(order[len(used)])
                out.add("image", images[used[-1]])
        elif drawn:
            for d in drawn:
                for x in d.iter():
                    rid = x.get(R + "embed") or x.get(R + "id")
                    if rid in images:
                        used.append(rid)
                        out.add("image", images[rid])
        plain = _paragraph_text(element).strip()
        text = plain
        display, inline = _formulas(element)
        if display or inline:
            marks = [out.formula(x, False, plain[:CONTEXT]) for x in display] + [out.formula(x, True, plain[:CONTEXT]) for x in inline]
            if display and compat:
                text = marks[0]
            elif display:  # the words first, then each formula on its own line
                text = "\n".join([plain, *marks] if plain else marks)
            else:
                rest, parts = iter(marks), []
                for x in element:
                    if x.tag == W + "r":
                        parts.append("".join(t.text or "" for t in x.findall(W + "t")))
                    elif x.tag == M + "oMath" and (mark := next(rest, None)):
                        parts.append(f" {mark} ")
                text = "".join(parts).strip() or plain
        if not text:
            continue
        props = element.find(f"{W}pPr/{W}pStyle")
        style = styles.get(props.get(W + "val"), "") if props is not None else ""
        level = next((n for n in (1, 2, 3) if f"heading {n}" in style.lower()), 0)
        out.add("heading" if level else "para", text, level)
    for rid in order:
        if rid not in used:
            out.add("image", images[rid])
    return out


# PowerPoint -----------------------------------------------------------------------------------------------------------


def _frame_paragraphs(body: ET.Element) -> list[str]:
    out = []
    for p in body.findall(A + "p"):
        parts = []
        for x in p:
            if x.tag in (A + "r", A + "fld"):
                parts.append("".join(t.text or "" for t in x.findall(A + "t")))
            elif x.tag == A + "br":
                parts.append("\v")
        out.append("".join(parts))
    return out


def _shapes(tree: ET.Element):
    """Shapes of a tree, depth first through groups."""
    for x in tree:
        if x.tag == P + "grpSp":
            yield from _shapes(x)
        elif x.tag in (P + "sp", P + "pic", P + "graphicFrame"):
            yield x


def _marked_frame(out: Extracted, body: ET.Element, display: list, inline: list, slide: int) -> str:
    """A text frame with formulas: its text with the inline markers after it, then the display markers. Text beside display
    formulas alone is dropped, and so are inline markers without text."""
    texts = [t.strip() for t in _frame_paragraphs(body)]
    context = f"[Slide {slide}] {chr(10).join(_frame_paragraphs(body)).strip()[:CONTEXT]}"
    own = [out.formula(x, False, context) for x in display]
    seen: dict[str, str] = {}
    after = [seen.setdefault(ET.tostring(x, encoding="unicode"), mark) for x, mark in [(x, out.formula(x, True, context)) for x in inline]]
    texts = [t for t in texts if t]
    if after and texts:
        return "\n".join([" ".join(["\n".join(texts), *after]), *own])
    return "\n".join(own or texts)


def read_pptx(content: bytes) -> Extracted:
    """Slides in order: shapes through groups, pictures as assets, tables, speaker notes."""
    pkg, out = Package(content), Extracted()
    part = next((t for _, kind, t, ext in pkg.relations("") if kind.endswith("/officeDocument") and not ext), "ppt/presentation.xml")
    targets = {rid: t for rid, _, t, _ in pkg.relations(part)}
    slides = [targets.get(x.get(R + "id", "")) for x in pkg.xml(part).iter(P + "sldId")]
    pictures = 0
    for n, slide in enumerate((s for s in slides if s in pkg.names), 1):
        out.add("slide", str(n))
        relations = pkg.relations(slide)
        by_id = {rid: t for rid, _, t, ext in relations if not ext}
        tree = pkg.xml(slide).find(f"{P}cSld/{P}spTree")
        for shape in _shapes(tree if tree is not None else []):
            if shape.tag == P + "pic":
                blip = shape.find(f".//{A}blip")
                target = by_id.get(blip.get(R + "embed", "")) if blip is not None else None
                if target in pkg.names:
                    ext = IMAGE_ENDING.get(pkg.content_type(target), ".png")
                    ref = f"slide{n}_img{pictures}{ext}"
                    out.assets.append((ref, ext, pkg.zip.read(target)))
                    out.add("image", ref)
                    pictures += 1
            elif shape.tag == P + "sp" and (body := shape.find(P + "txBody")) is not None:
                display, inline = _formulas(body)
                if display or inline:
                    text = _marked_frame(out, body, display, inline, n)
                    if text:
                        out.add("para", text)
                else:
                    for t in _frame_paragraphs(body):
                        if t.strip():
                            out.add("para", t.strip())
            elif shape.tag == P + "graphicFrame" and (tbl := shape.find(f".//{A}tbl")) is not None:
                cell = lambda tc: "\n".join(_frame_paragraphs(b)) if (b := tc.find(A + "txBody")) is not None else ""
                out.add("table", grid=[[cell(tc) for tc in tr.findall(A + "tc")] for tr in tbl.findall(A + "tr")])
        notes = next((t for _, kind, t, ext in relations if kind.endswith("/notesSlide") and not ext), None)
        if notes in pkg.names:
            for sp in pkg.xml(notes).iter(P + "sp"):
                place = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                body = sp.find(P + "txBody")
                if place is not None and place.get("type") == "body" and body is not None:
                    text = "\n".join(_frame_paragraphs(body)).strip()
                    if text:
                        out.add("notes", text)
                    break
    return out


# Excel ----------------------------------------------------------------------------------------------------------------

_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(raw: str, date: bool, base: datetime) -> str:
    x = float(raw)
    if date:
        days, part = divmod(x, 1)
        at = base + timedelta(days=days, seconds=round(part * 86400))
        return str(at) if days else str(at.time())
    return str(int(x)) if re.fullmatch(r"[+-]?\d+", raw) else str(x)


def read_xlsx(content: bytes) -> Extracted:
    """Cells of all sheets by their cached values, as text; a sheet without cells has one row without values."""
    pkg, out = Package(content), Extracted()
    part = next((t for _, kind, t, ext in pkg.relations("") if kind.endswith("/officeDocument") and not ext), "xl/workbook.xml")
    folder, targets = posixpath.dirname(part), {rid: t for rid, _, t, _ in pkg.relations(part)}
    strings: list[str] = []
    if f"{folder}/sharedStrings.xml" in pkg.names:
        for si in pkg.xml(f"{folder}/sharedStrings.xml").findall(S + "si"):
            strings.append("".join(t.text or "" for x in si if x.tag in (S + "t", S + "r") for t in ([x] if x.tag == S + "t" else x.findall(S + "t"))))
    dates: list[bool] = []
    if f"{folder}/styles.xml" in pkg.names:
        styles = pkg.xml(f"{folder}/styles.xml")
        own = {int(x.get("numFmtId", "0")): x.get("formatCode", "") for x in styles.iter(S + "numFmt")}
        is_date = lambda n: n in _DATES or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "")), re.I))
        dates = [is_date(int(x.get("numFmtId", "0"))) for x in styles.findall(f"{S}cellXfs/{S}xf")]
    book = pkg.xml(part)
    props = book.find(S + "workbookPr")
    base = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    for no, sheet in enumerate(book.iter(S + "sheet")):
        name, target = sheet.get("name", ""), targets.get(sheet.get(R + "id", ""))
        empty = True
        if target in pkg.names:
            with pkg.zip.open(target) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != S + "row":
                        continue
                    values: list[str | None] = []
                    for c in row.findall(S + "c"):
                        at = _column(c.get("r", "")) if c.get("r") else len(values)
                        values += [None] * (at - len(values))
                        kind, v = c.get("t"), c.find(S + "v")
                        raw = v.text if v is not None else None
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter(S + "t"))
                        elif raw is None:
                            value = None
                        elif kind == "s":
                            value = strings[int(raw)]
                        elif kind == "b":
                            value = str(raw == "1")
                        elif kind in ("str", "e", "d"):
                            value = raw
                        else:
                            style = int(c.get("s", "0"))
                            value = _number(raw, style < len(dates) and dates[style], base)
                        values.append(value)
                    out.cells.append((no, name, int(row.get("r", len(out.cells) + 1)), values))
                    empty = False
                    row.clear()
        if empty:
            out.cells.append((no, name, None, None))
    return out
