"""Office and PDF files made by hand."""

import io
import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = W.replace("xmlns:w=", "xmlns:x=") + ' xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def relations(rows) -> str:
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"{x}/>' for i, k, t, x in rows) + "</Relationships>"


def p(text, style="", extra=""):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def docx() -> bytes:
    drawing = '<w:r><w:drawing><a:blip r:embed="rId3"/></w:drawing></w:r>'
    math = "<m:oMath><m:r><m:t>x</m:t></m:r></m:oMath>"
    cell = lambda t, props="": f"<w:tc>{props}{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("h1", "<w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>")}</w:tr><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl>'
    body = p("One", "H1") + p("Four", "H4") + p("see ", "", drawing) + table + p("let", "", math + "<w:r><w:t>be</w:t></w:r>") + p("before", "", f"<m:oMathPara>{math}</m:oMathPara>{math}") + p(" ")
    return package({
        "_rels/.rels": relations([("r1", "officeDocument", "word/document.xml", "")]),
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H4"><w:name w:val="heading 4"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": relations([("rId1", "styles", "styles.xml", ""), ("rId2", "image", "media/a.png", ""), ("rId3", "image", "media/b.jpeg", ""), ("rId4", "image", "http://x/y.png", ' TargetMode="External"')]),
        "word/media/a.png": b"A", "word/media/b.jpeg": b"B",
    })


def pptx() -> bytes:
    sp = lambda t, more="": f"<p:sp><p:txBody>{''.join(f'<a:p><a:r><a:t>{x}</a:t></a:r></a:p>' for x in t)}{more}</p:txBody></p:sp>"
    pic = '<p:pic><p:blipFill><a:blip r:embed="rId1"/></p:blipFill></p:pic>'
    table = "<p:graphicFrame><a:tbl>" + "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>' for c in r)}</a:tr>" for r in (("k", "v"), ("1", "2"))) + "</a:tbl></p:graphicFrame>"
    math = "<a:p><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></a:p>"
    display = "<a:p><m:oMathPara><m:oMath><m:r><m:t>z</m:t></m:r></m:oMath></m:oMathPara></a:p>"
    slide = lambda tree: f"<p:sld {P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
    notes = f'<p:notes {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>n1</a:t></a:r></a:p><a:p><a:r><a:t>n2</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    return package({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="bin" ContentType="image/jpeg"/></Types>',
        "_rels/.rels": relations([("r1", "officeDocument", "ppt/presentation.xml", "")]),
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="s2"/><p:sldId r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations([("s1", "slide", "slides/slide1.xml", ""), ("s2", "slide", "slides/slide2.xml", "")]),
        "ppt/slides/slide2.xml": slide(sp(["Title"]) + pic + f"<p:grpSp><p:grpSp>{table}</p:grpSp></p:grpSp>"),
        "ppt/slides/_rels/slide2.xml.rels": relations([("rId1", "image", "../media/i.bin", ""), ("rId2", "notesSlide", "../notes/n.xml", "")]),
        "ppt/slides/slide1.xml": slide(sp(["text"], math) + sp(["dropped"], display)),
        "ppt/notes/n.xml": notes, "ppt/media/i.bin": b"J",
    })


def xlsx() -> bytes:
    S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"/><row r="3"><c r="A3"><v>0</v></c><c r="B3"><v>1.50</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="1"><v>2</v></c></row>'
    return package({
        "_rels/.rels": relations([("r1", "officeDocument", "xl/workbook.xml", "")]),
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data" sheetId="1" r:id="a"/><sheet name="None" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations([("a", "worksheet", "worksheets/s1.xml", ""), ("b", "worksheet", "worksheets/s2.xml", "")]),
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/s2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    })


def pdf(pages, flate=True) -> bytes:
    """pages: texts (lines) or None for a blank page."""
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 600 800] >>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n))), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /CMMI10 >>"}
    image = b"\xff\xd8jpeg"
    objects[5] = b"<< /Type /XObject /Subtype /Image /Width 60 /Height 60 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(image), image)
    for i, lines in enumerate(pages):
        body = b""
        if lines is not None:
            body = b"BT /F1 12 Tf 14 TL 50 700 Td " + b" T* ".join(b"(%s) Tj" % x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines) + b" ET"
            body += b" BT /F2 10 Tf 1 0 0 1 100 300 Tm [(E=) -20 (mc)] TJ ET"
        data = zlib.compress(body) if flate else body
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> /XObject << /I 5 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if flate else b"", data)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"
