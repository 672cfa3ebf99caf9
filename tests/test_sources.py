"""Readers on files made by hand, the file tree, and whole runs."""

import json
import os
import random

import pytest

import office
from lectern.cli import main
from lectern.operators import model
from lectern.plans.run import Options, run
from lectern.sources.doctree import discover
from lectern.sources.ooxml import read_docx, read_pptx, read_xlsx
from lectern.sources.pdf import read_pdf


def put(root, name, data=b"x"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_tree(spark, tmp_path):
    names = ["a.docx", "B.PDF", "sub dir/c (1).docx", "_u.pdf", ".h.pdf", "_d/e.png", ".git/x.pdf", "sub/.git/y.png", "n.txt", ".pdf", "a.", "a/z.png", "a b/z.png"]
    for n in names:
        put(tmp_path, n)
    got = [(r.rel_path, r.format) for r in discover(spark, str(tmp_path)).collect()]
    assert {r for r, _ in got} == {"a.docx", "B.PDF", "sub dir/c (1).docx", "_u.pdf", ".h.pdf", "_d/e.png", "a/z.png", "a b/z.png"}
    assert dict(got)["B.PDF"] == "pdf"
    (tmp_path / "none").mkdir()
    assert discover(spark, str(tmp_path / "none")).count() == 0


def test_docx():
    x = read_docx(office.docx())
    kinds = [(k, n, t) for k, n, t, _ in x.blocks]
    assert ("heading", 1, "One") in kinds and ("para", 0, "Four") in kinds
    assert [a[0] for a in x.assets] == ["img_1.png", "img_2.jpeg"]
    assert kinds[2] == ("image", 0, "img_2.jpeg") and kinds[-1] == ("image", 0, "img_1.png")
    assert next(g for k, _, _, g in x.blocks if k == "merged_table") == [["h1", "h1"], ["a", "b"]]
    texts = [t for k, _, t in kinds if k == "para"]
    assert "let <<FORMULA:0>> be" in texts and "before\n<<FORMULA:1>>\n<<FORMULA:2>>" in texts
    assert "<<FORMULA:1>>" in [t for k, _, t, _ in read_docx(office.docx(), compat=True).blocks if k == "para"]  # the historic rule drops the rest
    assert [f[1] for f in x.formulas] == [True, False, True]
    assert [t for k, _, t, _ in read_docx(office.docx(), compat=True).blocks if k == "image"] == ["img_1.png", "img_2.jpeg"]


def test_pptx():
    x = read_pptx(office.pptx())
    kinds = [(k, t) for k, _, t, _ in x.blocks]
    assert kinds[0] == ("slide", "1") and ("image", "slide1_img0.jpg") in kinds and ("notes", "n1\nn2") in kinds
    assert next(g for k, _, _, g in x.blocks if k == "table") == [["k", "v"], ["1", "2"]]
    assert ("para", "text <<FORMULA:0>>") in kinds and ("para", "<<FORMULA:1>>") in kinds and not any("dropped" in t for _, t in kinds)


def test_xlsx():
    cells = read_xlsx(office.xlsx()).cells
    assert cells[0] == (0, "Data", 1, ["shared", None, "in"]) and cells[1][3] == []
    assert cells[2][3] == ["0", "1.5", "True", "1900-01-01 00:00:00"]
    assert cells[3] == (1, "None", None, None)


def test_pdf():
    for flate in (True, False):
        pages = read_pdf(office.pdf([["Hello (there)", "second"], None], flate))
        assert pages[0].text.split("\n")[:2] == ["Hello (there)", "second"] and pages[1].text == ""
        assert pages[0].lines[-1][0].font == "CMMI10" and pages[0].images[0].xref == 5 and pages[0].width == 600


def tree(root):
    put(root, "d/w.docx", office.docx())
    put(root, "d/s.pptx", office.pptx())
    put(root, "t.xlsx", office.xlsx())
    put(root, "p.pdf", office.pdf([["Line one", "Line two"], None]))
    put(root, "scan.pdf", office.pdf([None, None, None]))
    put(root, "i.png", b"png")
    put(root, "broken.docx", b"no zip")
    put(root, "x.docx", office.docx())
    put(root, "x.pptx", office.pptx())


def test_run(spark, tmp_path):
    src, out, work = (str(tmp_path / x) for x in ("src", "out", "work"))
    tree(src)
    r = run(spark, Options(src, out, work, model.NoProvider()))
    assert (r.discovered, r.processed, r.failed, r.skipped, r.exit_code) == (9, 8, 1, 0, 1)
    read = lambda n: open(os.path.join(out, n), encoding="utf-8").read()
    assert "# One" in read("d/w.md") and "[FORMULA: no API key]" in read("d/w.md") and "| h1 |  |" in read("d/w.md")
    assert "| shared |" in read("t.md") and "## None" in read("t.md")
    assert read("p.md").count("## Page") == 1 and "Line one" in read("p.md") and "FORMULA" in read("p.md")
    assert read("scan.md").count("![ocr](") == 3 and read("i.md").startswith("![image](images/i_")
    assert os.path.exists(os.path.join(work, read("i.md")[9:].split(")")[0]))
    assert "## Slide 2" in read("x.md")  # the later of two files that map to one output
    entries = json.load(open(os.path.join(out, "manifest.json")))
    assert [e["path"] for e in entries] == sorted((e["path"] for e in entries), key=lambda p: p.split("/")) and len(entries) == 7
    assert read("index.md").startswith("# Knowledge Index\n\n**7 documents extracted**")
    again = run(spark, Options(src, out, work, model.NoProvider()))
    assert (again.pending, again.skipped) == (1, 8)  # the broken one comes again
    os.remove(os.path.join(src, "broken.docx"))
    os.utime(os.path.join(src, "t.xlsx"), (1, 1))
    third = run(spark, Options(src, out, work, model.NoProvider()))
    assert (third.pending, third.processed, third.exit_code) == (1, 1, 0)


def test_run_on_uris(spark, tmp_path):
    """Source, output and work by URI, as on a file system that isn't mounted: the index is a folder of text in order."""
    src, out, work = (f"file://{tmp_path}/{x}" for x in ("src", "out", "work"))
    put(tmp_path / "src", "d/w.docx", office.docx())
    put(tmp_path / "src", "i.png", b"png")
    for pending in (2, 0):
        r = run(spark, Options(src, out, work, model.NoProvider()))
        assert (r.discovered, r.pending, r.failed) == (2, pending, 0)
    assert "# One" in (tmp_path / "out" / "d" / "w.md").read_text(encoding="utf-8")
    text = lambda n: "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out" / n).iterdir()) if p.name.startswith("part-"))
    assert text("index.md").startswith("# Knowledge Index\n\n**2 documents extracted**") and [e["path"] for e in json.loads(text("manifest.json"))] == ["d/w.md", "i.md"]
    facts = spark.read.parquet(f"{work}/steps")
    assert {(x.rel_path, x.step) for x in facts.collect()} == {(p, s) for p in ("d/w.docx", "i.png") for s in r.steps or ("formulas", "ocr", "filtered", "figures", "cleanup")}


def test_run_with_model(spark, tmp_path):
    src, out, work = (str(tmp_path / x) for x in ("src", "out", "work"))
    put(src, "w.docx", office.docx())
    put(src, "i.png", b"png")
    script = model.Scripted([("Office formula", "$x^2$"), ("figure", "a chart"), ("Tidy", "!400")])
    r = run(spark, Options(src, out, work, script))
    text = open(os.path.join(out, "w.md"), encoding="utf-8").read()
    assert "$x^2$" in text and "Figure: a chart" in text and r.failed == 0 and r.calls >= 5 and r.cost > 0
    down = run(spark, Options(src, str(tmp_path / "o2"), str(tmp_path / "w2"), model.Scripted([("figure", "!down")])))
    assert down.aborted and down.exit_code == 1 and not os.path.exists(tmp_path / "o2" / "index.md")


def test_run_with_raster(spark, tmp_path):
    src, out, work = (str(tmp_path / x) for x in ("src", "out", "work"))
    put(src, "p.pdf", office.pdf([["Line one", "Line two"], None]))
    put(src, "scan.pdf", office.pdf([None, None]))

    def raster(content, page, clip, dpi):
        return None if page == 2 and clip is None and dpi == 200 else f"{page} {clip is not None} {dpi}".encode()

    script = model.Scripted([("Transcribe", "read page"), ("picture as LaTeX", "E=mc^2"), ("figure", "BLANK")])
    r = run(spark, Options(src, out, work, script, raster=raster))
    read = lambda n: open(os.path.join(out, n), encoding="utf-8").read()
    assert r.failed == 0 and "E=mc^2" in read("p.md") and "Figure: BLANK" in read("p.md")
    assert "read page" in read("scan.md") and read("scan.md").count("![ocr](") == 1


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    codes = [500, 200, 400, 401, 503, 503, 503, 503, 503]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            code = codes.pop(0)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1, "cost": 0.5}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    http = model.Http("k", url=f"http://127.0.0.1:{server.server_port}/", wait=0.01)
    got = http.ask("q", b"img", "image/png")
    assert (got.text, got.prompt_tokens, got.cost) == ("hi", 3, 0.5)
    for error in (model.BadRequest, model.ProviderDown, model.ProviderDown):
        with pytest.raises(error):
            http.ask("q", None, None)
    server.shutdown()
    assert codes == []


def test_cli(spark, tmp_path, capsys):
    src, out, work = (str(tmp_path / x) for x in ("src", "out", "work"))
    put(src, "t.xlsx", office.xlsx())
    assert main(["--input", src, "--output", out, "--temp", work], spark) == 0
    assert os.path.exists(os.path.join(out, "extraction.log"))
    put(out, "dirty.md", b"#x  \n\n\n\ny")
    assert main(["lint", out], spark) == 0 and "dirty.md: " in capsys.readouterr().out
    assert open(os.path.join(out, "dirty.md")).read() == "# x\n\ny\n"
    assert main(["lint", str(tmp_path / "nowhere")], spark) == 1
    assert main(["clear", "--temp", work, "--output", out, "--yes"]) == 0 and not os.path.exists(work) and os.path.exists(out)


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.plans.run import read_progress
    from lectern.streaming.incremental import process_new

    src, state, check = (str(tmp_path / x) for x in ("src", "state", "check"))
    seen = []

    def process(rows):
        seen.append(sorted(r.rel_path for r in rows.collect()))
        return rows.withColumn("output", F.concat("rel_path", F.lit(".md")))

    add = lambda rows: spark.createDataFrame(rows, "rel_path string, mtime double, markdown string").coalesce(1).write.mode("append").parquet(src)
    add([("a", 1.0, "x"), ("b", 1.0, "y")])
    process_new(spark, src, state, check, process)
    add([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 1.0, "z")])
    process_new(spark, src, state, check, process)
    assert seen == [["a", "b"], ["b", "c"]]
    assert {(r.rel_path, r.mtime) for r in read_progress(spark, state).collect()} == {("a", 1.0), ("b", 2.0), ("c", 1.0)}


def test_arrivals(spark, tmp_path):
    from lectern.streaming.incremental import arrivals

    rows = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 01:10:00",)], "s string").selectExpr("cast(s AS timestamp) AS at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp").parquet(str(tmp_path / "in"))
    q = arrivals(stream, "at").writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.documents for r in spark.table("arrived").collect()) == [1, 2]


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """Files of more bytes than a batch holds come in several, and one that is too large is an error of its own."""
    from lectern.sources import doctree

    assert [doctree._size(x) for x in ("64MB", "1g", "17", "2k", "5 m".replace(" ", ""))] == [64 << 20, 1 << 30, 17, 2 << 10, 5 << 20]
    for i in range(30):
        (tmp_path / f"{i}.png").write_bytes(bytes([i]) * 100_000)
    (tmp_path / "big.png").write_bytes(b"x" * 400_000)
    files = doctree.discover(spark, str(tmp_path)).coalesce(1)
    got = {r.rel_path: (None if r.content is None else bytes(r.content), r.error) for r in doctree.with_content(files, str(tmp_path), 250_000, 300_000).collect()}
    assert len(got) == 31 and got["big.png"][0] is None and "larger" in got["big.png"][1]
    assert all(got[f"{i}.png"] == (bytes([i]) * 100_000, None) for i in range(30))


def test_more_than_two_gigabytes_in_a_partition(spark, tmp_path):
    """Sparse files of over 2 GB together, read in one task."""
    from pyspark.sql import functions as F

    from lectern.sources import doctree

    for i in range(9):
        with open(tmp_path / f"{i}.pdf", "wb") as f:
            f.truncate(250 << 20)
    files = doctree.discover(spark, str(tmp_path)).coalesce(1)
    got = doctree.with_content(files, str(tmp_path)).select(F.length("content").alias("n"), "error").collect()
    assert [(r.n, r.error) for r in got] == 9 * [(250 << 20, None)]


def _pdf_file(objects):
    """A PDF file of numbered objects: (dictionary, stream or None)."""
    out = b"%PDF-1.4\n"
    for n, (head, body) in objects.items():
        out += f"{n} 0 obj\n".encode() + (head if body is None else head[:-2] + f" /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream") + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def _one_page(content, more, resources):
    return _pdf_file({1: (b"<< /Type /Catalog /Pages 2 0 R >>", None), 2: (b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", None), 3: (b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 300] /Contents 4 0 R /Resources << " + resources + b" >> >>", None), 4: content, **more})


def test_pdf_forms_differences_and_widths():
    form = b"BT /F1 10 Tf 20 50 Td <0102> Tj ET"
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /CMSY10 /FirstChar 1 /Widths [900 250] /Encoding << /Type /Encoding /Differences [1 /summation /alpha 65 /Eacute] >> >>"
    data = _one_page((b"<< >>", b"BT /F1 10 Tf 20 200 Td (A) Tj ET q 1 0 0 1 0 30 cm /X1 Do Q"), {5: (font, None), 6: (b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 0] /Resources << /Font << /F1 5 0 R >> >> >>", form)}, b"/Font << /F1 5 0 R >> /XObject << /X1 6 0 R >>")
    (page,) = read_pdf(data)
    assert page.text == "\u00c9\n\u2211\u03b1"
    span = page.lines[1][0]
    assert (span.x0, round(span.x1 - span.x0, 6), span.y1) == (25.0, 11.5, 300.0 - 80.0)


def test_pdf_filters():
    import base64
    import zlib

    from lectern.sources import streams

    text = b"BT /F1 10 Tf 20 200 Td (Hello) Tj ET"
    runs = b"".join(bytes([len(text[i : i + 100]) - 1]) + text[i : i + 100] for i in range(0, len(text), 100)) + b"\x80"
    codes = "".join(f"{c:09b}" for c in [256, *text, 257])
    packed = int(codes.ljust(-(-len(codes) // 8) * 8, "0"), 2).to_bytes(-(-len(codes) // 8))
    predicted = b"".join(bytes([1, *((b - a) & 255 for a, b in zip(b"\0" + text[i : i + 9], text[i : i + 9]))]) for i in range(0, len(text), 9))
    for name, body in (("/ASCII85Decode", base64.a85encode(text) + b"~>"), ("/ASCIIHexDecode", text.hex().encode() + b">"), ("/RunLengthDecode", runs), ("/LZWDecode", packed), ("[/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(text)) + b"~>"), ("/FlateDecode /DecodeParms << /Predictor 12 /Columns 9 >>", zlib.compress(predicted))):
        (page,) = read_pdf(_one_page((f"<< /Filter {name} >>".encode(), body), {}, b""))
        assert page.text == "Hello", name
    with pytest.raises(streams.TooLarge):
        streams.inflate(zlib.compress(bytes(10_000_000)), 1_000_000)
    r = random.Random(1)
    raw = bytes(r.choice(b"abcd") for _ in range(5000))
    table, cur, bits = {bytes([i]): i for i in range(256)}, b"", f"{256:09b}"
    n, width = 258, 9
    for c in raw:
        if cur + bytes([c]) in table:
            cur += bytes([c])
            continue
        bits += f"{table[cur]:0{width}b}"
        table[cur + bytes([c])] = n
        n += 1
        width = max(9, n.bit_length())
        cur = bytes([c])
    bits += f"{table[cur]:0{width}b}"
    n += 1
    bits += f"{257:0{max(9, n.bit_length())}b}"
    assert n < 4096 and streams.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))) == raw


def test_pdf_rasters_and_scanned_pages(spark, tmp_path):
    """Flate rasters become PNG files; the largest image of a scanned page is its picture for OCR."""
    import struct
    import zlib

    def plain_png(data):
        """Width, height, bits, kind and unfiltered rows of a PNG file."""
        assert data[:8] == b"\x89PNG\r\n\x1a\n"
        at, chunks = 8, {}
        while at < len(data):
            n, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            assert zlib.crc32(name + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
            chunks[name] = body
            at += 12 + n
        w, h, bits, kind = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
        rows = zlib.decompress(chunks[b"IDAT"])
        size = len(rows) // h
        return w, h, bits, kind, b"".join(rows[i + 1 : i + size] for i in range(0, len(rows), size))

    rgb, gray = bytes(range(256)) * 3 * 4, bytes(range(64)) * 64
    images = {
        5: (b"<< /Subtype /Image /Width 64 /Height 16 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode >>", zlib.compress(rgb)),
        6: (b"<< /Subtype /Image /Width 64 /Height 64 /BitsPerComponent 8 /ColorSpace [/ICCBased 8 0 R] /Filter /FlateDecode >>", zlib.compress(gray)),
        7: (b"<< /Subtype /Image /Width 16 /Height 2 /BitsPerComponent 1 /ColorSpace [/Indexed /DeviceRGB 1 <000000FF0000>] /Filter /FlateDecode >>", zlib.compress(b"\xAA\x55\xF0\x0F")),
        8: (b"<< /N 1 >>", b"profile"),
        9: (b"<< /Subtype /Image /Width 60 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK /Filter /FlateDecode >>", zlib.compress(bytes([0, 255, 255, 0]) * 60)),
    }
    data = _one_page((b"<< >>", b""), images, b"/XObject << /A 5 0 R /B 6 0 R /C 7 0 R /D 9 0 R >>")
    (page,) = read_pdf(data)
    got = {i.xref: plain_png(i.data) for i in page.images}
    assert {i.ext for i in page.images} == {"png"}
    assert got[5] == (64, 16, 8, 2, rgb) and got[6] == (64, 64, 8, 0, gray) and got[7] == (16, 2, 1, 3, b"\xAA\x55\xF0\x0F") and got[9] == (60, 1, 8, 2, b"\xff\0\0" * 60)
    src, out, work = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "work")
    put(src, "scan.pdf", data)
    r = run(spark, Options(src, out, work, model.Scripted([("Transcribe", "the words on the page")])))
    with open(os.path.join(out, "scan.md"), encoding="utf-8") as f:
        assert "the words on the page" in f.read()
    assert r.formats == {"pdf": 1} and r.ocr["extracted"] == 1


def test_stream_from_the_command_line(spark, tmp_path):
    """Texts that arrive are written and indexed once; changed ones again."""
    arrivals, out, work = (str(tmp_path / x) for x in ("in", "out", "work"))
    os.makedirs(arrivals)
    put = lambda rows: spark.createDataFrame(rows, "rel_path string, mtime double, markdown string").coalesce(1).write.mode("append").parquet(arrivals)
    command = ["stream", arrivals, "--output", out, "--temp", work]
    put([("d/a.docx", 1.0, "# A\nx  "), ("b.pptx", 1.0, "## Slide 1\nfew\n## Two\n" + "word " * 30)])
    assert main(command, spark) == 0 and main(command, spark) == 0
    read = lambda n: open(os.path.join(out, n), encoding="utf-8").read()
    assert read("d/a.md") == "# A\n\nx\n" and "Slide 1" not in read("b.md") and "[A](d/a.md)" in read("index.md")
    put([("d/a.docx", 2.0, "# B\n")])
    assert main(command, spark) == 0 and read("d/a.md") == "# B\n" and "[B](d/a.md)" in read("index.md")
    assert main(["stream", str(tmp_path / "nothing")], spark) == 1
