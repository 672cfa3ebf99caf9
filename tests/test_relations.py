"""Tables, formulas, markers, progress and index on small relations."""

import random

from pyspark.sql import functions as F

from lectern.operators import assets, chunks, formulas, index, markers, metrics, model, progress, tables


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPANS = f"rel_path string, page long, seq long, block_type int, text string, font string, bbox {BOX}, line_bbox {BOX}, page_width double, page_height double"
#: Pages of spans, 500 wide, and the regions that they make, worked out by hand.
HAND = {
    "none": ([], []),
    "one": ([(50, 100, 90, 110)], [(50, 100, 90, 110)]),
    "narrow goes": ([(50, 100, 60, 110)], []),
    "side by side": ([(50, 100, 90, 110), (100, 100, 140, 110)], [(50, 100, 140, 110)]),
    "too far right": ([(50, 100, 90, 110), (241, 100, 280, 110)], [(50, 100, 90, 110), (241, 100, 280, 110)]),
    "just near enough": ([(50, 100, 90, 110), (239, 100, 280, 110)], [(50, 100, 280, 110)]),
    "next line": ([(50, 100, 90, 110), (50, 124, 90, 134)], [(50, 100, 90, 134)]),
    "too far down": ([(50, 100, 90, 110), (50, 126, 90, 136)], [(50, 100, 90, 110), (50, 126, 90, 136)]),
    "what has grown reaches further": ([(50, 100, 90, 110), (50, 114, 90, 130), (50, 170, 90, 180)], [(50, 100, 90, 180)]),
    "in reading order": ([(300, 100, 340, 110), (50, 100, 90, 110), (170, 100, 210, 110)], [(50, 100, 340, 110)]),
    "two narrow ones are wide": ([(50, 100, 56, 110), (58, 100, 64, 110)], [(50, 100, 64, 110)]),
}


def pages_of(spark, pages):
    rows = [(name, 1, seq, 0, "∑", "", box(*b), box(0, b[1], 500, b[3]), 500.0, 800.0) for name, spans in pages.items() for seq, b in enumerate(spans)]
    return spark.createDataFrame(rows, SPANS)


def regions_of(df):
    got = {}
    for x in formulas.regions(df).orderBy("rel_path", "formula_idx").collect():
        got.setdefault(x.rel_path, []).append(tuple(x.bbox))
    return got


def test_regions_by_hand(spark):
    df = pages_of(spark, {name: spans for name, (spans, _) in HAND.items()})
    assert regions_of(df) == {name: [box(*b) for b in want] for name, (_, want) in HAND.items() if want}
    assert formulas.regions(df.where("block_type = 1")).count() == 0


def test_regions_of_any_page(spark):
    """Every wide span lies in a region, every region's edges are edges of spans, and pages don't mix."""
    r = random.Random(3)
    pages = {str(k): [(x := r.randint(0, 400), y := r.randrange(0, 300, 3), x + r.randint(11, 60), y + r.randint(2, 20)) for _ in range(r.randint(1, 14))] for k in range(60)}
    got = regions_of(pages_of(spark, pages))
    for name, spans in pages.items():
        inside = lambda s, g: g[0] <= s[0] and g[1] <= s[1] and g[2] >= s[2] and g[3] >= s[3]
        assert all(any(inside(s, g) for g in got[name]) for s in spans) and len(got[name]) <= len(spans)
        assert all({g[k] for g in got[name]} <= {float(s[k]) for s in spans} for k in range(4))
    alone = regions_of(pages_of(spark, {"7": pages["7"]}))
    assert alone["7"] == got["7"]


def test_context_of_a_crowded_page(spark):
    """Each region hears of the spans near it alone, however many there are elsewhere on the page."""
    spans = [("d", 1, k, 0, f"s{k}", "", box(0, 10 * k, 50, 10 * k + 8), box(0, 0, 1, 1), 500.0, 800.0) for k in range(20_000)]
    spans.append(("d", 1, 20_000, 0, "tall", "", box(60, 0, 61, 200_000), box(0, 0, 1, 1), 500.0, 800.0))
    found = [("d", 1, k, box(0, 2000 * k + 100, 9, 2000 * k + 110)) for k in range(100)] + [("d", 1, 100, None), ("e", 1, 0, box(0, 0, 1, 1))]
    rows = formulas.region_context(spark.createDataFrame(found, f"rel_path string, page long, formula_idx long, bbox {BOX}"), spark.createDataFrame(spans, SPANS))
    got = {(x.rel_path, x.formula_idx): x.context for x in rows.collect()}
    assert len(got) == 102 and got["d", 100] == got["e", 0] == ""
    # A region 10 high hears of what lies up to 20 above and below it: the spans from 80 to 130.
    assert all(got["d", k] == " ".join(["tall", *(f"s{200 * k + n}" for n in range(8, 13))]) for k in range(100))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan


def test_math_spans(spark):
    rows = [("abc", "CMMI10", True), ("abc", "Times", False), ("∑", "Times", True), (" ", "Symbol", False), ("∑∑∑" + "a" * 7, "", False), ("∑∑∑∑" + "a" * 6, "", True), ("𝑥𝑦z", None, True), ("ab", "", False)]
    df = spark.createDataFrame(rows, "t string, font string, want boolean")
    assert df.where(formulas.is_math("t", "font") != F.col("want")).count() == 0


def test_marker_insertion(spark):
    pages = spark.createDataFrame([("d", 1, "l0\nl1\nl2", 300.0)], "rel_path string, page long, text string, height double")
    at = lambda y: box(0, y - 1, 1, y + 1)
    found = spark.createDataFrame([("d", 1, 0, at(150), False), ("d", 1, 1, at(160), False), ("d", 1, 2, at(150), True), ("d", 1, 3, at(900), True)], "rel_path string, page long, formula_idx long, bbox struct<x0: double, y0: double, x1: double, y1: double>, is_inline boolean")
    assert formulas.insert_markers(pages, found).head().text == "l0\nl1 <<FORMULA:2>>\n<<FORMULA:1>>\n<<FORMULA:0>>\nl2 <<FORMULA:3>>"


def test_tables(spark):
    grid = [["a", "a\n b", ""], ["", None, ""], ["0"], [" ", "x", "x"]]
    df = spark.createDataFrame([(grid,)], "g array<array<string>>")
    row = df.select(tables.padded(tables.non_blank("g")).alias("p"), tables.markdown_table(tables.padded(tables.non_blank("g"))).alias("m"), tables.unmerged(tables.one_line_cells("g")).alias("u"), tables.markdown_table(F.expr("cast(array() AS array<array<string>>)")).alias("e")).head()
    assert row.p == [["a", "a\n b", ""], ["0", "", ""], [" ", "x", "x"]]
    assert row.m.split("\n")[0] == "| a | a" and row.e == ""
    assert row.u[0] == ["a", "a  b", ""] and row.u[3] == ["", "x", ""]
    cells = spark.createDataFrame([("w", 0, "S", 1, ["a"]), ("w", 0, "S", 3, ["b", "c"]), ("w", 1, "Empty", None, None)], "rel_path string, sheet_no long, sheet string, row_no long, values array<string>")
    assert tables.sheets_to_markdown(cells).head().markdown == "\n## S\n\n| a |  |\n| --- | --- |\n| b | c |\n\n\n## Empty\n"


def test_three_states(spark):
    docs = spark.createDataFrame([("d", "a ![image](1) b ![image](2) c ![image](3) d ![image](4)")], "rel_path string, markdown string")
    replies = spark.createDataFrame([("d", 0, None), ("d", 1, ""), ("d", 2, " $1 \\x "), ("d", 3, "```mermaid\ng\n```\n")], "rel_path string, ordinal long, reply string")
    new = replies.select("rel_path", "ordinal", markers.figure_text(F.col("reply")).alias("new"))
    assert markers.splice(docs, "rel_path", new, "image").head().markdown == "a ![image](1) b  c \nFigure: $1 \\x\n d \n```mermaid\ng\n```\n"
    texts = [r[0] for r in spark.createDataFrame([("x", True), ("x", False), (None, True), ("", True)], "l string, i boolean").select(markers.formula_text(F.col("l"), F.col("i"))).collect()]
    assert texts == ["$x$", "\n$$\nx\n$$\n", markers.FAILED, markers.FAILED]


def test_context(spark):
    docs = spark.createDataFrame([("d", "x" * 300 + "M" + "y" * 300), ("e", " ![image](q)M z ")], "k string, markdown string")
    got = {r.k: r.context for r in markers.context_around(docs, "k", F.lit("M")).collect()}
    assert got["d"] == "x" * 200 + "y" * 200 and got["e"] == "z"
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a", " ", "b", None, "c", "d"])], "k string, i long, text string")
    assert [r.context for r in chunks.context_window(rows, "k", "i").orderBy("i").collect()] == ["a b", "a b", "a b c", "b c d", "b c d", "c d"]


def test_model(spark):
    rows = [("a", "ocr", None), ("b", "ocr", "bad"), ("c", "cleanup", "text")]
    df = spark.createDataFrame([(i, k, t, t, b"x", "image/png") for i, k, t in rows], "id string, kind string, text string, context string, image binary, mime string")
    script = model.Scripted([("Transcribe", "page"), ("Tidy", "!400")])
    got = {r.id: (r.status, r.reply) for r in model.ask(df, script).collect()}
    assert got == {"a": ("ok", "page"), "b": ("ok", "page"), "c": ("skip", None)}
    assert {r.status for r in model.ask(df, model.NoProvider()).collect()} == {"no_key"}
    xml = '<m:r xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:rPr><w:b/></w:rPr><m:t>x</m:t></m:r>'
    assert "rPr" not in model.clean_omml(xml) and model.clean_omml("<broken") == "<broken"


def test_progress_and_index(spark):
    files = spark.createDataFrame([("a.docx", 1.0), ("a.pdf", 2.0), ("b.pdf", 3.0), ("index.docx", 1.0)], "rel_path string, mtime double")
    done = spark.createDataFrame([("a.docx", 1.0, "x"), ("b.pdf", 2.5, "x"), ("gone.pdf", 1.0, "x")], "rel_path string, mtime double, output string")
    assert sorted(r.rel_path for r in progress.pending(files, done).collect()) == ["a.pdf", "b.pdf", "index.docx"]
    out = {r.rel_path: (r.out_path, r.wins, r.collision) for r in progress.outputs(files).collect()}
    assert out["a.docx"] == ("a.md", False, True) and out["a.pdf"] == ("a.md", True, True)
    new = progress.upsert(done, files.withColumn("output", F.lit("new")))
    assert {(r.rel_path, r.mtime, r.output) for r in new.collect()} == {("a.docx", 1.0, "new"), ("a.pdf", 2.0, "new"), ("b.pdf", 3.0, "new"), ("index.docx", 1.0, "new"), ("gone.pdf", 1.0, "x")}
    docs = spark.createDataFrame([("b/z.md", "# T\nx"), ("a b/c.md", "none"), ("a/b.md", "none"), ("r.md", "# R"), ("d/index.md", "# no")], "path string, markdown string")
    text = index.index_text(index.manifest(docs)).head()[0]
    assert text == "# Knowledge Index\n\n**4 documents extracted**\n\n\n## Root\n\n- [R](r.md)\n\n## a\n\n- [b](a/b.md)\n\n## a b\n\n- [c](a b/c.md)\n\n## b\n\n- [T](b/z.md)"
    assert index.index_text(index.manifest(docs.limit(0))).count() == 0


def test_assets_and_metrics(spark):
    pages = spark.createDataFrame([("d", i, "" if i < 8 else "t") for i in range(10)] + [("e", i, " " if i < 7 else "t") for i in range(10)], "rel_path string, page long, text string")
    assert {r.rel_path: r.is_scanned for r in assets.scanned(pages).collect()} == {"d": True, "e": False}
    images = spark.createDataFrame([("d", 1, 0, 7, 40, 90), ("d", 2, 0, 7, 90, 90), ("d", 2, 1, 8, 50, 50), ("d", 3, 0, 8, 90, 90)], "rel_path string, page long, pos long, xref long, width int, height int")
    assert [(r.page, r.xref, r.asset_idx) for r in assets.embedded_images(images).collect()] == [(2, 8, 0)]
    empty = spark.createDataFrame([], "prompt_tokens long, completion_tokens long, cost double")
    assert tuple(metrics.usage_totals(empty).head()) == (0, 0, 0, 0, 0.0)


def test_contexts_of_markers(spark):
    """Worked out by hand: 200 characters on either side of the marker itself, other references in them taken out, cut ones kept."""
    m, other = "![image](a.png)", "![image](b (1).png)"
    cases = {
        f"{'x' * 300}{m}{'y' * 300}": ["x" * 200 + "y" * 200],
        f"short {m} text": ["short  text"],
        m: [""],
        f"{m}{m}": ["", ""],
        f"{m} between {other}": ["between .png)"] * 2,  # a reference ends at its first bracket
        f"{'p' * 195}{m}{'q' * 10}{m}": ["p" * 195 + "q" * 10, "p" * 175 + "q" * 10],
        f"{m}{'z' * 190}{m} end": ["z" * 190 + "![image](a", "ge](a.png)" + "z" * 190 + " end"],
        "no marker": [],
        "": [],
    }
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "rel_path string, markdown string")
    got = {}
    for x in markers.contexts(df, "rel_path").orderBy("rel_path", "ordinal").collect():
        got.setdefault(x.rel_path, []).append(x.context)
    wrong = {t: (got.get(str(i), []), want) for i, (t, want) in enumerate(cases.items()) if got.get(str(i), []) != want}
    assert not wrong


def test_contexts_hang_on_what_is_near_alone(spark):
    """They are short, hold no whole reference, and what is more than 200 characters away doesn't matter."""
    r = random.Random(4)
    piece = lambda: r.choice(["word ", "![image](a.png)", "![image](long/name/of/a/file.png)", "x" * 90, "\n", "é "])
    near = ["".join(piece() for _ in range(r.randint(0, 60))) for _ in range(60)]
    pairs = [(f"{far}{'-' * 210}{t}{'-' * 210}{far}", k, j) for k, t in enumerate(near) for j, far in enumerate(("", "other words " * 30))]
    df = spark.createDataFrame([(f"{k} {j}", t) for t, k, j in pairs], "rel_path string, markdown string")
    got = {}
    for x in markers.contexts(df, "rel_path").orderBy("rel_path", "ordinal").collect():
        got.setdefault(x.rel_path, []).append((x.ref, x.context))
        assert len(x.context) <= 400 and "![image](a.png)" not in x.context
    assert all(got.get(f"{k} 0") == got.get(f"{k} 1") and len(got.get(f"{k} 0", [])) == t.count("![image](") for k, t in enumerate(near))


def test_repeated_replacements_and_null_paths(spark):
    docs = spark.createDataFrame([("a", "x ![ocr](p.png) y")], "rel_path string, markdown string")
    new = spark.createDataFrame([("a", 0, "one"), ("a", 0, "two")], "rel_path string, ordinal long, new string")
    assert markers.splice(docs, "rel_path", new, "ocr").head()["markdown"] == "x two y"
    files = spark.createDataFrame([("b",), (None,), ("a/b",)], "rel_path string")
    assert {(x.rel_path, x.place) for x in progress.path_rank(files).collect()} == {("a/b", 1), ("b", 2), (None, None)}


def test_blank_pages_of_any_white_space(spark):
    pages = spark.createDataFrame([("a", t) for t in ("\n\n", "\xa0\u3000", "", None, "x")], "rel_path string, text string")
    got = assets.scanned(pages).head()
    assert got["blank_ratio"] == 0.8 and got["is_scanned"]


def test_contexts_join_what_they_need(spark, tmp_path):
    """The nearest pieces are put together, not all that could be needed: a few times what finding the markers takes."""
    import time

    whole = "".join("Ein längerer Satz. " * 11 + f"![image](img/{i}.png) " for i in range(100))
    spark.range(0, 800, 1, 8).select("id", F.concat(F.col("id").cast("string"), F.lit(f" {whole}")).alias("markdown")).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    spent = []
    for rows, column in ((markers.markers(docs, "id", "image"), "ref"), (markers.contexts(docs, "id"), "context")):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            n, longest = rows.agg(F.count("*"), F.max(F.length(column))).head()
            took.append(time.perf_counter() - began)
        assert n == 80_000
        spent.append(min(took))
    assert 100 < longest <= 400
    assert spent[1] < 4.5 * spent[0], spent


def test_regions_are_worked_out_once(spark, tmp_path):
    """Regions carry their columns to their context, also where no text is near or the box is missing: found is read once."""
    found = [("a", 0, 0, box(0, 100, 20, 110), True), ("a", 0, 1, box(0, 500, 20, 510), False), ("a", 1, 2, None, None), ("b", 0, 0, box(0, 100, 20, 110), True)]
    spark.createDataFrame(found, f"rel_path string, page long, formula_idx long, bbox {BOX}, is_inline boolean").write.parquet(f"{tmp_path}/f")
    spans = [("a", 0, n, 0, f" s{n} ", "", box(0, y, 9, y + 10), box(0, y, 9, y + 10), 500.0, 800.0) for n, y in enumerate((115, 85, 40, 300))]
    spark.createDataFrame(spans, SPANS).write.parquet(f"{tmp_path}/s")
    got = formulas.region_context(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/s"))
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    rows = {(r.rel_path, r.formula_idx): (r.context, r.is_inline, r.page, r.bbox and tuple(r.bbox)) for r in got.collect()}
    assert rows == {(f[0], f[2]): ("s1   s0" if f[:3] == ("a", 0, 0) else "", f[4], f[1], f[3]) for f in found}
