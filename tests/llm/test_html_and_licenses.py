"""Main text of pages, host votes, and license scans with inheritance."""

import html
import random

import pytest

from lectern.llm import html_extract as H
from lectern.llm.license_scan import LEAST, Weights, scan_licenses

ARTICLE = "<p>First   paragraph &amp; more, long enough to count.<p>Second one,<br>with a break; &#233;.</p><ul><li>item<li>other</ul>"
WANT = "First paragraph & more, long enough to count.\nSecond one, with a break; é.\nitem\nother"


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style>{head}</head><body><nav><ul><li><a href="/">Home page of the site</a></ul></nav>{body}<footer>&copy; all</footer></body></html>'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, path string, host int")


@pytest.mark.parametrize(
    "markup",
    [
        f"<article><h1>Title</h1>{ARTICLE}</article>",
        f'<main class="site"><div class="post-12"><h1>Title</h1>{ARTICLE}<div class="share-buttons">Share this</div></div><aside>Other stories that are long enough to count</aside></main>',
        f'<div id="content"><header><h2>Site</h2></header><div class="entry"><h1>Title</h1>{ARTICLE}<form><input><p>Your name and your opinion here</form></div><section class="comments"><p>I think, as a reader, that this is right</p></section></div>',
        f'<script>if (a < b) document.write("<p>no</p>")</script><div class="cookie-notice"><p>We use cookies, and more cookies, all day</p></div><article><header><h1>Title</h1><span>by someone</span></header>{ARTICLE}<template><p>hidden</p></template><!-- <p>comment</p> --><p hidden>gone</p></article>',
        f'<div class="page-header"><h1>Site name</h1></div><div id="wrap"><h1>Title</h1><div class="text">{ARTICLE * 1}</div></div><div id="sideBar"><p>Things at the side, many of them</p></div>',
        f'<article class="post"><div class="post-header"><h1>Title</h1><p>By someone, on some day</p></div><div class="content">{ARTICLE}</div><div class="post-footer"><p>Filed under things, and other things</p></div></article>',
        f'<div class="ad"><p>Buy this, and buy that, it is so cheap</p></div><article><h1>Title</h1>{ARTICLE}',
    ],
)
def test_extract(spark, markup):
    rows = [(i, f"http://www.site.org/{i}", page(markup)) for i in range(3)]
    got = H.extract(pages(spark, rows)).collect()
    assert {r.text for r in got} == {"Title\n" + WANT} and all(r.n_chars == len(r.text) for r in got)


def test_consensus(spark):
    """A page whose own best container is a long box follows its host."""
    good = [(i, f"https://a.example/{i}", page(f'<div class="story">{ARTICLE * 3}</div><div class="box"><p>short, box</p></div>')) for i in range(6)]
    odd = (9, "https://a.example/9", page(f'<div class="story"><p>Tiny story.</p></div><div class="box">{ARTICLE * 4}</div>'))
    alone = (10, "https://b.example/1", page(f'<div class="box">{ARTICLE}</div>'))
    got = {r.page_id: r.text for r in H.extract(pages(spark, [*good, odd, alone])).collect()}
    assert got[9] == "Tiny story." and got[0] == "\n".join([WANT] * 3) and got[10] == WANT


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain &lt;b&gt;   text"), (4, "http://h/", "<nav>only</nav>"), (4, "http://h/", "<nav>only</nav>"), (5, "http://h/", "<p>a<p"), (6, "http://h/", "<div><p>x &am"), (None, "http://h/", "<p>\xa0y z</p>"), (7, "http://h/", "<div>" * 3000 + "deep" + "</span>"), (8, "http://h/", "<table><tr><td>a<td>b<tr><td>c</table>")]
    got = sorted(((r.page_id or 0, r.text) for r in H.extract(pages(spark, rows)).collect()))
    assert got == [(0, "y z"), (1, ""), (2, ""), (3, "plain <b> text"), (4, ""), (4, ""), (5, "a"), (6, "x &am"), (7, "deep"), (8, "a b\nc")]
    assert H.extract(pages(spark, [])).count() == 0


def test_driver_pages(spark):
    """On the driver's pages: the article's blocks, in order."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def template(r):
    """A random page template: a function of a random source to (html, blocks of the article)."""
    outer = r.choice(["content has-sidebar", "post has-comments", "layout no-sidebar", "page-with-comments", "container sidebar-right", "main-col no-ads", "wrap", "story", "l-content", "site cookie-notice-off", ""])
    shape = r.choice(["article", "main", "div", "sections", "split", "form", "nested", "blockwise"])
    junk = [
        '<div class="{}"><p>{}</p></div>'.format(c, "{}")
        for c in r.sample(["ad", "cookie-notice", "sidebar", "sideBar-left", "newsletter-signup", "related-posts", "site-footer", "comment-list", "share-buttons", "ads-top", "page-header", "promo-box", "breadcrumbs", "left-sidebar", "main-nav", "widget-area"], 4)
    ] + r.sample(["<aside><p>{}</p></aside>", "<footer><p>{}</p></footer>", "<form><label>{}</label><input></form>", "<nav><a href=x>{}</a></nav>", '<section id="comments"><h2>Comments</h2><p>{}</p></section>', "<div role=banner>{}</div>", "<div hidden>{}</div>", "<script>{}</script>"], 3)
    inside = r.sample(junk, r.randint(0, 2))
    topic = r.choice(["cookies-in-baking", "notices-of-death", "menu-planning", "cookies", "advertising-history", "the-search", "footer-of-mountains"])

    def make(q):
        words = lambda a, b: " ".join("".join(q.choice("abcdefghij") for _ in range(q.randint(2, 8))) for _ in range(q.randint(a, b))).capitalize() + "."
        blocks = [words(3, 7)] + [words(12, 60) for _ in range(q.randint(3, 9))]
        fill = lambda xs: "".join(x.format(words(4, 12)) for x in xs)
        ps = [f"<p>{b}</p>" for b in blocks[1:]]
        title = f"<h1>{blocks[0]}</h1>"
        k = len(ps) // 2
        if shape == "article":
            body = f"<article>{title}{''.join(ps[:k])}{fill(inside)}{''.join(ps[k:])}</article>"
        elif shape == "main":
            body = f"<main>{title}{''.join(ps)}{fill(inside)}</main>"
        elif shape == "div":
            body = f"<div class='entry'>{title}{''.join(ps)}</div>{fill(inside)}"
        elif shape == "sections":
            heads = [words(2, 4), words(2, 4)]
            body = f"<article>{title}<section id='{topic}'><h2>{heads[0]}</h2>{''.join(ps[:k])}</section><section><h2>{heads[1]}</h2>{''.join(ps[k:])}</section></article>"
            blocks = [blocks[0], heads[0], *blocks[1 : k + 1], heads[1], *blocks[k + 1 :]]
        elif shape == "split":
            body = f"{title}<div class='intro'>{''.join(ps[:k])}</div><div class='body'>{''.join(ps[k:])}</div>{fill(inside)}"
        elif shape == "form":
            body = f"<form action=x><input type=hidden><div class='text'>{title}{''.join(ps)}</div></form>"
        elif shape == "nested":
            body = f"<div class='a'><div class='b'>{title}<div class='c d'>{''.join(ps)}</div></div></div>{fill(inside)}"
        else:
            body = title + "".join(f"<div class='para'>{b}</div>" for b in blocks[1:])
        at = q.randint(0, len(junk))
        page = f"<html><body class='no-js has-sidebar'>{fill(junk[:at])}<div class='{outer}'>{body}</div>{fill(junk[at:])}</body></html>"
        return page, blocks

    return make


def test_generated_templates(spark):
    """Blocks of 300 templates' pages: nearly all of the articles, and hardly anything else."""
    r = random.Random(11)
    rows, want = [], {}
    for h in range(300):
        make = template(r)
        for k in range(3):
            page, blocks = make(r)
            rows.append((10 * h + k, f"https://h{h}.example/{k}", page))
            want[10 * h + k] = blocks
    got = {x.page_id: x.text.split("\n") for x in H.extract(pages(spark, rows)).collect()}
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit >= 0.98 * sum(map(len, want.values())) and hit >= 0.98 * sum(map(len, got.values()))
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_names():
    kept = ["has-sidebar", "no-comments", "cookies-in-baking", "content-sidebar-wrap", "menu-planning", "sidebar-layout", "adventure", "shareholder", "related-work", "with_ads", "isHidden"]
    gone = ["sidebar", "sideBar", "side-bar", "left-sidebar", "comment-list", "ad-300x250", "cookie_notice", "siteFooter", "nav", "post-comments", "newsletter-signup"]
    assert [x for x in kept if H.named(x)] == [] and [x for x in gone if not H.named(x)] == []


def test_second_template_of_a_host(spark):
    """Pages of a rarer template aren't cut down to a small element on the path of the common one."""
    common = [(i, f"https://a.example/{i}", f'<body><div class="story"><p>{f"common text {i} " * 30}</p></div></body>') for i in range(20)]
    rare = [(100 + i, f"https://a.example/r{i}", f'<body><div class="story"><p>tagline</p></div><div class="text"><p>{f"rare text {i} " * 60}</p></div></body>') for i in range(4)]
    got = {x.page_id: x.text for x in H.extract(pages(spark, [*common, *rare])).collect()}
    assert all(got[i].startswith(f"common text {i}") for i in range(20)) and all(got[100 + i].startswith(f"rare text {i}") for i in range(4))


@pytest.mark.parametrize("markup", ["<div>" * 300_000, "<b>" * 200_000 + "<li></li>" * 50_000, '<a x="' * 100_000, "<table><tr><td>" * 80_000, "</div>" * 100_000, "<div class='ad'>x" * 50_000, "<p><b>" * 100_000])
def test_deep_markup(markup):
    """Time and memory grow with the length alone."""
    import time
    import tracemalloc

    began = time.time()
    H.main_text(markup, None)
    assert time.time() - began < 20
    tracemalloc.start()
    H.read(markup)
    assert tracemalloc.get_traced_memory()[1] < 400 * len(markup) ** 1 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], "doc_id long, text string, path string, license string, similarity double, directory string")
    return {r.doc_id: (r.license, r.origin) for r in scan_licenses(df, "path").collect()}


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
    rows = [
        (1, "code\n# Licensed under the Apache License, Version 2.0\nmore code that goes on for a while", "a/b/x.py"),
        (2, mit, "a/LICENSE"), (3, "no license in this text", "a/b/c/y.py"), (4, "All rights reserved.", "a/b/c/d/NOTICE"),
        (5, "plain", "a/b/c/d/z.py"), (6, "plain", "ab/z.py"), (7, None, "a/q"), (8, "", None), (9, "the of and it is by", "a/b/r"),
        (10, "LICENSED UNDER CC BY-NC 4.0.", "t"), (11, "x", "a"),
    ]
    got = scan(spark, rows)
    assert got == {1: ("Apache-2.0", "header"), 2: ("MIT", "file"), 3: ("MIT", "inherited"), 4: ("LicenseRef-all-rights-reserved", "file"), 5: ("LicenseRef-all-rights-reserved", "inherited"), 6: ("CC-BY-NC-4.0", "inherited"), 7: ("MIT", "inherited"), 8: ("CC-BY-NC-4.0", "inherited"), 9: ("MIT", "inherited"), 10: ("CC-BY-NC-4.0", "file"), 11: ("CC-BY-NC-4.0", "inherited")}
    assert scan(spark, []) == {}


def test_repeated_and_long(spark):
    long = "filler words " * 20_000 + "\nReleased under the MIT License."
    assert scan(spark, [(1, long, "p/a"), (1, long, "p/a"), (2, "b", "p/b")]) == {1: ("MIT", "header"), 2: (None, "none")}


def test_keys_lose_nothing():
    """Without the key tokens, no template keeps enough weight for the least cosine."""
    w = Weights()
    for _, v in w.vectors:
        assert sum(x * x for t, x in v.items() if t not in w.keys) < LEAST * LEAST


def test_full_texts(spark):
    """Whole license files are files by their own cosine, wrapped or not, and speak for what lies below them."""
    from lectern.llm.license_scan import full_texts

    rows, want = [], {}
    for k, (name, text) in enumerate(full_texts()):
        head = "Copyright (c) 2031 Some Body and Others\n\n"
        rows += [(10 * k, head + text, f"p{k}/LICENSE"), (10 * k + 1, "no license here", f"p{k}/src/x.py"), (10 * k + 2, head + "\n".join(" ".join(p.split()) for p in text.split("\n\n")), f"q{k}/LICENSE")]
        want |= {10 * k: (name, "file"), 10 * k + 1: (name, "inherited"), 10 * k + 2: (name, "file")}
    assert scan(spark, rows) == want


def test_wrapped_header(spark):
    code = "\n".join(f"value{i} = compute{i}(other{i})" for i in range(40))
    gpl = "# This program is free software: you can\n# redistribute it and/or modify it under the\n# terms of the GNU General Public\n# License, either version 3 of the License\n"
    got = scan(spark, [(1, gpl + code, "a/x.py"), (2, "# Released\n# under the MIT\n# License\n" + code, "b/x.py"), (3, code, "c/x.py")])
    assert got == {1: ("GPL-3.0", "header"), 2: ("MIT", "header"), 3: (None, "none")}


PARAGRAPH = "<p>This is a paragraph of plain prose that goes on for a while and then comes to its end.</p>"


def in_article(inner):
    return f'<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1>{4 * PARAGRAPH}{inner}</article><footer>foot</footer></body></html>'


@pytest.mark.parametrize("name", "discussion search form register notice menu social sharing header footer login alert skip pager widget overlay toolbar consent".split())
def test_sections_with_names_of_page_parts_stay(name):
    """A section of prose under a heading is the article's, whatever its class; what is short, linked or has controls is not."""
    text = lambda inner: H.main_text(in_article(f'<section class="{name}">{inner}</section>'), None)
    assert text(f"<h2>About it</h2>{4 * PARAGRAPH}").count("plain prose") == 8
    if name != "header":  # of an article's header every sentence stays
        assert text(f"<h2>About it</h2>{4 * PARAGRAPH}<form><input><button>Go</button></form>").count("plain prose") == 4
    links = "<ul>" + '<li><a href="x">a link with a rather long text in it</a></li>' * 9 + "</ul>"
    assert "link" not in text(f"<h2>About it</h2>{links}")
    if name != "header":  # nor its headings go
        assert "About" not in text("<h2>About it</h2><p>Short.</p>")


@pytest.mark.parametrize("name", "aside related recommended hidden banner promo newsletter comments cookie-notice adbox advertisment dfp-slot taboola teaser-list readmore author-box tag-list follow-us discuss".split())
def test_parts_of_the_page_go(name):
    assert H.main_text(in_article(f'<div class="{name}"><h2>About it</h2>{4 * PARAGRAPH}</div>'), None).count("plain prose") == 4


def test_comments_in_a_section_named_discussion_go():
    comments = "".join(f'<div class="comment">{PARAGRAPH}</div>' for _ in range(4))
    text = H.main_text(in_article(f'<section class="discussion"><h3>Comments</h3>{comments}</section>'), None)
    assert text.count("plain prose") == 4 and "Comments" not in text


def test_standfirst():
    head = '<header><h1>Head</h1><p class="lead">A standfirst that tells what the article below is all about.</p><p>By Ann Other, Senior Correspondent of the Paper</p><time>3 May</time></header>'
    text = H.main_text(f"<html><body><header><p>A page header that is a whole sentence, but no part of it.</p></header><article>{head}{3 * PARAGRAPH}</article></body></html>", None)
    assert text.split("\n")[:2] == ["Head", "A standfirst that tells what the article below is all about."] and "Ann Other" not in text and "3 May" not in text and "page header" not in text
