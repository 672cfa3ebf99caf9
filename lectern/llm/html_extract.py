"""HTML main text by consensus host paths.

1. Each page becomes a flat list of elements and of blocks (text, link characters, element). Scripts, styles, form controls
   and what is hidden never count. Other elements that are menus, headers, footers, sidebars, notices, adverts, forms or
   comments by tag, role or name are left out with all they contain, unless they hold most of the page's own text beside an
   article, a main element or a level-1 heading: then they are wrappers. A class or id names an element if it is a listed
   word, ends with one, or begins with one and goes on with helper words (``comment-list``); ``has-sidebar``,
   ``no-comments`` or ``cookies-in-baking`` name nothing. A section within the content whose id alone is a topic word
   stays if it begins with a heading and is prose; one whose class is a word that papers and manuals have sections about
   (discussion, search, notice) stays if it begins with a heading and goes on with OWN paragraphs of prose or more, without a
   form control. Of an article's own header the headings stay, and what is a sentence or more.
2. Each page scores its containers: an article or main element with most text or the level-1 heading, else from the root
   down the container with most text, as long as no prose is left beside it. The page votes for its path: the tags and first
   classes from the root, digits taken out, so that pages of one template agree. Paths travel as 64-bit names.
3. Votes are counted by host and path, and how many pages have the path. A path's trust on a host is the share of votes
   among the pages that have it, shrunk by PRIOR pages to its share over all hosts. Hosts of any size meet in partial sums.
4. Each page's text is taken from its elements on the path that wins: the one of its paths with the highest trust times a
   small power (EVIDENCE) of the share of the page's text below it, after the title (h1) before it. A page without container is taken whole.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by one line break.
Null and empty pages give an empty text. Pages without a host share the host "". Broken markup is read as far as it goes:
an end tag closes the nearest open element of its name, a block start closes an open paragraph. Time and memory grow with
the length of a page, however deep its elements lie. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from array import array
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lectern.llm.runtime import keep, only, small_batches, with_few

#: Pages that all hosts together add to each host's own, and the power of a page's own evidence.
PRIOR, EVIDENCE = 2.0, 0.25
#: Share of the page's text that makes a wrapper of a named element, and the same without article, main or heading in it.
MOST, ALL, ENOUGH = 0.5, 0.98, 250
#: Unlinked characters, and their share, that make a block prose; prose beside a container that keeps it from standing alone.
PROSE, UNLINKED, BESIDE = 40, 0.7, 0.1
#: Paragraphs of prose that make a section of the article of what is named like a part of the page.
OWN = 3
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
_CELLS = frozenset(("td", "th"))
_CONTAINERS = frozenset("body main article section div td blockquote center".split())
_NEVER_TEXT = frozenset("head script style noscript template svg iframe object embed applet button select option textarea input audio video canvas map title noembed noframes".split())
_PAGE_PARTS = frozenset("nav footer aside form label fieldset dialog menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}
#: Words in an element's class or id that tell what it is.
_LISTED = frozenset("nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar sidenav aside ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations widget widgets toolbar masthead copyright skip search searchform footer footnav form paywall toast hidden adbox adslot advertisment dfp taboola outbrain teaser teasers teaserlist readmore followus authorbox taglist topnav mainnav subnav sitenav pagenav siteheader pageheader sitefooter pagefooter header".split())
_COMMENTS = frozenset("comment comments commentlist discuss disqus reply replies respond responses discussion".split())
#: What may follow a listed word in a name, and what makes a name speak of something else.
_HELPERS = frozenset("area author bar block body bottom box button buttons card col column container content count cta desktop dialog fixed form global group head header heading icons info inner inside item items left link links list main meta mobile module msg message outer overlay panel posts primary region right row secondary section signup site slot sm small stories text thread title top unit widget widgets wrap wrapper zone notice notices banner popup modal menu nav footer list comment comments".split())
_MODIFIERS = frozenset("has no with without non not in on of for and the a about to hide show is".split())
#: Listed words that are also topics, as an id of a section.
_TOPICS = frozenset("cookie cookies consent gdpr notice notices notification alert popup search register menu ads advertising advertisement adverts banner promotion sponsors copyright sharing social subscription discussion navigation overlay widget widgets form footer header toolbar pagination login newsletter skip".split())
#: Listed words that articles have sections about: alone in a class they don't tell.
_SUBJECTS = frozenset("discussion search searchform form register notice notices menu social sharing header footer login alert notification skip pager pagination widget widgets overlay toolbar consent navigation copyright subscription".split())
_CONTROLS = frozenset("form button select textarea label fieldset".split())
_ENDS = re.compile(r"[.!?:…][\"'”’»)\]]*\Z")
#: Words of an element that is the main part.
_OF_MAIN = frozenset("article content post entry story".split())
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_SIZE = re.compile(r"\d+(?:x\d+)?")
NAMED, STRICT, HEAD, HEADING, LINK, IN_MAIN, IN_CONTENT, HARD, TOPIC, SUBJECT = (1 << k for k in range(10))
_INHERITED = HEAD | HEADING | LINK | IN_MAIN | IN_CONTENT | HARD


@dataclass(slots=True)
class Block:
    text: str
    links: int
    element: int


@dataclass(slots=True)
class Page:
    """Elements in order of their start tags, as columns, and the blocks of text that are not left out."""

    tags: list[str] = field(default_factory=list)
    up: array = field(default_factory=lambda: array("q"))
    path: array = field(default_factory=lambda: array("q"))
    flags: array = field(default_factory=lambda: array("H"))
    out: bytearray = field(default_factory=bytearray)
    blocks: list[Block] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(source):
        out.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" and v[:1] == v[-1:] and len(v) > 1 else v)
    return out


def named(token: str) -> str | None:
    """The listed word that a class or id names its element by, or None."""
    parts = [x.lower() for x in _CAMEL.findall(_SIZE.sub("-", token))]
    if not parts or _MODIFIERS.intersection(parts):
        return None
    for word in ("".join(parts), parts[-1], parts[0] if _HELPERS.issuperset(parts[1:]) else ""):
        if word in _LISTED or word in _COMMENTS:
            return word
    return None


_names: dict[tuple[str, str, str], tuple[int, str]] = {}


def _kind(tag: str, classes: str, ident: str) -> tuple[int, str]:
    """Flags that the names of an element give it, and its step in a path."""
    got = _names.get((tag, classes, ident))
    if got is None:
        flags = 0
        own = classes.split()
        by_class, by_id = [w for x in own if (w := named(x))], [w for x in ident.split() if (w := named(x))] if tag not in _HEADINGS else []
        words = {p.lower() for x in (*own, ident) for p in _CAMEL.findall(x)}
        if tag not in ("html", "body"):
            if tag in ("article", "main"):  # their class often says what the page is about
                by_class, by_id = [w for w in by_class if w in _COMMENTS or w in ("ad", "ads", "advert", "promo", "related", "sidebar")], []
            if by_class or by_id:
                flags |= NAMED | (STRICT if _COMMENTS.intersection(by_class + by_id) - {"discussion"} else 0)
                if not by_class and _TOPICS.issuperset(by_id):
                    flags |= TOPIC
                elif all(x.lower() in _SUBJECTS for x in (*own, *ident.split()) if named(x)):
                    flags |= SUBJECT
                if "header" in by_class + by_id and set(by_class + by_id) == {"header"} and words & _OF_MAIN:
                    flags = flags & ~(NAMED | TOPIC | SUBJECT) | HEAD
        if not flags & NAMED and words & _OF_MAIN:
            flags |= IN_CONTENT
        first = _DIGITS.sub("", own[0]) if own else ""
        if len(_names) > 50_000:
            _names.clear()
        got = _names[tag, classes, ident] = flags, f"{tag}.{first}" if first else tag
    return got


def _marks(tag: str, source: str, above: int) -> tuple[int, str]:
    """Flags of an element in an element with the flags above, and its step."""
    attributes = _attributes(source) if _TELLS.search(source) else {}
    flags, step = _kind(tag, attributes.get("class", ""), attributes.get("id", ""))
    flags |= above & _INHERITED
    if tag in _NEVER_TEXT or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        flags |= HARD
    if tag in _PAGE_PARTS or attributes.get("role", "").lower() in _ROLES:
        flags = (flags | NAMED | STRICT) & ~(TOPIC | SUBJECT)
    if tag == "header" or flags & NAMED and above & IN_MAIN and flags & TOPIC == 0 and _only_header(attributes):
        flags = flags & ~(NAMED | STRICT) | HEAD if above & IN_MAIN else flags | NAMED | STRICT
    if tag in _HEADINGS:
        flags |= HEADING
    elif tag == "a":
        flags |= LINK
    elif tag in ("article", "main"):
        flags |= IN_MAIN | IN_CONTENT
    return flags, step


def _only_header(attributes: dict[str, str]) -> bool:
    """Whether an element's names say header and nothing else that is listed."""
    return {w for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if (w := named(x))} == {"header"}


def read(page: str | None) -> Page:
    """Elements and blocks of a page."""
    page = page or ""
    p = Page()
    tags, up, path, flags = p.tags, p.up, p.path, p.flags
    block, cell, depth = array("q"), array("q"), array("q")  # nearest block or cell, nearest part of a table, place in the stack
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}
    pieces: list[tuple[str, int]] = []
    held: list[tuple[int, list[tuple[str, int]]]] = []

    def flush() -> None:
        nonlocal pieces
        if pieces:
            held.append((block[stack[-1]] if stack else -1, pieces))
            pieces = []

    def close(k: int) -> None:
        while len(stack) > k:
            open_at[tags[stack.pop()]].pop()

    def add(text: str) -> None:
        if text:
            top = stack[-1] if stack else -1
            f = flags[top] if stack else 0
            if not f & HARD:
                pieces.append((text, top))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                add(" ")
            elif open_at.get(tag):
                k = open_at[tag][-1]
                if stack and (b := block[stack[-1]]) >= 0 and depth[b] >= k and (tag not in _CELLS or tags[b] not in _CELLS):
                    flush()
                elif tag in _CELLS:
                    add(" ")
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        top = stack[-1] if stack else -1
        if tag in _BLOCKS:
            flush()
            # A block ends an open paragraph, with the inline elements in it; an item or row ends the one before.
            if top >= 0 and (b := block[top]) >= 0 and (tags[b] == "p" or tags[b] in _CLOSES.get(tag, ())):
                close(depth[b])
        elif tag in _CELLS:
            if top >= 0 and (c := cell[top]) >= 0 and tags[c] in _CELLS:
                close(depth[c])
            add(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            shut = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = shut.start() if shut else end
        above = stack[-1] if stack else -1
        got, step = _marks(tag, m.group(3), flags[above] if above >= 0 else 0)
        name = xxh3_64_intdigest(f"{path[above] if above >= 0 else 0}>{step}".encode())
        i = len(tags)
        tags.append(tag)
        up.append(above)
        path.append(name - (1 << 64) if name >> 63 else name)
        flags.append(got)
        block.append(i if tag in _BLOCKS or tag in _CELLS else block[above] if above >= 0 else -1)
        cell.append(i if tag in _CELLS or tag in ("tr", "table") else cell[above] if above >= 0 else -1)
        depth.append(len(stack))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(i)
    flush()
    _decide(p, held)
    return p


def _decide(p: Page, held: list[tuple[int, list[tuple[str, int]]]]) -> None:
    """Which elements are left out, and the blocks of what stays."""
    tags, up, flags = p.tags, p.up, p.flags
    n = len(tags)
    p.out = bytearray(n)

    def prose(element: int, pieces: list[tuple[str, int]]) -> bool:
        """Whether a block is a sentence or more, most of it not linked."""
        text = html.unescape("".join(t for t, _ in pieces)).strip()
        linked = sum(len(t) for t, at in pieces if at >= 0 and flags[at] & LINK)
        return len(text) >= PROSE and len(text) - linked >= UNLINKED * len(text) and _ENDS.search(text) is not None

    held = [(e, x) for e, x in held if e < 0 or not flags[e] & HEAD or flags[e] & HEADING or prose(e, x)]
    if any(f & NAMED for f in flags):
        worth, links, holds, first = array("q", bytes(8 * n)), array("q", bytes(8 * n)), bytearray(n), bytearray(n)
        total = 0
        for element, pieces in held:
            for text, at in pieces:
                if size := len(text.strip()):
                    linked = at >= 0 and flags[at] & LINK
                    total += 0 if linked else size
                    if at >= 0:
                        (links if linked else worth)[at] += size
        for i in range(n - 1, -1, -1):
            if tags[i] == "h1" or tags[i] in ("article", "main") and not flags[i] & NAMED:
                holds[i] = 1
            if (a := up[i]) >= 0:
                worth[a] += worth[i]
                links[a] += links[i]
                holds[a] |= holds[i]
        for element, pieces in held:  # the first block below each element: whether it is a heading
            at = element
            while at >= 0 and not first[at]:
                first[at] = 2 if flags[element] & HEADING else 1
                at = up[at]
        own, controls = array("q", bytes(8 * n)), bytearray(n)
        if any(f & SUBJECT for f in flags):
            for element, pieces in held:
                if element >= 0 and prose(element, pieces):
                    own[element] += 1
            for i in range(n - 1, -1, -1):
                controls[i] |= tags[i] in _CONTROLS
                if (a := up[i]) >= 0:
                    own[a] += 0 if flags[i] & NAMED else own[i]
                    controls[a] |= controls[i]
        for i in range(n):
            a = up[i]
            if a >= 0 and p.out[a]:
                p.out[i] = 1
            elif flags[i] & NAMED and not (
                worth[i] >= MOST * total and holds[i] and total
                or worth[i] >= max(ALL * total, ENOUGH) and not flags[i] & STRICT
                or flags[i] & TOPIC and a >= 0 and flags[a] & IN_CONTENT and first[i] == 2 and worth[i] >= 3 * PROSE and worth[i] >= UNLINKED * (worth[i] + links[i])
                or flags[i] & SUBJECT and a >= 0 and flags[a] & IN_CONTENT and first[i] == 2 and own[i] >= OWN and not controls[i] and worth[i] >= UNLINKED * (worth[i] + links[i])
            ):
                p.out[i] = 1
    for element, pieces in held:
        text = " ".join(html.unescape("".join(t for t, at in pieces if at < 0 or not p.out[at])).split())
        if text:
            p.blocks.append(Block(text, min(len(text), sum(len(t) for t, at in pieces if at >= 0 and not p.out[at] and flags[at] & LINK)), element))


@dataclass(slots=True)
class Weights:
    """Unlinked characters and those of prose below each element, and of short text right in a container."""

    all: int
    text: array
    prose: array
    direct: array
    around: array  # the nearest container around each element


def weigh(p: Page) -> Weights:
    n = len(p.tags)
    text, prose, direct, around = (array("q", bytes(8 * n)) for _ in range(4))
    for i in range(n):
        a = p.up[i]
        around[i] = -1 if a < 0 else a if p.tags[a] in _CONTAINERS else around[a]
    total = 0
    for b in p.blocks:
        worth = max(0, len(b.text) - b.links)
        total += worth
        if b.element < 0:
            continue
        text[b.element] += worth
        real = worth >= UNLINKED * len(b.text)
        if real and worth >= PROSE:
            prose[b.element] += worth
        if real and worth and p.tags[b.element] == "p" and (a := around[b.element]) >= 0:
            direct[a] += worth
    for i in range(n - 1, -1, -1):
        if (a := p.up[i]) >= 0:
            text[a] += text[i]
            prose[a] += prose[i]
    return Weights(total, text, prose, direct, around)


def by_path(p: Page, w: Weights) -> dict[int, int]:
    """Unlinked characters below the containers on each path."""
    out: dict[int, int] = {}
    for i, tag in enumerate(p.tags):
        if tag in _CONTAINERS and not p.out[i] and w.text[i]:
            out[p.path[i]] = out.get(p.path[i], 0) + w.text[i]
    return out


def best_path(p: Page, w: Weights, paths: dict[int, int]) -> int | None:
    """The path of the container that the page takes for its main part; None if that is the whole page."""
    titled = set()
    for i, tag in enumerate(p.tags):
        if tag == "h1" and not p.out[i]:
            at = p.up[i]
            while at >= 0 and at not in titled:
                titled.add(at)
                at = p.up[at]
    start = -1
    for tag in ("article", "main"):
        own = [i for i, t in enumerate(p.tags) if t == tag and not p.out[i] and w.text[i]]
        if own:
            best = max(own, key=lambda i: (paths[p.path[i]], -i))
            if paths[p.path[best]] >= 0.4 * w.all or any(i in titled for i in own if p.path[i] == p.path[best]):
                if tag == "article":
                    return p.path[best]
                start = best
                break
    inner: dict[int, int] = {}
    for i, tag in enumerate(p.tags):
        if tag in _CONTAINERS and not p.out[i] and w.text[i]:
            a = w.around[i]
            if a not in inner or w.text[i] > w.text[inner[a]]:
                inner[a] = i
    at = start
    while at in inner:
        c = inner[at]
        here, prose = (w.text[at], w.prose[at]) if at >= 0 else (w.all, sum(w.prose[i] for i, a in enumerate(p.up) if a < 0))
        if 2 * w.text[c] < here or prose - w.prose[c] > BESIDE * w.text[c] or at >= 0 and p.tags[at] != "body" and w.direct[at]:
            break
        at = c
    return p.path[at] if at >= 0 else None


def votes(page: str | None) -> list[tuple[int, float, bool]]:
    """A page's paths with text: the path, its share of the page's text, and whether the page votes for it."""
    p = read(page)
    w = weigh(p)
    paths = by_path(p, w)
    best = best_path(p, w, paths)
    return [(x, n / w.all, x == best) for x, n in paths.items()]


def _within(p: Page, roots: set[int]) -> list[str]:
    """Texts below the roots, after the level-1 headings that stand before the first root in an element around it."""
    inside = bytearray(len(p.tags))
    for i in range(len(inside)):
        inside[i] = i in roots or p.up[i] >= 0 and inside[p.up[i]]
    if not any(b.element >= 0 and inside[b.element] for b in p.blocks):
        return []
    first = min(roots)
    around, at = {-1}, p.up[first]
    while at >= 0:
        around.add(at)
        at = p.up[at]

    def title(b: Block) -> bool:
        if not 0 <= b.element < first or p.tags[b.element] != "h1":
            return False
        at = p.up[b.element]
        while at >= 0 and p.tags[at] not in _CONTAINERS:
            at = p.up[at]
        return at in around

    return [b.text for b in p.blocks if b.element >= 0 and inside[b.element] or title(b)]


def main_text(page: str | None, path: int | None) -> str:
    """The text on the winning path; without one, on the page's own best."""
    p = read(page)

    def on(path: int | None) -> list[str]:
        roots = {i for i, x in enumerate(p.path) if x == path and not p.out[i] and p.tags[i] in _CONTAINERS} if path is not None else set()
        return _within(p, roots) if roots else []

    chosen = on(path)
    if not chosen:
        w = weigh(p)
        chosen = on(best_path(p, w, by_path(p, w))) or [b.text for b in p.blocks]
    return "\n".join(chosen)


def host_of(url: str = "url"):
    """The host of a URL in lower case, without www. and port; "" if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def _vote(batches):
    for b in batches:
        rows = [(host, name, *x) for host, name, page in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("html").to_pylist()) for x in votes(page)]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["host", "page", "path", "share", "voted"])


def overruled(pages: DataFrame) -> DataFrame:
    """page, path: the pages for which another path than their own best wins. pages: host, page (a name of host and html), html."""
    cast = keep(pages.mapInArrow(_vote, "host string, page long, path long, share double, voted boolean"))
    count = [F.sum(F.col("voted").cast("double")).alias("v"), F.count("*").cast("double").alias("n")]
    own = keep(cast.groupBy("host", "path").agg(*count))
    everywhere = keep(own.groupBy("path").agg(F.sum("v").alias("av"), F.sum("n").alias("an")))
    v, n = everywhere.agg(F.sum("av"), F.sum("an")).head()
    base = v / n if n else 0.0
    prior = (F.col("av") + F.lit(PRIOR * base)) / (F.col("an") + F.lit(PRIOR))
    trust = keep(own.join(everywhere, "path").select("host", "path", ((F.col("v") + F.lit(PRIOR) * prior) / (F.col("n") + F.lit(PRIOR))).alias("trust")))
    # One row for each page and path, with either side written: AQE broadcasts a small trust table and splits hot hosts of a large one.
    worth = cast.join(trust, ["host", "path"]).withColumn("worth", F.col("trust") * F.pow("share", F.lit(EVIDENCE)))
    top = worth.groupBy("page").agg(F.max(F.struct("worth", "path", "voted")).alias("top"))
    return keep(top.where("NOT top.voted").select("page", F.col("top.path").alias("path")))


def _extract(batches):
    for b in batches:
        texts = [main_text(page, path) for page, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = only(pages, "page_id", "url", "html").withColumn("host", host_of()).withColumn("page", F.xxhash64("host", "html"))
    # Most pages follow their own vote; only the others' paths are looked up, so pages hardly ever travel.
    return with_few(pages, "page", overruled(pages.select("host", "page", "html"))).select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
