"""A best-effort PDF reader with the standard library: text with fonts and places, page sizes, embedded images.

It reads streams of all filters but those of fax and JBIG2 pictures, object streams, form objects, and fonts of one byte a
character (with Differences) or with a ToUnicode map. Embedded rasters become PNG files. Encrypted files are beyond it: such a
file gives an error row or pages without text, never a failed task, and a stream that grows beyond a bound is that file's error.
Pages can't be rastered here: a scanned page's picture is the largest image on it, and one without follows the path of a missing image.
"""

from __future__ import annotations

import contextlib
import re
import unicodedata
from dataclasses import dataclass, field

from lectern.sources.streams import ascii85, ascii_hex, inflate, lzw, raster_png, run_length, unpredict

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(rb"""[\x00\t\n\f\r ]+|%[^\r\n]*|(<<|>>|\[|\]|\{|\})|/([^\x00\t\n\f\r ()<>\[\]{}/%]*)|(\()|<([0-9A-Fa-f\x00\t\n\f\r ]*)>|([+-]?(?:\d+\.?\d*|\.\d+))|([^\x00\t\n\f\r ()<>\[\]{}/%]+)""")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


_CODES = {"ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length}
#: Glyph names that neither a rule nor the names of Greek letters and digits give.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•",
    "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "oe": "œ",
    "summation": "∑", "integral": "∫", "product": "∏", "radical": "√", "partialdiff": "∂", "infinity": "∞", "plusminus": "±", "multiply": "×", "divide": "÷", "approxequal": "≈", "notequal": "≠",
    "lessequal": "≤", "greaterequal": "≥", "element": "∈", "arrowright": "→", "arrowleft": "←", "universal": "∀", "existential": "∃", "gradient": "∇", "similar": "∼", "proportional": "∝",
}


def glyph(name: str) -> str:
    """The characters that a glyph name stands for, "" if none is known."""
    name = name.partition(".")[0]
    if len(name) == 1 or name in _GLYPHS:
        return _GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = re.findall("....", m[1]) if m[1] else [m[2]]
        return "".join(chr(int(x, 16)) for x in codes if int(x, 16) < 0x110000 and not 0xD800 <= int(x, 16) < 0xE000)
    case = "SMALL" if name.islower() else "CAPITAL"
    letter = re.fullmatch(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|ring|cedilla|caron)", name)
    accents = {"dieresis": "DIAERESIS", "ring": "RING ABOVE"}
    names = [f"DIGIT {name.upper()}", f"GREEK {case} LETTER {name.upper()}"]
    if letter:
        names.insert(0, f"LATIN {'SMALL' if letter[1].islower() else 'CAPITAL'} LETTER {letter[1].upper()} WITH {accents.get(letter[2], letter[2].upper())}")
    for x in names:
        with contextlib.suppress(KeyError):
            return unicodedata.lookup(x)
    return ""


class Name(str):
    """A PDF name."""


class Op(str):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Span:
    text: str
    font: str
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass
class Image:
    xref: int
    width: int
    height: int
    ext: str
    data: bytes


@dataclass
class Page:
    width: float
    height: float
    lines: list[list[Span]] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join("".join(s.text for s in line) for line in self.lines)


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that opened just before ``at``."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            at += 1
            if e in _ESCAPES:
                out += _ESCAPES[e]
            elif e and e in b"01234567":
                m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif e == b"\r":
                at += data[at : at + 1] == b"\n"
            elif e != b"\n":
                out += e
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0):
    """Tokens and the place after each."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m[1]:
            yield Op(m[1].decode("latin-1")), at
        elif m[2] is not None:
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[2].decode("latin-1"))), at
        elif m[3]:
            text, at = _literal(data, at)
            yield text, at
        elif m[4] is not None:
            h = re.sub(rb"\s|\x00", b"", m[4])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
        elif m[5]:
            yield float(m[5]) if b"." in m[5] else int(m[5]), at
        elif m[6]:
            yield Op(m[6].decode("latin-1")), at


def parse(data: bytes, at: int = 0):
    """The first value from ``at`` on, and the place after it."""
    stack: list[list] = [[]]
    opened: list[str] = []
    for token, at in tokens(data, at):
        if isinstance(token, Op):
            if token in ("<<", "["):
                opened.append(token)
                stack.append([])
                continue
            if token in (">>", "]"):
                if not opened:
                    break
                items, kind = stack.pop(), opened.pop()
                stack[-1].append(dict(zip(items[::2], items[1::2])) if kind == "<<" else items)
            elif token == "R" and len(stack[-1]) >= 2:
                _, number = stack[-1].pop(), stack[-1].pop()
                stack[-1].append(Ref(number) if isinstance(number, int) else None)
            elif token in ("true", "false", "null"):
                stack[-1].append({"true": True, "false": False}.get(token))
            elif not opened:
                break
        else:
            stack[-1].append(token)
        if not opened and stack[0] and isinstance(stack[0][0], (dict, list)):
            break
    return (stack[0][0] if stack[0] else None), at


class File:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data = data
        self.at = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.held: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted PDF files aren't read")
        for number in list(self.at):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body, first = self.stream(number), int(self.get(value.get("First")) or 0)
                heads = [t for t, _ in tokens(body[:first]) if isinstance(t, int)]
                for inner, offset in zip(heads[::2], heads[1::2]):
                    if inner not in self.at:
                        self.held[inner] = parse(body, first + offset)[0]

    def get(self, x):
        """What a reference stands for; any other value as it is."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.held:
                self.held[x.number] = parse(self.data, self.at[x.number])[0] if x.number in self.at else None
            x = self.held[x.number]
        return None

    def stream(self, number: int) -> bytes:
        """The decoded bytes of a stream object; raw bytes of a picture's own format."""
        if number not in self.streams:
            head, at = parse(self.data, self.at[number])
            m = re.compile(rb"\s*stream\r?\n?").match(self.data, at)
            body = b""
            if m and isinstance(head, dict):
                size = self.get(head.get("Length"))
                end = m.end() + size if isinstance(size, int) else -1
                if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                    end = self.data.find(b"endstream", m.end())
                body = self.data[m.end() : end if end >= 0 else None]
                given = self.get(head.get("DecodeParms"))
                given = [self.get(x) for x in given] if isinstance(given, list) else [given]
                for k, f in enumerate(self.filters(head)):
                    parms = given[k] if k < len(given) and isinstance(given[k], dict) else {}
                    parm = lambda x, other: v if isinstance(v := self.get(parms.get(x)), int) else other  # noqa: B023, E731
                    if f in ("FlateDecode", "Fl", "LZWDecode", "LZW"):
                        body = inflate(body) if f.startswith("Fl") else lzw(body, parm("EarlyChange", 1))
                        body = unpredict(body, parm("Predictor", 1), parm("Colors", 1), parm("BitsPerComponent", 8), parm("Columns", 1))
                    elif f in _CODES:
                        body = _CODES[f](body)
            self.streams[number] = body
        return self.streams[number]

    def filters(self, head: dict) -> list[str]:
        f = self.get(head.get("Filter"))
        return [self.get(x) for x in f] if isinstance(f, list) else [f] if f else []

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited entries."""
        root = next((v for n in sorted(set(self.at) | set(self.held), reverse=True) if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Catalog"), {})
        out: list[dict] = []

        def walk(node, given: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 50:
                return
            given = given | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, given, depth + 1)
            else:
                out.append(given | node)

        walk(root.get("Pages"), {}, 0)
        return out


class Font:
    """Name of a font, and characters of its codes."""

    def __init__(self, file: File, entry):
        d = file.get(entry)
        d = d if isinstance(d, dict) else {}
        self.name = str(file.get(d.get("BaseFont")) or "")
        self.wide = d.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        encoding = file.get(d.get("Encoding"))
        if isinstance(encoding, dict) and not self.wide:
            code = 0
            for x in file.get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    self.map[code] = glyph(x)
                    code += 1
                elif isinstance(x, int):
                    code = x
        first, widths = file.get(d.get("FirstChar")), file.get(d.get("Widths"))
        self.widths = {first + k: file.get(x) / 1000 for k, x in enumerate(widths) if isinstance(file.get(x), (int, float))} if isinstance(first, int) and isinstance(widths, list) else {}
        if isinstance(d.get("ToUnicode"), Ref):
            self._read(file.stream(d["ToUnicode"].number))

    def _read(self, cmap: bytes) -> None:
        stack: list = []
        text = lambda b: b.decode("utf-16-be", "replace")
        for t, _ in tokens(cmap):
            if isinstance(t, Op) and t == "[":
                stack.append([])
            elif isinstance(t, bytes) and stack and isinstance(stack[-1], list):
                stack[-1].append(t)
            elif isinstance(t, Op) and t == "]":
                stack.append(None)
            elif isinstance(t, Op) and t in ("beginbfchar", "beginbfrange"):
                stack = []
            elif isinstance(t, Op) and t == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2]):
                    self.map[int.from_bytes(a)] = text(b)
            elif isinstance(t, Op) and t == "endbfrange":
                flat = [x for x in stack if x is not None]
                for lo, hi, to in zip(flat[::3], flat[1::3], flat[2::3]):
                    for k in range(int.from_bytes(lo), min(int.from_bytes(hi), int.from_bytes(lo) + 65535) + 1):
                        n = k - int.from_bytes(lo)
                        self.map[k] = (text(to[n]) if n < len(to) else "") if isinstance(to, list) else text(to[:-2] + (int.from_bytes(to[-2:]) + n & 0xFFFF).to_bytes(2))
            elif isinstance(t, bytes):
                stack.append(t)

    def decode(self, raw: bytes) -> str:
        codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)] if self.wide else list(raw)
        return "".join(self.map.get(c) or ("" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)


def _text(file: File, page: dict, height: float) -> list[list[Span]]:
    """Lines of spans in the order of the content; a line ends where the baseline moves."""
    contents = page.get("Contents")
    parts = file.get(contents)
    numbers = [x.number for x in parts if isinstance(x, Ref)] if isinstance(parts, list) else [contents.number] if isinstance(contents, Ref) else []
    data = b"\n".join(file.stream(n) for n in numbers if n in file.at)
    lines: list[list[Span]] = []
    _show(file, data, file.get(page.get("Resources")) or {}, height, lines, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 0)
    return [x for x in lines if x]


#: How deep form objects may lie in one another.
DEEPEST = 12


def _show(file: File, data: bytes, resources: dict, height: float, lines: list[list[Span]], ctm: list[float], depth: int) -> None:
    """Append the lines that a content stream shows, and those of the form objects it draws."""
    fonts = {k: Font(file, v) for k, v in (file.get(resources.get("Font")) or {}).items()}
    objects = file.get(resources.get("XObject")) or {}
    args: list = []
    font, size, lead = None, 0.0, 0.0
    saved: list[list[float]] = []
    line, text = list(ctm), list(ctm)
    arrays: list[list] = []
    base: float | None = None

    def times(a: list[float], b: list[float]) -> list[float]:
        return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]

    def move(x: float, y: float) -> None:
        nonlocal line, text
        line = times([1, 0, 0, 1, x, y], line)
        text = list(line)

    def show(raw: bytes) -> None:
        nonlocal text, base
        s = font.decode(raw) if font else raw.decode("cp1252", "replace")
        if not s:
            return
        place = times(text, ctm)
        tall = abs(size * (place[3] or place[0] or 1.0))
        codes = raw if font and not font.wide and font.widths else b""
        ems = sum(font.widths.get(c, 0.5) for c in codes) if codes else 0.5 * len(s)  # without widths, half the height for each
        wide = tall * ems
        y = height - place[5]
        span = Span(s, font.name if font else "", place[4], y - tall, place[4] + wide, y)
        if base is None or abs(y - base) > 0.3 * max(tall, 1.0):
            lines.append([])
        elif lines[-1] and place[4] - lines[-1][-1].x1 > 0.3 * tall and not lines[-1][-1].text.endswith(" "):
            lines[-1][-1].text += " "
        base = y
        lines[-1].append(span)
        text = times([1, 0, 0, 1, size * ems, 0], text)

    number = lambda k: float(args[k]) if len(args) >= -k and isinstance(args[k], (int, float)) else 0.0
    for t, _ in tokens(data):
        if not isinstance(t, Op):
            (arrays[-1] if arrays else args).append(t)
            continue
        if t == "[":
            arrays.append([])
            continue
        if t == "]" and arrays:
            done = arrays.pop()
            (arrays[-1] if arrays else args).append(done)
            continue
        if t == "q":
            saved.append(list(ctm))
        elif t == "Q" and saved:
            ctm = saved.pop()
        elif t == "cm":
            ctm = times([number(k) for k in range(-6, 0)], ctm)
        elif t == "BT":
            line = text = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
        elif t == "Tf" and len(args) >= 2:
            font, size = fonts.get(args[-2]), number(-1)
        elif t == "TL":
            lead = number(-1)
        elif t in ("Td", "TD"):
            lead = -number(-1) if t == "TD" else lead
            move(number(-2), number(-1))
        elif t == "Tm":
            line = [number(k) for k in range(-6, 0)]
            text = list(line)
        elif t == "T*":
            move(0, -lead)
        elif t == "Tj" and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif t in ("'", '"') and args and isinstance(args[-1], bytes):
            move(0, -lead)
            show(args[-1])
        elif t == "TJ" and args and isinstance(args[-1], list):
            joined = bytearray()
            for x in args[-1]:
                if isinstance(x, bytes):
                    joined += x
                elif isinstance(x, (int, float)) and x < -200 and not (font and font.wide):
                    joined += b" "
            show(bytes(joined))
        elif t == "Do" and args and depth < DEEPEST and isinstance(ref := objects.get(args[-1]), Ref):
            form = file.get(ref)
            if isinstance(form, dict) and form.get("Subtype") == "Form":
                matrix = [float(file.get(x) or 0) for x in file.get(form.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                _show(file, file.stream(ref.number), file.get(form.get("Resources")) or resources, height, lines, times(matrix, ctm), depth + 1)
                base = None
        args = []


def _colors(file: File, space) -> tuple[int, bytes | None]:
    """Colours of a colour space, and its palette as RGB if it has one; (0, None) if it isn't known."""
    space = file.get(space)
    plain = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}
    if isinstance(space, Name):
        return plain.get(space, 0), None
    if isinstance(space, list) and space:
        kind = file.get(space[0])
        if kind == "ICCBased" and len(space) > 1 and isinstance(profile := file.get(space[1]), dict):
            return int(file.get(profile.get("N")) or 0), None
        if kind in ("Indexed", "I") and len(space) > 3:
            base, _ = _colors(file, space[1])
            table = file.stream(space[3].number) if isinstance(space[3], Ref) and isinstance(file.get(space[3]), dict) else file.get(space[3])
            if isinstance(table, bytes) and base in (1, 3):
                return 1, b"".join(bytes([x]) * 3 for x in table) if base == 1 else table
            return 0, None
        return plain.get(kind, 0), None
    return 0, None


def _images(file: File, page: dict) -> list[Image]:
    """Images of a page and of the form objects on it: JPEG as it is, rasters as PNG, others in their own bytes."""
    out: list[Image] = []
    seen: set[int] = set()

    def walk(resources, depth: int) -> None:
        for ref in (file.get((file.get(resources) or {}).get("XObject")) or {}).values():
            d = file.get(ref)
            if not isinstance(ref, Ref) or not isinstance(d, dict) or ref.number in seen:
                continue
            seen.add(ref.number)
            if d.get("Subtype") == "Form" and depth < DEEPEST:
                walk(d.get("Resources"), depth + 1)
            elif d.get("Subtype") == "Image":
                number = lambda k, other=0: int(v) if isinstance(v := file.get(d.get(k)), (int, float)) else other  # noqa: B023, E731
                width, height, data = number("Width"), number("Height"), file.stream(ref.number)
                ext = {"DCTDecode": "jpeg", "DCT": "jpeg", "JPXDecode": "jpx", "CCITTFaxDecode": "bin", "CCF": "bin", "JBIG2Decode": "bin"}.get((file.filters(d) or [""])[-1])
                if ext is None:
                    mask = file.get(d.get("ImageMask")) is True or d.get("ImageMask") == "true"
                    colors, palette = (1, None) if mask else _colors(file, d.get("ColorSpace"))
                    decode = file.get(d.get("Decode"))
                    made = raster_png(width, height, 1 if mask else number("BitsPerComponent", 8), colors, data, palette, isinstance(decode, list) and len(decode) > 1 and palette is None and decode[0] == 1) if colors else None
                    ext, data = ("png", made) if made else ("bin", data)
                out.append(Image(ref.number, width, height, ext, data))

    walk(page.get("Resources"), 0)
    return out


def read_pdf(content: bytes) -> list[Page]:
    """Pages of a file."""
    file, out = File(content), []
    for page in file.pages():
        box = [float(file.get(x) or 0) for x in (file.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        width, height = box[2] - box[0], box[3] - box[1]
        out.append(Page(width, height, _text(file, page, height), _images(file, page)))
    return out
