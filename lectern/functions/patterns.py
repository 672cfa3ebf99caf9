"""Regular expressions whose meaning doesn't change between Java and RE2.

Java needs (?d) so that only a line feed ends a line; ``\\s`` and ``\\w`` are ASCII in both, so classes are spelt out.
"""

#: The characters that count as white space in Unicode text processing.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, one after the other, and those of them beside line feed and space.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
RARE_WS = WS_CHARS.replace("\n", "").replace(" ", "")
#: Words: letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"
IMAGE_REF = r"(?d)!\[image\]\((.+?)\)"
OCR_REF = r"(?d)!\[ocr\]\((.+?)\)"
FORMULA_REF = r"<<FORMULA:(\d+)>>"
SECTION_START = r"(?md)(?=^## .+$)"
SECTION_HEAD = r"(?d)\A(## .+)"
CHUNK_START = r"(?md)(?=^## )"
HEADING = rf"(?md)^#{{1,3}}{WS}+(.+)$"
#: Line ends as a text's reader takes them: ten characters and the pair CR LF.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: What may end a line beside the line feed.
RARE_LINE_ENDS = "\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Characters that speak for mathematics.
MATH_RANGES = r"\x{0391}-\x{03C9}\x{2070}-\x{209F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2300}-\x{23FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{1D400}-\x{1D7FF}"
MATH_SIGNS = "∫∑∏√∂∇∞±∓×÷≈≠≤≥≡∈∉⊂⊃∪∩∧∨¬∀∃∅αβγδεζηθικλμνξπρστυφχψω"
NOT_MATH = rf"[^{MATH_RANGES}{MATH_SIGNS}]"
#: Parts of font names that speak for mathematics.
MATH_FONTS = ("symbol", "cambria math", "cmmi", "cmsy", "cmex", "cmr", "mt extra", "math", "euclid", "asana math", "xits math", "stix", "latin modern math", "libertinus math")
