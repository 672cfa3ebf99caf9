"""Markdown lint as one chain of expressions: trailing space, tabs, blank lines, heading marks, blank lines round headings.

What isn't prose is left alone: front matter, fenced code, raw HTML blocks and comments. Each such block is taken out, a mark
stands in its place as one word while the rules run, and it is put back as it was. A block that is never closed goes on to the
end. The rule is the same for texts of any length.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import RARE_LINE_ENDS
from lectern.functions.text import _c, has_any, let, lines

#: Fixed values: (rule, pattern, replacement) in the order in which they apply; a rule sees what the ones before it left.
RULES = (
    ("MD009", r"(?md)[ \t]+$", ""),
    ("MD010", r"\t", "    "),
    ("MD012", r"\n{3,}", "\n\n"),
    ("MD018", r"(?md)^(#{1,6})([^ #\n])", r"$1 $2"),
    ("MD022", r"([^\n])\n(#{1,6} )", "$1\n\n$2"),
    ("MD022", r"(?md)^(#{1,6} .+)\n([^\n#])", "$1\n\n$2"),
)
#: What the rules begin at: most texts have none of it, which is seen without a pattern.
_TAB, _GAP = lambda t: t.contains("\t"), lambda t: t.contains("\n\n\n")
_HEAD = lambda t: t.startswith("#") | t.contains("\n#")
_TRAIL = lambda t: has_any(t, [" \n", "\t\n"]) | t.endswith(" ") | t.endswith("\t")
_MAY = {"MD009": _TRAIL, "MD010": _TAB, "MD012": _GAP, "MD018": _HEAD, "MD022": _HEAD}
#: Headings that a rule speaks of: no space or several after the marks, or a line beside them that isn't blank.
_BAD_HEAD = r"(?md)^#{1,6}(?:[^ #\n]|  | [^\n]*\n[^\n])|[^\n]\n#{1,6} "
#: What a second scan says of each rule.
SAYS = {
    "MD009": "Trailing spaces", "MD010": "Hard tabs", "MD012": "Multiple consecutive blank lines", "MD018": "No space after hash of heading", "MD019": "Multiple spaces after hash of heading",
    "MD022": "Headings should be surrounded by blank lines", "MD023": "Headings must start at the beginning of the line", "MD047": "Files should end with a single newline character",
}
#: Texts above this many bytes are marked as linted fast. compat: there the rules look into blocks too, as they did.
FAST_ABOVE = 512 * 1024
#: Stands for a block. In a text of its own it is taken out and put back like one.
MARK = "\ue000"
_END = r"(?=\n*\z)"
#: Front matter; fences of backticks and of tildes, closed by one at least as long; HTML blocks up to their end tag; comments.
BLOCK = (
    r"(?msd)\A---[ \t]*$.*?^(?:---|\.\.\.)[ \t]*$"
    rf"|^ {{0,3}}(`{{3,}})[^`\n]*$.*?(?:^ {{0,3}}\1`*[ \t]*$|{_END})"
    rf"|^ {{0,3}}(~{{3,}})[^\n]*$.*?(?:^ {{0,3}}\2~*[ \t]*$|{_END})"
    rf"|^ {{0,3}}<(pre|script|style|textarea)(?=[ \t>\n]).*?(?:</\3>[^\n]*$|{_END})"
    rf"|^ {{0,3}}<!--.*?(?:-->[^\n]*$|{_END})"
    rf"|{MARK}"
)


def has_blocks(text: Column) -> Column:
    """Whether a text has a block; most have nothing that begins one, which is quickly seen."""
    some = F.startswith(text, F.lit("---"))
    for x in ("```", "~~~", "<", MARK):
        some = some | text.contains(x)
    return some & text.rlike(BLOCK)


def _woven(pieces: Column, blocks: Column) -> Column:
    return F.array_join(F.zip_with(pieces, blocks, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def outside(x, rules) -> Column:
    """The text with rules (a function of a text column) applied to all but its blocks."""
    text = _c(x)
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))
    return F.when(has_blocks(text), _woven(F.split(rules(F.regexp_replace(text, BLOCK, MARK)), MARK, -1), blocks)).otherwise(rules(text))


def prose(x) -> Column:
    """The text with a mark in place of each line of a block, so that line numbers stay."""
    text = _c(x)
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda b: F.array_join(F.array_repeat(F.lit(MARK), F.size(F.split(b, "\n", -1))), "\n"))
    return F.when(has_blocks(text), _woven(F.split(text, BLOCK, -1), blocks)).otherwise(text)


def fixed(x) -> Column:
    """The text after all rules, ending in one line feed; blocks as they were."""
    return outside(x, fixed_throughout)


def _apply(rule: str, pattern: str, to: str, text: Column) -> Column:
    return F.when(_MAY[rule](text), F.regexp_replace(text, pattern, to)).otherwise(text)


def fixed_throughout(x) -> Column:
    """The text after all rules, which look into blocks too."""
    out = _c(x)
    for rule, pattern, to in RULES:
        out = let(out, partial(_apply, rule, pattern, to))
    return F.concat(F.rtrim(out, F.lit("\n")), F.lit("\n"))


def changed_lines(before, after) -> Column:
    """Lines that differ place by place, and how many more the longer text has. Equal texts have none."""
    zero = F.lit(0).cast("long")

    def count(s: Column) -> Column:
        n = F.least(F.size(s["a"]), F.size(s["b"]))
        other = F.zip_with(F.slice(s["a"], F.lit(1), n), F.slice(s["b"], F.lit(1), n), lambda x, y: (x != y).cast("long"))
        return F.aggregate(other, zero, lambda t, x: t + x) + F.abs(F.size(s["a"]) - F.size(s["b"])).cast("long")

    both = let(F.struct(lines(before).alias("a"), lines(after).alias("b")), count)
    b = _c(before)
    ended = reduce(lambda p, q: p | q, [b.endswith(c) for c in "\n" + RARE_LINE_ENDS])
    last = (b != "") & ~ended & (_c(after) == F.concat(b, F.lit("\n")))  # a line feed at the end is all that came
    return F.when((b == _c(after)) | last, zero).otherwise(both)


def failures(x) -> Column:
    """What the rules find in a text's prose: an entry "RULE:line:column words" for each place, by line and then by rule.

    A text in which no rule finds anything is known as a whole; only the others are looked at line by line.
    """
    return let(prose(x), lambda t: F.when(clean(t), F.array().cast("array<string>")).otherwise(_failures(t)))


def clean(text: Column) -> Column:
    """Whether the line-by-line rules find nothing in a text (a few texts that they find nothing in aren't known)."""
    found = _TRAIL(text) | _TAB(text) | _GAP(text) | text.startswith("\n\n") | (_HEAD(text) & text.rlike(_BAD_HEAD))
    indented = reduce(lambda p, q: p | q, [text.startswith(s) | text.contains("\n" + s) for s in (" #", "  #", "   #")])
    return text.endswith("\n") & ~text.endswith("\n\n") & (text != "\n") & ~found & ~indented


def _failures(text: Column) -> Column:
    place = F.struct
    empty = F.array().cast("array<struct<no:int,rule:string,col:int>>")

    def around(rows: Column) -> Column:
        return F.transform(rows, lambda t, i: place((i + 1).cast("int").alias("no"), t.alias("t"), F.get(rows, i - 1).alias("up"), F.get(rows, i + 1).alias("down")))

    def by_line(rows: Column) -> Column:
        def found(rule: str, test, col=None) -> Column:
            return F.transform(F.filter(rows, test), lambda s: place(s["no"].alias("no"), F.lit(rule).alias("rule"), (F.lit(1) if col is None else col(s["t"])).cast("int").alias("col")))

        filled = lambda t: F.coalesce(t != "", F.lit(False))
        return F.flatten(
            F.array(
                found("MD009", lambda s: s["t"].rlike(r"[ \t]+\z"), lambda t: F.length(F.regexp_replace(t, r"[ \t]+\z", "")) + 1),
                found("MD010", lambda s: s["t"].contains("\t"), lambda t: F.instr(t, "\t")),
                found("MD012", lambda s: (s["t"] == "") & F.coalesce(s["up"] == "", F.lit(False)) & s["down"].isNotNull()),
                found("MD018", lambda s: s["t"].rlike(r"\A#{1,6}[^ #]")),
                found("MD019", lambda s: s["t"].rlike(r"\A#{1,6}  ")),
                found("MD022", lambda s: s["t"].rlike(r"\A#{1,6} ") & (filled(s["up"]) | filled(s["down"]))),
                found("MD023", lambda s: s["t"].rlike(r"\A {1,3}#{1,6} ")),
                F.when(text.rlike(r"[^\n]\n\z"), empty).otherwise(F.array(place(F.size(rows).alias("no"), F.lit("MD047").alias("rule"), F.lit(1).alias("col")))),
            )
        )

    says = F.create_map(*[F.lit(v) for kv in SAYS.items() for v in kv])
    named = lambda s: F.concat(s["rule"], F.lit(":"), s["no"].cast("string"), F.lit(":"), s["col"].cast("string"), F.lit(" "), F.element_at(says, s["rule"]))
    return F.transform(F.array_sort(let(let(F.split(text, "\n", -1), around), by_line)), named)


def lint(docs: DataFrame, text: str = "markdown", compat: bool = False) -> DataFrame:
    """docs with its text fixed and found (failures before), fixed_count (changed lines), remaining_failures, fast_mode.

    fast_mode marks texts above FAST_ABOVE bytes. The rules change nothing where nothing is found, and what they leave as it
    was isn't scanned again. A null text stays null, with nothing found or fixed.
    """
    none = F.array().cast("array<string>")
    fast = F.coalesce(F.octet_length(F.col(text)) > FAST_ABOVE, F.lit(False))
    out = docs.withColumn("fast_mode", fast)
    out = out.withColumn("_fixed", F.when(F.col("fast_mode"), fixed_throughout(text)).otherwise(fixed(text)) if compat else fixed(text))
    left = F.when(F.col("_fixed").isNull(), none).when(F.col("_fixed") == F.col(text), failures(text)).otherwise(failures("_fixed"))
    return (
        out.withColumn("found", F.coalesce(F.when(F.col(text).isNotNull(), F.size(failures(text)).cast("long")), F.lit(0).cast("long")))
        .withColumn("fixed_count", F.coalesce(changed_lines(text, "_fixed"), F.lit(0).cast("long")))
        .withColumn("remaining_failures", left)
        .withColumn(text, F.col("_fixed"))
        .drop("_fixed")
    )


def lint_totals(linted: DataFrame) -> DataFrame:
    """files, fixed, remaining, files_with_fixes over all linted documents."""
    return linted.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("fixed_count"), F.lit(0)).alias("fixed"),
        F.coalesce(F.sum(F.size("remaining_failures").cast("long")), F.lit(0)).alias("remaining"),
        F.coalesce(F.sum((F.col("fixed_count") > 0).cast("long")), F.lit(0)).alias("files_with_fixes"),
    )
