"""Host-level quality rules: document rules, failure rates by host under an empirical beta prior, verdicts joined back.

DataFrame functions only. Text is read once; what is known of a document then is a short row in the shared folder.

A document fails the base if it has under 20 words or over 30 % of its words lie in 8-word windows that its text holds
twice. It is weak if it fails the base, or over 10 % of its word characters are symbols, or over 30 % of its lines repeat
earlier ones, or its mean word length is outside 2 to 15. A host's rate of weak documents is shrunk towards all hosts by a
beta prior, whose mean and strength are fitted to the hosts' rates by moments. A host with a posterior rate over 0.9 is
rejected: its weak documents go, whatever rule they failed. Others are kept, so a clean document never falls with its host.

Null text counts as empty: no words, base failed. A null host has no rate and no verdict. Repeated rows count as often as
they stand. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep

WORDS, REPEATED, WINDOW = 20, 30, 8
SYMBOLS, DUP_LINES, HOST_RATE = 10, 30, 0.9
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 10_000.0

_SPACE = r"[\\x20\\x09-\\x0D]+"
#: Words in windows that stand twice: window names sorted with their places; neighbours that agree mark places; each
#: marked place covers up to the next marked one, 8 words at most.
_COVERED = f"""
CASE WHEN size(names) = size(array_distinct(names)) THEN 0L ELSE
  transform(array(array_sort(transform(names, (h, i) -> struct(h, i)))), s ->
    transform(array(array_sort(transform(filter(sequence(0, size(s) - 1), j -> s[j].h = get(s, j - 1).h OR s[j].h = get(s, j + 1).h), j -> s[j].i))), p ->
      aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + least({WINDOW}, coalesce(get(p, k + 1) - p[k], {WINDOW}))))[0])[0] END"""


#: The rules as columns over text and host, in steps that need one another.
_STEPS = (
    {"t": "coalesce(text, '')"},
    {"w": f"array_remove(split(t, '{_SPACE}', -1), '')", "l": r"filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"},
    {"names": f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) ELSE array() END"},
    {
        "n_words": "cast(size(w) AS long)",
        "word_chars": "cast(length(array_join(w, '')) AS long)",
        "n_symbols": "cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) AS long)",
        "n_lines": "cast(size(l) AS long)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) AS long)",
        "n_repeat_words": _COVERED,
    },
    {"base_failed": f"n_words < {WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words"},
    {"weak": f"base_failed OR 100 * n_symbols > {SYMBOLS} * word_chars OR 100 * n_dup_lines > {DUP_LINES} * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words"},
)
_RULES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "weak")
_VERDICT = f"NOT (base_failed OR (weak AND coalesce(host_rate > {HOST_RATE}, false)))"


def _ruled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the rules of rows with a column text."""
    kept = [*keys, "text"]
    for step in _STEPS:
        rows = rows.select(*kept, *[F.expr(e).alias(c) for c, e in step.items()])
        kept = [c for c in rows.columns if c not in ("text", "names") and not (c in ("t", "w", "l") and "n_words" in rows.columns)]
    return rows.select(*keys, *_RULES)


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, weak by row."""
    return _ruled(docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), "text"), ["doc_id", "host"])


def host_rates(rules: DataFrame) -> DataFrame:
    """host, docs, weak_docs, rate: posterior mean rate of weak documents."""
    hosts = keep(rules.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("weak").cast("long")).alias("weak_docs")))
    m, n, k, sq = hosts.agg(F.sum("weak_docs") / F.sum("docs"), F.sum("docs"), F.count("*"), F.sum(F.col("weak_docs") * F.col("weak_docs") / F.col("docs"))).head()
    m, n, k = m or 0.0, n or 0, k or 0
    between = (sq - n * m * m - (k - 1) * m * (1 - m)) / (n - k / max(k, 1)) if n > 1 and k else 0.0
    strength = min(STRONGEST, max(WEAKEST, m * (1 - m) / between - 1)) if between > 0 else STRONGEST
    return hosts.withColumn("rate", (F.col("weak_docs") + F.lit(m * strength)) / (F.col("docs") + F.lit(strength)))


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rules of every row, host_rate and kept."""
    rules = keep(document_rules(docs, host))
    rates = host_rates(rules).select("host", F.col("rate").alias("host_rate"))
    return rules.join(rates, "host", "left").withColumn("kept", F.expr(_VERDICT))


def kept_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rules are worked out once: the rows that pass the base are
    written with their rules, those that fail it only count for their host."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{host}`").cast("string").alias("host"), "text")
    # A filter or a projection doesn't move below a column that isn't deterministic: there it would work out the rules once for each use.
    rows = _ruled(rows, ["doc", "host"]).withColumn("at", F.spark_partition_id()).where("at >= 0")
    rows = keep(rows.select(F.when(~F.col("base_failed"), F.col("doc")).alias("doc"), "host", "base_failed", "weak"))
    rates = keep(host_rates(rows.select("host", "weak")).select("host", F.col("rate").alias("host_rate")))
    return rows.where("NOT base_failed").join(rates, "host", "left").where(_VERDICT).select("doc.*")
