"""The registered queries of this subpackage: whole tables in, contract columns out; and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_spec() -> tuple[str, str, str]:
    """Paths of the vocabulary files, which every machine has, and the pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Rows of which crc32(doc_id as text) modulo FOLDS is 0 are never learnt from.
FOLDS = 5


def _held_out(column: str = "doc_id"):
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.recompress import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.license_scan import scan_licenses

    docs = _table(spark, sf_dir, "documents")
    return scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))), "path")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_eb import quality

    labels = _table(spark, sf_dir, "labels").where(~_held_out())
    out = quality(_table(spark, sf_dir, "documents"), labels, "source", "lang")
    return out.select("doc_id", _held_out().alias("held_out"), "evidence", "host_posterior", "path_posterior", "posterior", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langid import fit, predict, training_sample

    docs = _table(spark, sf_dir, "documents")
    sample = training_sample(docs.where(~_held_out()))
    trees = fit((lang, text.encode()) for lang, text in sample.toLocalIterator())
    return predict(docs, trees).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_spec())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.toxicity import gather, learn, restored, sample, score

    docs = _table(spark, sf_dir, "documents")
    rows = sample(docs, _table(spark, sf_dir, "labels").where(~_held_out()))
    words = restored(gather(docs))
    out = score(docs, learn(rows, words), words)
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_rules import quality_verdicts

    out = quality_verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.prefix_trie import prefix_trie, rebuilt, turn_arrays

    return prefix_trie(rebuilt(turn_arrays(_table(spark, sf_dir, "conversations"))))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from lectern.llm.bpe_codec import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scans, op3_decontamination, op4_ngram_jaccard, op5_quality_classifier, op6_language_id, op7_best_fit_packing, op8_toxicity, op9_quality_rules, op10_html_extraction, op11_prefix_trie, op12_bpe_codec)}

#: Words of a text as every contract has them (DuckDB).
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)""",
    "op1_substring_dedup": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p+34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM w WHERE len(w) >= 35)),
hit AS (SELECT doc_id, p FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM hit),
each_ AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
rest AS (SELECT e.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS t FROM each_ e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(rest.kept, 0) AS n_removed, sha256(coalesce(rest.t, '')) AS kept_sha256
FROM w LEFT JOIN rest USING (doc_id)""",
    "op9_quality_rules": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 8)) AS p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS c FROM hit GROUP BY doc_id),
f AS (SELECT w.doc_id, source AS host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
r AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS weak FROM f),
h AS (SELECT host, count(*) AS docs, sum(weak::int) AS bad FROM r WHERE host IS NOT NULL GROUP BY host),
g AS (SELECT sum(bad) / sum(docs) AS m, sum(docs) AS n, count(*) AS k, sum(bad * bad / docs) AS sq FROM h),
b AS (SELECT m, (sq - n * m * m - (k - 1) * m * (1 - m)) / (n - 1) AS v FROM g),
p AS (SELECT m, CASE WHEN v > 0 THEN least(10000.0, greatest(2.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS s FROM b),
q AS (SELECT host, (bad + m * s) / (docs + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR (weak AND coalesce(rate > 0.9, false))) AS kept
FROM r LEFT JOIN q USING (host)""",
}

#: One step of CRC-32 (reflected polynomial 0xEDB88320), eight for each byte.
_CRC_STEP = "xor(x >> 1, 3988292384 * (x & 1))"

SQL["op11_prefix_trie"] = rf"""
WITH o AS MATERIALIZED (SELECT conv_id, name, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS k FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, len({_WORDS.format("text")}) AS words FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT conv_id, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)) AS digits FROM (SELECT DISTINCT conv_id FROM o)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::bigint], digits),
    lambda a, d: list_reduce(list_concat([xor(a, d::bigint)], range(8)), lambda x, i: {_CRC_STEP})), 4294967295) % 4 AS h FROM b),
r AS (SELECT c.conv_id, 0 AS own, k, name, words FROM c JOIN o ON o.conv_id = c.base AND o.k <= h UNION ALL SELECT conv_id, 1, k, name, words FROM c JOIN o USING (conv_id) WHERE k > h),
p AS MATERIALIZED (SELECT conv_id, words, row_number() OVER w AS d, string_agg(name, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
m AS (SELECT conv_id, d, path, words, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM (SELECT conv_id, d, path, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c)),
n AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, d),
kids AS MATERIALIZED (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
below AS (SELECT path, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT left(n.path, 64 * unnest(range(d + 1))) AS path, saved, (kids.path IS NULL)::int AS leaf FROM n LEFT JOIN kids USING (path)) GROUP BY path)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves::bigint AS n_leaves, below.saved::bigint AS saved_tokens, n.ends_sha256
FROM n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN n up ON n.d > 0 AND up.path = left(n.path, 64 * (n.d - 1))"""


def _license_sql() -> str:
    """op2 in SQL: the same constants, a line and a token a row."""
    from lectern.llm.license_scan import LEAST, TOKEN, Weights

    w = Weights()
    idf = ", ".join(f"('{t}', {x!r}::double)" for t, x in sorted(w.idf.items()))
    vectors = ", ".join(f"('{t}', {k}, '{name}', {x!r}::double)" for t, k, name, x in w.rows())
    return rf"""
WITH idf(token, idf) AS (VALUES {idf}), vec(token, template, license, weight) AS (VALUES {vectors}),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang) AS directory FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)),
words AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(t), '{TOKEN}')) AS token FROM lines),
n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
bag AS MATERIALIZED (SELECT doc_id, line, token, count(*) AS n FROM words GROUP BY ALL),
x AS MATERIALIZED (SELECT doc_id, line, token, b.n, b.n * coalesce(idf, {w.other!r}::double) AS x FROM bag b LEFT JOIN idf USING (token)),
norm AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm, sum(n) AS tokens FROM x GROUP BY ALL),
dot AS (SELECT doc_id, line, template, license, sum(x * weight) AS dot FROM x JOIN vec USING (token) GROUP BY ALL),
near AS (SELECT doc_id, line, template, license, tokens, round(dot / norm, 6) AS similarity FROM dot JOIN norm USING (doc_id, line)),
best AS (SELECT * FROM near WHERE similarity >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY similarity DESC, template) = 1),
own AS (SELECT doc_id, license, similarity, 2 * sum(tokens) OVER (PARTITION BY doc_id) >= n.n AS is_file FROM best JOIN n USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, template, line) = 1),
m AS MATERIALIZED (SELECT d.doc_id, directory, license, similarity, coalesce(is_file, false) AS is_file FROM d LEFT JOIN own USING (doc_id)),
files AS (SELECT directory, license AS said FROM m WHERE is_file QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, doc_id) = 1),
inherited AS (SELECT m.doc_id, said FROM m JOIN files f ON f.directory = '' OR m.directory = f.directory OR starts_with(m.directory, f.directory || '/')
  WHERE m.license IS NULL QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY length(f.directory) DESC) = 1)
SELECT doc_id, coalesce(license, said) AS license, similarity,
  CASE WHEN license IS NULL THEN CASE WHEN said IS NULL THEN 'none' ELSE 'inherited' END WHEN is_file THEN 'file' ELSE 'header' END AS origin, directory
FROM m LEFT JOIN inherited USING (doc_id)"""


SQL["op2_license_scans"] = _license_sql()
