"""Quality classifier by hierarchical empirical Bayes: document evidence, host and path posteriors, global prior.

1. Each text gives a few features (shares of symbols, capitals, digits, repeated words and lines, and so on) and the shares of
   its lower-cased words by hash bucket (BUCKETS of them), in one pass.
2. A logistic curve, fitted to a bounded labelled sample (the TRAIN_ROWS labelled rows whose doc_id has the smallest
   hash; at most TRAIN_ROWS * BUCKETS counts), makes them the document's evidence: the probability that its quality is good.
3. Grouped sums give each host's mean evidence, shrunk towards the global mean, and each path's (a section of a host),
   shrunk towards its host's. A level's strength - how many documents its parent counts for - is fitted by moments to how
   far the groups' means scatter beyond what their sizes explain.
4. A document's posterior shifts its evidence, in log odds, by PULL times that of its path against the global mean. It is
   kept at KEEP or more.

Null text counts as empty. A null host or path is a group of its own. Without labels of both kinds the evidence is the
share of label 1 (0.5 without labels). Repeated rows count as often as they stand. No rows give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep

TRAIN_ROWS, BUCKETS, PULL, KEEP = 20_000, 512, 0.5, 0.5
#: What a bucket's share counts for beside the other features, and the ridges of both.
SPREAD, RIDGE, WORD_RIDGE = 20.0, 0.1, 1.0
WEAKEST, STRONGEST = 2.0, 10_000.0
_SPACE = r"[\\x20\\x09-\\x0D]+"
FEATURES = ("f_words", "f_length", "f_symbols", "f_capitals", "f_digits", "f_words_again", "f_lines_again", "f_ends")
_STEPS = (
    {"t": "coalesce(text, '')"},
    {"w": f"array_remove(split(t, '{_SPACE}', -1), '')", "l": r"split(t, '\n', -1)", "n": "cast(greatest(1, length(t)) AS double)"},
    {
        "f_words": "ln(1.0D + size(w))",
        "f_length": "ln(1.0D + n / greatest(1, size(w)))",
        "f_symbols": "10.0D * (n - length(regexp_replace(t, '[#*$%&|<>!{}=_~^]', ''))) / n",
        "f_capitals": r"5.0D * (n - length(regexp_replace(t, '\\p{Lu}', ''))) / n",
        "f_digits": "10.0D * (n - length(regexp_replace(t, '[0-9]', ''))) / n",
        "f_words_again": "1.0D - size(array_distinct(w)) / cast(greatest(1, size(w)) AS double)",
        "f_lines_again": "1.0D - size(array_distinct(l)) / cast(size(l) AS double)",
        "f_ends": r"20.0D * (n - length(regexp_replace(t, '[.?:]', ''))) / n",
    },
)


_BUCKET = f"cast(pmod(xxhash64(lower(x)), {BUCKETS}) AS int)"


def _stepped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w (the words) and FEATURES of rows with a column text."""
    kept = [*keys, "text"]
    for step in _STEPS:
        rows = rows.select(*kept, *[F.expr(e).alias(c) for c, e in step.items()])
        kept = [*kept, *step]
    return rows.select(*keys, "w", *FEATURES)


def training_data(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A column of ones, features and bucket shares, and labels of the bounded sample, in an order of its own."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("row"), F.col("quality").cast("double").alias("quality"), "text")
    rows = keep(_stepped(rows, ["row", "quality"]))
    # The driver holds one matrix and the counts in Arrow; both are bounded by the sample.
    words = rows.select("row", F.expr(f"explode(transform(w, x -> {_BUCKET}))").alias("bucket")).groupBy("row", "bucket").agg(F.count("*").cast("int").alias("n")).toArrow()
    sample = rows.select("row", "quality", *FEATURES).toArrow()
    names, first = np.unique(sample["row"].to_numpy(), return_index=True)
    x = np.zeros((len(names), 1 + len(FEATURES) + BUCKETS))
    x[:, 0] = 1
    for k, f in enumerate(FEATURES, 1):
        x[:, k] = sample[f].to_numpy()[first]
    x[np.searchsorted(names, words["row"].to_numpy()), 1 + len(FEATURES) + words["bucket"].to_numpy()] = words["n"].to_numpy()
    shares = x[:, 1 + len(FEATURES) :]
    shares *= SPREAD / np.maximum(1, shares.sum(1, keepdims=True))
    return x, sample["quality"].to_numpy()[first]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over x (ones, features, bucket shares), by Newton steps with small ridges, a stretch of rows at a time."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([np.log(share / (1 - share)), *np.zeros(x.shape[1] - 1)])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[1 + len(FEATURES) :] = WORD_RIDGE
    for _ in range(100):
        bend, pull = np.diag(ridge), -ridge * w
        for k in range(0, len(x), 2048):
            part = x[k : k + 2048]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            bend += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            pull += part.T @ (y[k : k + 2048] - p)
        step = np.linalg.solve(bend, pull)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


def evidence(docs: DataFrame, host: str, path: str, w: np.ndarray) -> DataFrame:
    """doc_id, host, path and the curve's value for every row."""
    rows = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), "text")
    rows = _stepped(rows, ["doc_id", "host", "path"])
    each = ", ".join(f"{x!r}D" for x in (SPREAD * w[1 + len(FEATURES) :]).tolist())
    words = F.expr(f"aggregate(w, 0.0D, (a, x) -> a + array({each})[{_BUCKET}]) / greatest(1, size(w))")
    z = sum((F.col(f) * float(x) for f, x in zip(FEATURES, w[1:])), F.lit(float(w[0]))) + words
    return rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))).alias("evidence"))


def _strength(groups: DataFrame, n: str, mean: str, parent) -> float:
    """Prior strength of a level by moments: groups' sizes, means, what they are shrunk to, and their inner variance."""
    d = F.col(mean) - parent
    total, inner, scatter, k = groups.agg(F.sum(n), F.sum(F.col(n) * F.col("inner")), F.sum(F.col(n) * d * d), F.count("*")).head()
    if not total or k < 2 or total <= k:
        return STRONGEST
    inner = inner / (total - k)
    between = (scatter - (k - 1) * inner) / total
    return STRONGEST if between <= 0 else float(min(STRONGEST, max(WEAKEST, inner / between)))


def quality(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior, kept of every row. labels: doc_id, quality."""
    rows = keep(evidence(docs, host, path, fit(*training_data(docs, labels))))
    sums = keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q")))
    mean = sums.agg(F.sum("s") / F.sum("n")).head()[0]
    mean = 0.5 if mean is None else float(mean)
    inner = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("inner")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("host", "n", (F.col("s") / F.col("n")).alias("mean"), inner)
    hosts = keep(hosts)
    a = _strength(hosts, "n", "mean", F.lit(mean))
    hosts = keep(hosts.select("host", ((F.col("n") * F.col("mean") + a * mean) / (F.col("n") + a)).alias("host_posterior")))
    paths = sums.select(F.col("host").alias("h"), "path", "n", (F.col("s") / F.col("n")).alias("mean"), inner)
    paths = keep(paths.join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("host"))
    b = _strength(paths, "n", "mean", F.col("host_posterior"))
    paths = keep(paths.select("h", F.col("path").alias("p"), "host_posterior", ((F.col("n") * F.col("mean") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior")))
    out = rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    odds = lambda c: F.ln(c / (1 - c))
    safe = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    z = odds(safe(F.col("evidence"))) + PULL * (odds(safe(F.col("path_posterior"))) - odds(safe(F.lit(mean))))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= KEEP).alias("kept"))
