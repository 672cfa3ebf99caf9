"""License scans: sparse TF-IDF cosines of lines to license templates, then inheritance from the nearest directory above.

DataFrame functions only. Tokens are runs of letters and digits, lower-cased; versions such as 2.0 and names such as BY-NC are one token. A token
weighs its count times its inverse frequency among the templates (tokens of no template weigh most, function words little), so a line's vector has
its tokens alone. A line matches the template with the highest cosine if that is LEAST or more. Lines are only weighed if
they hold one of the key tokens; without these, what is left of any template is too short for its cosine to get there.

Up to SPAN neighbouring lines are also weighed joined, as headers are wrapped; a joined match counts if it is nearer than
all that it is joined of. Whole documents are weighed against the full texts in license_texts: a document whose cosine to
one is WHOLE or more is a license file of that license, whatever its lines say.

A document's own license otherwise is that of its best line (the first by cosine, template, line). It is a license file if half or
more of its tokens stand in matching lines; the best license file of a directory (then the smallest doc_id) speaks for the
directory and all below it that have none. A document without a match of its own inherits from the nearest directory, its
own included. Directories are resolved once each, however many documents they hold.

Null and empty texts have no license of their own; a null path is the root. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import keep

LEAST = 0.6
#: Least cosine of a whole document to a full text, and lines weighed together at most.
WHOLE, SPAN = 0.7, 4
#: Headers and short forms by SPDX name (fixed texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("LicenseRef-all-rights-reserved", "All rights reserved"),
)
#: Function words weigh little, whatever their frequency.
FUNCTION = frozenset("a all an and any are as at be by can following for from in into is it may not of on or that the this to under use v was with you your".split())
FUNCTION_WEIGHT = 0.3
#: Licenses with a full text beside this module.
FULL = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


class Weights:
    """TF-IDF vectors of the templates, and the key tokens without which no line comes near one."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
        df = Counter(t for b in bags for t in b)
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()} | dict.fromkeys(FUNCTION, FUNCTION_WEIGHT)
        self.other = math.log(1 + len(bags)) + 1
        self.vectors, self.keys = [], set()
        for (name, _), bag in zip(templates, bags):
            v = {t: n * self.idf[t] for t, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {t: x / norm for t, x in v.items()}))
        for _, v in sorted(self.vectors, key=lambda x: len(x[1])):
            left = sum(x * x for t, x in v.items() if t not in self.keys)
            for t in sorted(v, key=lambda t: (-v[t], t)):  # the heaviest first, until the rest can't reach the least cosine
                if left < least * least * 0.999:
                    break
                if t not in self.keys:
                    self.keys.add(t)
                    left -= v[t] * v[t]

    def rows(self) -> list[tuple[str, int, str, float]]:
        """(token, template, license, weight) for each token of each template."""
        return [(t, k, name, x) for k, (name, v) in enumerate(self.vectors) for t, x in sorted(v.items())]

    def pattern(self) -> str:
        """A regular expression that finds a key token."""
        return "(?i)(?:^|[^a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(self.keys)) + ")(?:[^a-z0-9]|$)"


def full_texts() -> tuple[tuple[str, str], ...]:
    return tuple((name, pkgutil.get_data("lectern.llm", f"license_texts/{name}.txt").decode()) for name in FULL)


def _near(words: DataFrame, key: list[str], weights: Weights, least: float) -> DataFrame:
    """key, template, license, similarity of the nearest template of each key's tokens (a row each), if it is near enough."""
    spark = words.sparkSession
    counted = words.groupBy(*key, "token").agg(F.count("*").alias("n"))
    idf = spark.createDataFrame(sorted(weights.idf.items()), "token string, idf double")
    vectors = spark.createDataFrame(weights.rows(), "token string, template int, license string, weight double")
    # The tables of the templates are constants of this module's size.
    weighed = keep(counted.join(F.broadcast(idf), "token", "left").select(*key, "token", (F.col("n") * F.coalesce("idf", F.lit(weights.other))).alias("x")))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "token").groupBy(*key, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, key).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("template", "license", "similarity"), F.struct("similarity", -F.col("template")))
    return near.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def line_matches(docs: DataFrame, weights: Weights) -> DataFrame:
    """row, all_tokens, line, span, sizes, template, license, similarity of matching lines; docs: row, text.

    A match is of span lines from line on, which have so many tokens each (sizes).
    """
    found = F.col("text").rlike(weights.pattern())
    size = lambda c: F.size(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))
    held = docs.where(found).select("row", size("text").alias("all_tokens"), F.split("text", "\n", -1).alias("l")).distinct()
    # Neither sum can hide a match: no template's dot product is over u, and no norm's square is under q.
    most = {t: max(v.get(t, 0.0) for _, v in weights.vectors) * x for t, x in weights.idf.items()}
    known = F.create_map(*[c for t, x in sorted(weights.idf.items()) for c in (F.lit(t), F.struct(F.lit(most[t]).alias("u"), F.lit(x * x).alias("q")))])
    other = F.struct(F.lit(0.0).alias("u"), F.lit(weights.other**2).alias("q"))

    def bounds(text):
        tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
        each = F.transform(tokens, lambda t: F.coalesce(known[t], other))
        total = lambda f: F.aggregate(each, F.lit(0.0), lambda s, e: s + e[f])
        return F.struct(F.size(tokens).alias("n"), total("u").alias("u"), total("q").alias("q"))

    held = held.withColumn("b", F.transform("l", bounds))
    spans = [F.expr(f"CASE WHEN size(l) >= {k} THEN transform(sequence(1, size(l) - {k - 1}), i -> struct(i - 1 AS line, {k} AS span, slice(b, i, {k}) AS b)) ELSE array() END") for k in range(1, SPAN + 1)]
    near = f"p -> aggregate(p.b, 0D, (s, e) -> s + e.u) >= {0.999 * LEAST} * sqrt(aggregate(p.b, 0D, (s, e) -> s + e.q)) AND exists(p.b, e -> e.u > 0)"
    pieces = held.withColumn("p", F.concat(*spans)).select("row", "all_tokens", "l", F.explode(F.expr(f"filter(p, {near})")).alias("p"))
    pieces = pieces.select("row", "all_tokens", "p.line", "p.span", F.col("p.b.n").alias("sizes"), F.expr("array_join(slice(l, p.line + 1, p.span), ' ')").alias("text"))
    key = ["row", "all_tokens", "line", "span", "sizes"]
    near = keep(_near(pieces.select(*key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token")), key, weights, LEAST))
    parts = near.where("span > 1").select("row", "line", "span", F.explode(F.expr("flatten(transform(sequence(1, span - 1), k -> transform(sequence(0, span - k), i -> struct(line + i AS line, k AS span))))")).alias("part"))
    one = near.select("row", F.struct("line", "span").alias("part"), F.col("similarity").alias("nearest"))
    parts = parts.join(one, ["row", "part"]).groupBy("row", "line", "span").agg(F.max("nearest").alias("nearest"))
    return near.join(parts, ["row", "line", "span"], "left").where("nearest IS NULL OR similarity > nearest").drop("nearest")


def full_matches(docs: DataFrame, weights: Weights) -> DataFrame:
    """row, license, similarity of whole documents near a full text; docs: row, text. Sums are made where the text is read."""
    rows = docs.select("row", F.monotonically_increasing_id().alias("at"), F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("t"))
    rows = rows.where("size(t) > 0").withColumn("s", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i] <> t[i - 1])"))
    bags = rows.select("row", "at", F.explode(F.expr("transform(s, (i, k) -> struct(t[i] AS token, coalesce(get(s, k + 1), size(t)) - i AS n))")).alias("e")).select("row", "at", "e.*")
    table = [(t, x, [v.get(t, 0.0) for _, v in weights.vectors]) for t, x in sorted(weights.idf.items())]
    table = docs.sparkSession.createDataFrame(table, "token string, idf double, w array<double>")  # a constant of this module's size
    x = F.col("n") * F.coalesce("idf", F.lit(weights.other))
    weighed = bags.join(F.broadcast(table), "token", "left").select("row", "at", x.alias("x"), "w")
    dots = [F.sum(F.col("x") * F.col("w")[k]).alias(f"dot{k}") for k in range(len(weights.vectors))]
    sums = weighed.groupBy("row", "at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    each = [F.struct(F.round(F.coalesce(f"dot{k}", F.lit(0.0)) / F.col("norm"), 6).alias("similarity"), F.lit(-k).alias("order"), F.lit(name).alias("license")) for k, (name, _) in enumerate(weights.vectors)]
    return sums.select("row", F.array_max(F.array(*each)).alias("b")).where(f"b.similarity >= {WHOLE}").select("row", "b.license", "b.similarity").distinct()


def parent_dirs(directory: str):
    """The directory and all above it, the root "" last."""
    d = f"split({directory}, '/', -1)"
    return F.expr(f"CASE WHEN {directory} = '' THEN array('') ELSE array_append(transform(sequence(size({d}), 1, -1), n -> array_join(slice({d}, 1, n), '/')), '') END")


def scan_licenses(docs: DataFrame, path: str, weights: Weights | None = None) -> DataFrame:
    """doc_id, license, similarity, origin (header, file, inherited or none), directory of every row of docs.

    path names a column with a document's path; its directory is all before the last slash.
    """
    weights = weights or Weights()
    at = F.coalesce(F.regexp_extract(F.col(f"`{path}`"), "^(.*)/", 1), F.lit(""))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.col(f"`{path}`")).alias("row"), at.alias("directory"))
    texts = rows.select("row", "text")
    lines = keep(line_matches(texts, weights))
    best = F.max_by(F.struct("license", "similarity"), F.struct("similarity", -F.col("template"), -F.col("line"), -F.col("span")))
    covered = lines.select("row", "line", F.posexplode("sizes").alias("k", "tokens")).select("row", (F.col("line") + F.col("k")).alias("at"), "tokens").distinct().groupBy("row").agg(F.sum("tokens").alias("tokens"))
    own = lines.groupBy("row").agg(best.alias("b"), F.max("all_tokens").alias("all_tokens")).join(covered, "row")
    own = own.select("row", "b.license", "b.similarity", (2 * F.col("tokens") >= F.col("all_tokens")).alias("is_file"))
    full = keep(full_matches(texts, Weights(full_texts(), WHOLE)).withColumn("is_file", F.lit(True)))
    own = own.join(full, "row", "left_anti").unionByName(full)
    marked = keep(rows.drop("text").join(own, "row", "left"))
    files = marked.where("is_file").groupBy("directory").agg(F.min_by(F.col("license"), F.struct(-F.col("similarity"), "doc_id")).alias("said"))
    dirs = marked.where("license IS NULL").select("directory").distinct()
    above = dirs.select("directory", F.posexplode(parent_dirs("directory")).alias("up", "above"))
    said = above.join(files.select(F.col("directory").alias("above"), "said"), "above")
    said = keep(said.groupBy("directory").agg(F.min_by("said", "up").alias("said")))
    out = marked.join(said, "directory", "left")
    origin = F.when(F.col("license").isNull(), F.when(F.col("said").isNull(), "none").otherwise("inherited")).otherwise(F.when(F.col("is_file"), "file").otherwise("header"))
    return out.select("doc_id", F.coalesce("license", "said").alias("license"), "similarity", origin.alias("origin"), "directory")
