"""A corpus pipeline of five stages: quality rules, n-gram Jaccard join, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and judges all of docs, which is what its predecessor kept. All but the last return
the columns that they got. ``run`` applies them to the table documents, with a written table between any two.

All stages take any further columns, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontam import clean_rows
from lectern.llm.jaccard import jaccard_components
from lectern.llm.packing import pack
from lectern.llm.quality_rules import kept_rows
from lectern.llm.queries import tokenizer_spec
from lectern.llm.recompress import remove_repeats
from lectern.llm.runtime import keep, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: all with null, empty or white text, as they have too few words. A null source is no
    host; its documents go by the base rules alone. Repeated rows count, stay or go as often as they stand."""
    return kept_rows(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays. Rows with null or empty text are in no
    group and stay, as do rows without a doc_id and repeated rows of the document that stays."""
    groups = jaccard_components(docs)
    gone = keep(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return without(docs, "doc_id", gone)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; n_chars, if there is such a column, follows the text. All rows stay: null texts stay
    null, texts under 35 words as they are, and a text whose words are all repeated becomes empty. Repeated rows of a long
    text repeat one another."""
    cut = remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none and stay; repeated rows fare alike."""
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of what is left lies. A null or empty text is one piece of its end token; repeated rows are packed as
    often as they stand."""
    return pack(docs, tokenizer_spec())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs)
    return docs
