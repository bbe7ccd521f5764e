"""Corpus pipeline over documents: quality rules, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of `docs`, whatever they are; the
last adds weight and probability. Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say: a text without words
fails the quality rules; one row of several equal ones stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.containment import containment_search
from proofmill.llm.mixing import layout_topic, mixture, token_count
from proofmill.llm.near_duplicates import representatives
from proofmill.llm.personal_data import redacted
from proofmill.llm.quality_rules import kept_records
from proofmill.session import cut
from proofmill.sources import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return kept_records(docs, "text", "lang", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    return representatives(docs, "doc_id", "text", shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Documents go by id and text: one that shares its id, or has none, stays if its own text is clean."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("reference_text"))
    key = F.struct("doc_id", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64("text", F.lit(2)).alias("b"))
    rows = docs.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("__key"), "text")
    hits = containment_search(rows, items, "__key", "text").select(F.col("__key").alias("__hit")).distinct()
    return docs.join(hits, F.to_json(key, {"ignoreNullFields": "false"}) == F.col("__hit"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; n_chars, where there is one, follows the text."""
    out = redacted(docs, "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that their tokens follow the target margins by source, language and layout, with weight and probability."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("lang").alias("__lang"),
                       layout_topic(F.col("text")).alias("__topic"), token_count(F.col("text")).alias("__tokens"))
    mixed = mixture(rows, None, "__id", "__source", "__lang", "__topic", "__tokens")
    return mixed.where("sampled").select("__row.*", "weight", "probability")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixing", mixing)]
# Components over links, sketches and raked weights have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared work folder before the next stage reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
