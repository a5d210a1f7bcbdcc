"""The corpus pipeline: its stages, each over what the one before it kept.

Language ID drops documents without a language; line dedup takes out lines that an earlier line equals or nearly equals;
near-dedup links SimHash fingerprints over shingles of five words, and by minima of the shingles those that are farther apart, and
keeps the document with the smallest id of each group whose sets reach a Jaccard similarity of 0.8; mixing repeats and drops documents by source until the mix has its target weights; the last stage encodes the texts
and decodes them again.  All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import bpe, common, language, lines, mixing, shingles


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, least_words=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__wl_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), decoded=True, drop=("text",)))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]
# Training a model, fingerprints and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
