"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.llm import decontaminate, dedup, langid, pieces, quality
from roomfold.llm.stages import stage

#: A language is accepted from this posterior on.
LEAST_LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; blank ones go."""
    return quality.classify(docs, quality.train(docs)).where("quality_keep").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; those without letters or with an undecided one go."""
    rows = docs.select("text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(rows.where("not held_out"), "text", "lang")
    return langid.predict(docs, "text", model).where(
        (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return dedup.keep_first(docs)


def unseen_in_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    found = pieces.transcode(docs, keep=["doc_id", "lang", "source", "n_chars"])
    return found.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("quality", good_quality), ("language", known_language), ("near_dedup", one_of_each),
          ("decontamination", unseen_in_tests), ("encoding", encoded)]

# The first, second and last stage are models and transducers, which SQL can't express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
