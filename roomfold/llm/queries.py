"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.llm import (clusters, decontaminate, dedup, extract, langid, licenses, lm, mixing, negatives, pieces, quality, search,
                          sharding, sql)
from roomfold.plans.tables import table

QUERIES = {}
ORACLES = {"op3_near_dedup": sql.NEAR_DEDUP, "op7_decontamination": sql.DECONTAMINATION, "op9_exact_search": sql.EXACT_SEARCH,
           "op11_centroid_clusters": sql.CENTROID_CLUSTERS, "op12_source_mix": sql.SOURCE_MIX, "op13_hard_negatives": sql.HARD_NEGATIVES}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(rows.where("not held_out"), "text", "lang")
    return langid.predict(rows, "text", model, ["doc_id", "held_out"])


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = dedup.near_duplicates(docs, settings=dedup.Settings(words=3, similarity=85, bands=34, rows=8))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    own = F.transform("detections", lambda d: d["label"])
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"))


@query
def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                        "grown_shard")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "shared", "n_item",
                        (F.col("shared") / F.col("n_item")).alias("containment"))


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract.extract(pages, extract.learn(pages), keep=["url"])
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.classify(docs, quality.train(docs), keep=["doc_id"])
    return found.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("kept"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.transcode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


@query
def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = search.top_k(docs, asked)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, ~lm.held_out(F.col("doc_id")))
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return clusters.inertia(found, centres).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=shifted)
