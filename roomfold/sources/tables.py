"""Point clouds, result documents, measurement files, ground truth and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roomfold.operators.documents import to_sorted_json
from roomfold.operators.integrity import validate_documents
from roomfold.operators.ordering import best_per_group, positions, stride_above
from roomfold.schemas import MEASUREMENT_COLUMNS, result_schema


def read_ascii_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Points of ASCII PLY files; header lines are those that do not start with three numbers."""
    lines = spark.read.text(path).withColumn("cloud", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.ply$", 1))
    f = F.split(F.trim("value"), "\\s+")
    number = [F.get(f, F.lit(i)).try_cast("double") for i in range(3)]
    return lines.select("cloud", *[v.alias(c) for v, c in zip(number, "xyz")]).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents against the declared schema; a malformed document fails the read."""
    return spark.read.schema(result_schema()).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(result_schema()).option("mode", "FAILFAST").json(path)


def write_results(documents: DataFrame, path: str, check: bool = True) -> None:
    """One key-sorted JSON line per document, nulls kept, in gzipped files; invalid documents stop the write."""
    if check and not validate_documents(documents).isEmpty():
        raise ValueError("result documents violate integrity rules; see validate_documents")
    to_sorted_json(documents).select(F.col("json").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_measurements(rows: DataFrame, path: str) -> None:
    """Gzipped CSV with eleven fixed columns and empty fields for unknown values."""
    body = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MEASUREMENT_COLUMNS])
    body.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").option("compression", "gzip").csv(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth rows with usable numbers."""
    raw = spark.read.option("header", "true").csv(path)
    return usable_truth(raw)


def usable_truth(raw: DataFrame) -> DataFrame:
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    typed = raw.withColumn("measured_value", number("measured_value")).withColumn("ground_truth_value", number("ground_truth_value"))
    return typed.filter("measured_value IS NOT NULL AND ground_truth_value IS NOT NULL")


def write_stage(df: DataFrame, path: str, partition: str = "property_id") -> None:
    """Replace the partitions present in ``df`` and leave all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def without_stage_rows(existing: DataFrame, codes: list[str]) -> DataFrame:
    """Warnings of earlier runs of a stage leave before it runs again."""
    return existing.filter(~F.col("code").isin(codes))


def calibrated_frames(frames: DataFrame, poses: DataFrame, intrinsics: DataFrame, depth: DataFrame) -> DataFrame:
    """Frames with pose and calibration whose depth is stored."""
    key = ["capture_id", "frame_id"]
    return frames.join(poses, key).join(intrinsics, "capture_id").join(depth.select(*key), key, "left_semi")


def structural_points(clouds: DataFrame, keys: list[str], maximum: int | None = None) -> DataFrame:
    """Points of the preferred cloud of every capture (corrected before raw); with ``maximum`` thinned evenly above it."""
    rank = F.when(F.col("variant") == "corrected", 0).when(F.col("variant") == "raw", 1).otherwise(2)
    variants = best_per_group(clouds.select(*keys, "variant").distinct(), keys, [rank])
    chosen = clouds.join(variants, [*keys, "variant"], "left_semi")
    if maximum is None:
        return chosen
    ranked = positions(chosen, keys, ["point_id"], F.floor(F.col("point_id") / 100_000), "_seq", "_total")
    return stride_above(ranked, "_seq", "_total", maximum).drop("_seq", "_total")
