"""Canonical RGB-D captures: manifest, poses, calibration, depth rasters."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = ("format_version string, capture_id string, source_app string, depth_unit string, depth_scale double, depth_truncation_m double, "
            "pose_convention string, camera_convention string, coordinate_system string, source_to_canonical array<array<double>>, "
            "registered_rgb_depth boolean, intrinsics_file string, poses_file string, frame_count int, "
            "frames array<struct<frame_id:int,rgb_file:string,depth_file:string>>")
POSES = "poses array<struct<frame_id:int,matrix:array<array<double>>>>"
INTRINSICS = "width int, height int, fx double, fy double, cx double, cy double"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON with a declared schema; malformed files fail, folder is kept as key."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, MANIFEST)
    return raw.withColumn("source_to_canonical", F.flatten("source_to_canonical")).withColumn("depth_truncation", F.col("depth_truncation_m"))


def manifest_frames(manifests: DataFrame) -> DataFrame:
    """Frames in manifest order: the position is time."""
    return manifests.select("capture_id", F.posexplode("frames").alias("seq", "f")).select("capture_id", "seq", "f.*")


def manifest_facts(manifests: DataFrame, intrinsics: DataFrame) -> DataFrame:
    """One row per capture with everything the manifest rules look at."""
    ids = F.transform("frames", lambda f: f["frame_id"])
    rows = manifests.select("folder", "capture_id", "format_version", "depth_unit", "depth_scale", "frame_count", F.size(ids).alias("listed_frames"),
                            F.size(F.array_distinct(ids)).alias("distinct_frames"))
    return rows.join(intrinsics, "folder").drop("folder")


def escaping_paths(frames: DataFrame) -> DataFrame:
    """References that are absolute or climb out of the capture folder."""
    files = frames.select("capture_id", F.explode(F.array("rgb_file", "depth_file")).alias("path"))
    step = lambda acc, part: F.when(acc < 0, acc).when(part == "..", acc - 1).when(part.isin("", "."), acc).otherwise(acc + 1)
    depth = F.aggregate(F.split("path", "/"), F.lit(0), step)
    return files.filter(F.col("path").startswith("/") | (depth < 0))


def read_poses(spark: SparkSession, path: str, manifests: DataFrame) -> DataFrame:
    raw = _json(spark, path, POSES).join(manifests.select("folder", "capture_id"), "folder")
    return raw.select("capture_id", F.explode("poses").alias("p")).select("capture_id", "p.frame_id", F.flatten("p.matrix").alias("matrix"))


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, INTRINSICS)


SAMPLES = "path string, row int, col int, z double"


def read_depth(spark: SparkSession, path: str, chunk: int = 500_000) -> DataFrame:
    """Samples of ``.npy`` depth rasters, emitted in bounded batches; files are split over tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                raster = np.load(io.BytesIO(content), allow_pickle=False)
                rows, cols = np.indices(raster.shape)
                flat = pd.DataFrame({"path": name, "row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32),
                                     "z": raster.ravel().astype(float)})
                for start in range(0, len(flat), chunk):
                    yield flat.iloc[start:start + chunk]

    return files.select("path", "content").mapInPandas(unpack, SAMPLES)


def depth_of_frames(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Depth samples keyed by capture and frame through the file each manifest frame names."""
    tail = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    named = frames.select("capture_id", "frame_id", F.concat_ws("/", "folder", "depth_file").alias("tail"))
    return samples.withColumn("tail", tail).join(named, "tail").select("capture_id", "frame_id", "row", "col", "z")
