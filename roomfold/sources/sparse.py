"""Sparse reconstructions in text form, and match statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roomfold.functions import rigid
from roomfold.session import cut


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every model file with their order in it; a file is one capture's model and is never one row.

    Rows of a split come in the order of the file, and splits by where they begin.
    """
    return spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("capture_id"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("n"),
        F.regexp_replace("value", "\r$", "").alias("line"))


def _plain(lines: DataFrame) -> DataFrame:
    return lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split(F.trim("line"), "\\s+"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Pinhole cameras; any other model is kept as a null focal length for the caller to reject."""
    f = F.col("f")
    pinhole = (F.get(f, F.lit(1)) == "PINHOLE") & (F.size(f) == 8)
    value = lambda i: F.when(pinhole, F.get(f, F.lit(i)).cast("double"))
    return _plain(_lines(spark, path)).select(
        "capture_id", F.get(f, F.lit(0)).cast("int").alias("camera_id"), F.get(f, F.lit(2)).cast("int").alias("width"), F.get(f, F.lit(3)).cast("int").alias("height"),
        value(4).alias("fx"), value(5).alias("fy"), value(6).alias("cx"), value(7).alias("cy"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _plain(_lines(spark, path)).select(
        "capture_id", F.get(f, F.lit(0)).cast("long").alias("point_id"), F.get(f, F.lit(1)).cast("double").alias("px"), F.get(f, F.lit(2)).cast("double").alias("py"), F.get(f, F.lit(3)).cast("double").alias("pz"),
        F.get(f, F.lit(7)).cast("double").alias("reprojection_error"))


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no comments, with ``blank``, their number ``k`` in the file, that of the last blank line so far (``run``) and ``following``.

    ``lines`` has capture_id, split, row and line: pieces of a file in order and the order inside a piece. Lines are numbered inside their
    piece and shifted by the counts of the pieces before, so no task holds a file; only one row per piece is ordered per file.
    """
    base = cut(lines.filter(~F.col("line").startswith("#")).select("capture_id", "split", "row", F.trim("line").alias("line")))
    piece, file = Window.partitionBy("capture_id", "split").orderBy("row"), Window.partitionBy("capture_id").orderBy("split")
    local = base.withColumn("blank", F.col("line") == "").withColumn("_k", F.row_number().over(piece)).withColumn(
        "_run", F.max(F.when(F.col("blank"), F.col("_k"))).over(piece)).withColumn("_next", F.lead("line").over(piece))
    totals = local.groupBy("capture_id", "split").agg(
        F.count("*").alias("_n"), F.max(F.when(F.col("blank"), F.col("_k"))).alias("_last"), F.min(F.struct("_k", "line")).alias("_first"))
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_blank", F.max(F.col("_before") + F.col("_last")).over(before)).withColumn("_then", F.lead("_first.line").over(file))
    joined = local.join(shifts.select("capture_id", "split", "_before", "_blank", "_then"), ["capture_id", "split"])
    return joined.select("capture_id", "line", "blank", (F.col("_before") + F.col("_k")).alias("k"),
                         F.coalesce(F.col("_before") + F.col("_run"), "_blank", F.lit(0)).alias("run"), F.coalesce("_next", "_then", F.lit("")).alias("following"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Registered images of text files, one model per folder."""
    lines = _lines(spark, path)
    return images(lines.select("capture_id", F.col("n.split").alias("split"), F.col("n.row").alias("row"), "line"))


def images(lines: DataFrame) -> DataFrame:
    """Registered images: a header line, then its observation line, which may be empty.

    Comments are dropped. A blank line either is the empty observation of the header before it or is
    noise where a header is due; after it a header is due in any case. So inside a run of lines that
    are not blank, headers and observations alternate from the first one on. Poses are inverted to
    camera-to-world; a quaternion off unit length or an unsafe file name leaves the pose null.
    """
    paired = placed_lines(lines).filter(~F.col("blank") & ((F.col("k") - F.col("run")) % 2 == 1)).withColumn(
        "f", F.split("line", "\\s+", 10))
    f = F.col("f")
    q = [F.get(f, F.lit(i)).cast("double") for i in (2, 3, 4, 1)]
    t = tuple(F.get(f, F.lit(i)).cast("double") for i in (5, 6, 7))
    unit = F.abs(rigid.quaternion_norm(*q) - 1.0) <= 1e-3
    safe = ~F.get(f, F.lit(9)).contains("/") & ~F.get(f, F.lit(9)).isin(".", "..")
    return paired.select(
        "capture_id", F.get(f, F.lit(0)).cast("int").alias("image_id"), F.get(f, F.lit(8)).cast("int").alias("camera_id"), F.get(f, F.lit(9)).alias("filename"),
        F.when(unit & safe, rigid.invert(rigid.quaternion_pose(tuple(q), t))).alias("camera_to_world"), F.col("following").alias("observations"))


def model_faults(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """What makes a capture's model unusable: (capture_id, code), once per kind of fault."""
    tokens = F.size(F.filter(F.split(F.trim(F.coalesce("observations", F.lit(""))), "\\s+"), lambda v: v != ""))
    bad_pose = images.filter(F.col("camera_to_world").isNull()).select("capture_id", F.lit("SPARSE_IMAGE_INVALID").alias("code"))
    bad_rows = images.filter(tokens % 3 != 0).select("capture_id", F.lit("SPARSE_OBSERVATIONS_MALFORMED").alias("code"))
    bad_camera = cameras.filter(F.col("fx").isNull()).select("capture_id", F.lit("SPARSE_CAMERA_UNSUPPORTED").alias("code"))
    return bad_pose.unionByName(bad_rows).unionByName(bad_camera).distinct()


def observations(images: DataFrame) -> DataFrame:
    """Triples x, y, point id; negative ids are unmatched features."""
    parts = F.filter(F.split(F.trim(F.coalesce("observations", F.lit(""))), "\\s+"), lambda v: v != "")
    rows = images.withColumn("_p", parts).filter(F.size("_p") >= 3)
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("_p") / 3).cast("int") - 1), lambda i: F.struct(
        F.get(F.col("_p"), i * 3).cast("double").alias("ox"), F.get(F.col("_p"), i * 3 + 1).cast("double").alias("oy"),
        F.get(F.col("_p"), i * 3 + 2).cast("long").alias("point_id")))
    return rows.select("capture_id", "image_id", F.inline(triples)).filter("point_id >= 0")


def registered_frames(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Frames with calibration; name order is frame order. A capture whose model has a fault has none."""
    faulty = model_faults(images, cameras).select("capture_id")
    return images.drop("observations").join(cameras, ["capture_id", "camera_id"]).join(faulty, "capture_id", "left_anti")


def match_statistics(images: DataFrame, keypoints: DataFrame, geometries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features per named image; matched pairs and inliers per capture, zero when there are none."""
    features = images.join(keypoints, ["capture_id", "image_id"]).select("capture_id", "name", F.col("rows").alias("features"))
    pairs = geometries.groupBy("capture_id").agg(
        F.count_if(F.col("rows") > 0).alias("matched_pairs"), F.coalesce(F.sum(F.when(F.col("rows") > 0, F.col("rows"))), F.lit(0)).alias("inlier_matches"))
    return features, pairs
