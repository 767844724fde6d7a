"""Frame tables: joins to poses and calibrations, gates, ladders and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import FrameConfig, PhotoConfig
from roomfold.functions.camera import backproject
from roomfold.functions.rigid import is_finite, is_rigid, normalize_pose, apply_point

FRAME = ["capture_id", "frame_id"]
NO_POSE = "missing or invalid pose"


def normalise_poses(poses: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical camera-to-world poses, and a warning per invalid rigid matrix."""
    joined = poses.join(captures.select("capture_id", "pose_convention", "source_to_canonical"), "capture_id")
    valid = is_rigid(F.col("matrix"))
    good = joined.filter(valid).select(*FRAME, normalize_pose(
        F.col("matrix"), F.col("pose_convention"), F.col("source_to_canonical")).alias("pose"))
    bad = joined.filter(~valid).select("capture_id", F.lit("INVALID_FRAME_POSE").alias("code"), F.concat(
        F.lit("Frame "), F.col("frame_id").cast("string"), F.lit(": invalid rigid pose; frame will be skipped.")
    ).alias("message"))
    return good, bad


def repeated_poses(poses: DataFrame) -> DataFrame:
    """Captures that list one frame's pose twice fail as a whole."""
    return (poses.groupBy(*FRAME).count().filter("count > 1")
            .select("capture_id", F.lit("DUPLICATE_POSE_FRAME").alias("code"), "frame_id"))


def posed_frames(frames: DataFrame, poses: DataFrame, intrinsics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with pose and calibration, matched by frame id and never by position."""
    posed = frames.join(poses, FRAME).join(intrinsics, "capture_id")
    missing = frames.join(poses.select(*FRAME), FRAME, "left_anti")
    warnings = missing.select("capture_id", F.lit("INVALID_RGBD_FRAME").alias("code"), F.concat(
        F.lit("Frame "), F.col("frame_id").cast("string"), F.lit(f" skipped: {NO_POSE}")).alias("message"))
    return posed, warnings


def depth_status(samples: DataFrame, calibration: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Verdict per frame: ``capture_failed`` on wrong dimensions, else invalid, sparse or ok.

    ``samples`` holds every pixel (row, col, raw depth); ``calibration`` gives width,
    height, depth_scale and depth_truncation per capture. Grouping is by frame, which
    image size bounds.
    """
    joined = samples.join(calibration.select("capture_id", "width", "height", "depth_scale", "depth_truncation"),
                          "capture_id")
    z = F.col("z") / F.col("depth_scale")
    valid = (z >= cfg.depth_min) & (z > 0) & (z <= F.least(F.lit(cfg.depth_max), F.col("depth_truncation")))
    per = joined.groupBy(*FRAME).agg(
        F.count("*").alias("pixels"), F.max("row").alias("_r"), F.max("col").alias("_c"),
        F.first("width").alias("_w"), F.first("height").alias("_h"),
        F.count_if(~F.coalesce(is_finite(F.col("z")), F.lit(False)) | (F.col("z") < 0)).alias("bad_pixels"),
        F.count_if(valid).alias("valid_pixels"))
    dims = (F.col("_r") + 1 == F.col("_h")) & (F.col("_c") + 1 == F.col("_w")) & (F.col("pixels") == F.col("_w") * F.col("_h"))
    return per.select(*FRAME, "pixels", "bad_pixels", "valid_pixels",
                      F.when(~dims, "capture_failed").when(F.col("bad_pixels") > 0, "invalid_depth")
                      .when(F.col("valid_pixels") < cfg.min_valid_depth_pixels, "sparse_depth")
                      .otherwise("ok").alias("status"))


def usable_depth(samples: DataFrame, calibration: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Metric samples inside the depth gate, of frames that passed, of captures that did not fail."""
    status = depth_status(samples, calibration, cfg)
    failed = status.filter("status = 'capture_failed'").select("capture_id").distinct()
    ok = status.filter("status = 'ok'").select(*FRAME).join(failed, "capture_id", "left_anti")
    scale = calibration.select("capture_id", "depth_scale", "depth_truncation")
    metric = samples.join(ok, FRAME, "left_semi").join(scale, "capture_id") \
        .withColumn("z", F.col("z") / F.col("depth_scale"))
    limit = F.least(F.lit(cfg.depth_max), F.col("depth_truncation"))
    return metric.filter((F.col("z") >= cfg.depth_min) & (F.col("z") > 0) & (F.col("z") <= limit)) \
        .drop("depth_scale", "depth_truncation")


def world_points(samples: DataFrame, frames: DataFrame, keys: list[str] = FRAME, u: str = "col", v: str = "row",
                 z: str = "z", pose: str = "pose") -> DataFrame:
    """Back-project depth samples through calibrated, posed frames."""
    joined = samples.join(frames, keys)
    x, y, w = backproject(F.col(u), F.col(v), F.col(z), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), F.col(pose))
    return joined.select(*samples.columns, x.alias("wx"), y.alias("wy"), w.alias("wz"))


def feature_points(features: DataFrame, depth: DataFrame, frames: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """World point of single features, reading depth at the half-even rounded pixel."""
    at = features.withColumn("row", F.rint("v").cast("int")).withColumn("col", F.rint("u").cast("int"))
    found = at.join(depth.filter(is_finite(F.col("z")) & (F.col("z") > 0)), [*keys, "row", "col"]).join(frames, keys)
    x, y, w = backproject(F.col("u"), F.col("v"), F.col("z"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"),
                          F.col("pose"))
    return found.select(*features.columns, x.alias("wx"), y.alias("wy"), w.alias("wz"))


def mask_samples(mask: DataFrame, keys: list[str], step: int, low: float, high: float, z: str = "z") -> DataFrame:
    """Every ``step``-th mask pixel in row-major order, then those with usable depth.

    The stride applies to the ordered mask pixels before the depth range. One key is one
    mask in one image, so image size bounds each window.
    """
    order = Window.partitionBy(*keys).orderBy("row", "col")
    return (mask.withColumn("_n", F.row_number().over(order) - 1).filter(F.col("_n") % step == 0).drop("_n")
            .filter(is_finite(F.col(z)) & F.col(z).between(low, high)))


def mask_depth(mask: DataFrame, depth: DataFrame, frame_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mask pixels with their depth sample, and masks whose frame has no depth of that shape."""
    joined = mask.join(depth, [*frame_keys, "row", "col"])
    shape = lambda df, name: df.groupBy(*frame_keys).agg(F.max("row").alias(f"{name}_rows"), F.max("col").alias(f"{name}_cols"))
    sizes = shape(mask, "m").join(shape(depth, "d"), frame_keys, "left")
    bad = sizes.filter(F.col("d_rows").isNull() | (F.col("m_rows") > F.col("d_rows")) | (F.col("m_cols") > F.col("d_cols")))
    return joined, bad.select(*frame_keys, F.lit("OPENING_DEPTH_UNAVAILABLE").alias("code"))


def photo_rejection(cfg: PhotoConfig = PhotoConfig()) -> Column:
    """First failing test of a photo, null when it is usable."""
    c = F.col
    return (F.when(~c("readable"), "invalid: unreadable image")
            .when(F.least(c("width"), c("height")) < cfg.min_dimension, F.concat(
                F.lit("invalid: resolution "), c("width").cast("string"), F.lit("x"), c("height").cast("string"),
                F.lit(" is below the minimum")))
            .when(c("all_zero"), "invalid: image contains no non-zero pixel data")
            .when(c("brightness") < cfg.brightness_min, "low_light")
            .when(c("brightness") > cfg.brightness_max, "overexposed")
            .when(c("blur") < cfg.blur, "blur").when(c("contrast") < cfg.contrast_min, "low_contrast"))


def same_camera(photos: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all photos of a room carry one identical, non-empty camera signature."""
    named = (F.coalesce(F.length("camera_make"), F.lit(0)) > 0) & (F.coalesce(F.length("camera_model"), F.lit(0)) > 0)
    signature = F.to_json(F.struct("camera_make", "camera_model", "width", "height", "focal_length",
                                   "focal_length_35mm"))
    # Min equals max replaces a distinct count: constant state per group.
    return photos.groupBy(*keys).agg((F.bool_and(named) & (F.min(signature) == F.max(signature))).alias("same_camera"))


def reason_counts(df: DataFrame, keys: list[str], reason: str) -> DataFrame:
    return df.groupBy(*keys, reason).agg(F.count("*").alias("n"))


def reason_map(df: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Counts by reason as one map per group; reasons are a closed vocabulary."""
    counts = reason_counts(df.filter(F.col(reason).isNotNull()), keys, reason)
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("counts"))


def frame_counters(frames: DataFrame, keys: list[str], status: str = "status", kept: str = "selected") -> DataFrame:
    """Total, loaded, invalid, not selected and skipped frames of a capture.

    Every loaded frame counts, selected or not; skipped is all that was not kept.
    """
    loaded = F.col(status) == "ok"
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames_total"), F.count_if(loaded).alias("frames_loaded"),
        F.count_if(~loaded).alias("frames_invalid"),
        F.count_if(loaded & ~F.col(kept)).alias("frames_not_selected"),
        (F.count("*") - F.count_if(F.col(kept))).alias("frames_skipped"))


def photo_counters(photos: DataFrame, keys: list[str]) -> DataFrame:
    """Valid counts readable photos, rejected counts everything not selected."""
    return photos.groupBy(*keys).agg(
        F.count("*").alias("images_total"), F.count_if("readable").alias("images_valid"),
        F.count_if(~F.col("selected")).alias("images_rejected"), F.count_if("selected").alias("images_selected"))


def surviving_frames(frames: DataFrame, used: DataFrame, keys: list[str], minimum: int) -> tuple[DataFrame, DataFrame]:
    """Frames kept by scale consistency; captures left with too few become issues."""
    kept = frames.join(used, [*keys, "frame_id"], "left_semi")
    counts = frames.groupBy(*keys).agg(F.lit(0).alias("_z")).join(
        kept.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    issues = counts.filter(F.coalesce("n", F.lit(0)) < minimum).select(
        *keys, F.lit("METRIC_FUSION_FAILED").alias("code"), F.coalesce("n", F.lit(0)).alias("frames"))
    return kept.join(issues.select(*keys), keys, "left_anti"), issues


def level_poses(poses: DataFrame, leveling: DataFrame, keys: list[str]) -> DataFrame:
    """Camera poses re-based by the same floor transform as the cloud."""
    from roomfold.functions.rigid import compose
    return poses.join(leveling.select(*keys, "leveling"), keys) \
        .withColumn("pose", compose(F.col("leveling"), F.col("pose"))).drop("leveling")


def transform_points(points: DataFrame, transforms: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """Points moved by one rigid matrix per group."""
    x, y, z = apply_point(F.col(matrix), F.col("x"), F.col("y"), F.col("z"))
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    return points.join(transforms.select(*keys, matrix), keys).select(
        *rest, x.alias("x"), y.alias("y"), z.alias("z"))
