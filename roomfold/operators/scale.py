"""Metric scale of sparse reconstructions against predicted depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roomfold.config import ScaleConfig
from roomfold.functions.camera import project, to_camera
from roomfold.functions.rigid import is_finite
from roomfold.functions.scores import scale_quality

MAD_TO_SIGMA = 1.4826
FEW_FRAMES = "Insufficient frames with reliable depth/SfM correspondences"
INCONSISTENT = "Frame scale estimates are inconsistent"
WEAK = "Insufficient consistent scale support or excessive relative dispersion"


def correspondences(frames: DataFrame, observations: DataFrame, points: DataFrame, depth: DataFrame,
                    cfg: ScaleConfig = ScaleConfig()) -> DataFrame:
    """Depth / reconstruction ratios of observations that project where they were seen.

    Equality joins only: observation to frame, to sparse point, then to the depth
    sample at the half-even rounded pixel. Keys are (capture, image|point|pixel).
    """
    frame = frames.select("capture_id", "image_id", "frame_id", "width", "height", "fx", "fy", "cx", "cy",
                          F.col("camera_to_world").alias("pose"))
    near = points.filter(F.col("reprojection_error") <= cfg.max_reprojection)
    joined = observations.join(near, ["capture_id", "point_id"]).join(frame, ["capture_id", "image_id"])
    # Each step is one generated row, else its expressions are copied into every condition, and those into the join.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))
    x, y, z = to_camera(F.col("pose"), F.col("px"), F.col("py"), F.col("pz"))
    seen = (once(joined, _cx=x, _cy=y, _cz=z)
            .filter(is_finite(F.col("_cx")) & is_finite(F.col("_cy")) & is_finite(F.col("_cz")) & (F.col("_cz") > 0)))
    u, v = project((F.col("_cx"), F.col("_cy"), F.col("_cz")), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    seen = once(seen, _u=u, _v=v)
    border = cfg.border
    inside = (F.col("_u").between(border, F.col("width") - border) & (F.col("_u") < F.col("width") - border)
              & (F.col("_v") >= border) & (F.col("_v") < F.col("height") - border))
    close = F.hypot(F.col("_u") - F.col("ox"), F.col("_v") - F.col("oy")) <= cfg.max_reprojection
    pixel = seen.filter(inside & close).withColumn("col", F.rint("_u").cast("int")).withColumn("row", F.rint("_v").cast("int"))
    metric = depth.filter(is_finite(F.col("z")) & F.col("z").between(cfg.depth_min, cfg.depth_max))
    return (pixel.join(metric.select("capture_id", "frame_id", "row", "col", F.col("z").alias("depth")),
                       ["capture_id", "frame_id", "row", "col"])
            .select("capture_id", "frame_id", (F.col("depth") / F.col("_cz")).alias("ratio")))


def _trim(centre: Column, mad: Column, cfg: ScaleConfig) -> Column:
    return F.greatest(cfg.relative_floor * centre, cfg.outlier * MAD_TO_SIGMA * mad)


def estimate_scale(ratios: DataFrame, captures: DataFrame, cfg: ScaleConfig = ScaleConfig(),
                   keys: list[str] = ("capture_id",)) -> DataFrame:
    """One scale report per capture; every step is a grouped aggregate joined back.

    A frame holds at most its feature budget and a capture at most its keyframe budget,
    so the exact medians are over bounded groups.
    """
    keys = list(keys)
    frame = [*keys, "frame_id"]
    centre = ratios.groupBy(*frame).agg(F.count("*").alias("_n"), F.median("ratio").alias("_med")) \
        .filter(F.col("_n") >= cfg.min_frame_correspondences)
    spread = ratios.join(centre, frame).groupBy(*frame).agg(
        F.first("_med").alias("_med"), F.median(F.abs(F.col("ratio") - F.col("_med"))).alias("_mad"))
    kept = ratios.join(spread, frame).filter(
        F.abs(F.col("ratio") - F.col("_med")) <= _trim(F.col("_med"), F.col("_mad"), cfg)).select(*frame, "ratio")
    per = kept.groupBy(*frame).agg(F.count("*").alias("_kept"), F.median("ratio").alias("frame_scale")) \
        .filter(F.col("_kept") >= cfg.min_frame_correspondences)
    centre_all = per.groupBy(*keys).agg(F.count("*").alias("_frames"), F.median("frame_scale").alias("frame_scale_median"))
    judged = per.join(centre_all, keys).withColumn(
        "_ok", F.abs(F.col("frame_scale") / F.col("frame_scale_median") - 1) <= cfg.consistency)
    accepted = judged.filter("_ok")
    summary = judged.groupBy(*keys).agg(
        F.first("_frames").alias("_frames"), F.first("frame_scale_median").alias("frame_scale_median"),
        F.count_if("_ok").alias("_accepted"),
        F.median(F.when(F.col("_ok"), F.col("frame_scale"))).alias("_scale"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("frame_id")))).alias("rejected_frames"),
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.col("frame_id")))).alias("_used"))
    pooled = kept.join(accepted.select(*frame), frame, "left_semi").join(summary.select(*keys, "_scale"), keys)
    mads = pooled.groupBy(*keys).agg(F.first("_scale").alias("_s"),
                                     F.median(F.abs(F.col("ratio") - F.col("_scale"))).alias("scale_mad"))
    support = pooled.join(mads.drop("_s"), keys).groupBy(*keys).agg(
        F.count_if(F.abs(F.col("ratio") - F.col("_scale")) <= _trim(F.col("_scale"), F.col("scale_mad"), cfg))
        .alias("correspondences_used"))
    out = (captures.select(*keys).distinct().join(summary, keys, "left").join(mads.drop("_s"), keys, "left")
           .join(support, keys, "left"))
    enough = F.coalesce("_frames", F.lit(0)) >= cfg.min_frames
    consistent = F.coalesce("_accepted", F.lit(0)) >= cfg.min_frames
    strong = (F.col("correspondences_used") >= cfg.min_correspondences) & (
        F.col("scale_mad") / F.col("_scale") <= cfg.max_relative_mad)
    reason = F.when(~enough, FEW_FRAMES).when(~consistent, INCONSISTENT).when(~strong, WEAK)
    resolved = F.col("failure_reason").isNull()
    reached = enough & consistent
    return (out.withColumn("failure_reason", reason)
            .select(*keys, resolved.alias("resolved"), F.when(resolved, F.col("_scale")).alias("global_scale"),
                    F.when(reached, F.col("scale_mad")).alias("scale_mad"),
                    F.when(reached, F.col("correspondences_used")).otherwise(0).alias("correspondences_used"),
                    F.when(enough, F.col("frame_scale_median")).alias("frame_scale_median"),
                    F.when(enough, F.col("rejected_frames")).alias("rejected_frames"),
                    F.when(resolved, F.col("_used")).alias("frames_used"),
                    F.when(resolved, scale_quality(F.col("scale_mad"), F.col("_scale"))).alias("quality"),
                    "failure_reason"))


def room_scale_quality(reports: DataFrame, cfg: ScaleConfig = ScaleConfig()) -> DataFrame:
    """Dimensionless scale quality per room; absolute scales of rooms are not comparable."""
    relative = F.when(F.col("global_scale") > 0, F.col("scale_mad") / F.col("global_scale"))
    weak = F.coalesce(F.col("quality") < cfg.min_room_quality, F.lit(False)) | F.coalesce(
        F.col("relative_mad") > cfg.max_room_relative_mad, F.lit(False))
    return reports.withColumn("relative_mad", relative).withColumn("weak", weak)


def weak_rooms(quality: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms with weak scale per property, listed in order (rooms per property are few)."""
    return quality.filter("weak").groupBy(*keys).agg(F.array_sort(F.collect_set("room_id")).alias("rooms"))
