"""Queries over frame sequences, derived from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import FrameConfig, PhotoConfig, VideoConfig
from roomfold.functions import rigid
from roomfold.functions.scores import photo_quality
from roomfold.operators import folds, frames as ops
from roomfold.operators.ordering import even_sample, next_by_position, positions, stride, stride_above
from roomfold.plans import projections as P
from roomfold.plans.registry import query

FRAMES = P.source("events", P.FRAMES)
SEQ = f"(SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, frame_id) - 1 AS seq FROM {FRAMES} f)"


def sequenced(spark: SparkSession, sf: str, total: str | None = None) -> DataFrame:
    """Frames with their dense position. An hour holds at most rate x 3600 frames of a capture."""
    return positions(P.frames(spark, sf), ["capture_id"], ["ts", "frame_id"], F.date_trunc("hour", "ts"), "seq", total)


@query("frame_stride", f"SELECT capture_id, frame_id, seq FROM {SEQ} s WHERE seq % 3 = 0")
def frame_stride(spark: SparkSession, sf: str) -> DataFrame:
    return stride(sequenced(spark, sf), "seq", 3).select("capture_id", "frame_id", "seq")


@query("frame_even_sample", f"""
SELECT capture_id, frame_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY capture_id) AS n FROM {SEQ} s) t
WHERE seq % greatest(1, n // 20) = 0 AND seq // greatest(1, n // 20) < 20""")
def frame_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return even_sample(sequenced(spark, sf, "n"), "seq", "n", 20).select("capture_id", "frame_id", "seq")


@query("frame_neighbours", f"""
SELECT capture_id, seq, frame_id, nxt AS next_id FROM (SELECT *, lead(frame_id) OVER
(PARTITION BY capture_id ORDER BY seq) AS nxt FROM {SEQ} s) t WHERE nxt IS NOT NULL""")
def frame_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return next_by_position(sequenced(spark, sf), ["capture_id"], "seq", "frame_id").select(
        "capture_id", "seq", "frame_id", "next_id")


@query("point_stride_above_maximum", f"""
SELECT capture_id, x_mm, y_mm, z_mm, l_orderkey, l_linenumber, l_partkey FROM (
 SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY x_mm, y_mm, z_mm, l_orderkey, l_linenumber, l_partkey) - 1
  AS seq, count(*) OVER (PARTITION BY capture_id) AS n FROM {P.source('lineitem', P.POINTS)} p) t
WHERE seq % (CASE WHEN n > 400 THEN ceil(n / 400.0)::BIGINT ELSE 1 END) = 0""")
def point_stride(spark: SparkSession, sf: str) -> DataFrame:
    ranked = positions(P.points(spark, sf), ["capture_id"],
                       ["x_mm", "y_mm", "z_mm", "l_orderkey", "l_linenumber", "l_partkey"], F.col("x_mm"), "seq", "n")
    return stride_above(ranked, "seq", "n", 400).select(
        "capture_id", "x_mm", "y_mm", "z_mm", "l_orderkey", "l_linenumber", "l_partkey")


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """Photo quality columns of every frame."""
    return P.frames(spark, sf).select(
        "capture_id", "frame_id", "ts", (F.col("k") >= 2).alias("readable"), F.lit(640).alias("width"),
        F.lit(480).alias("height"), (F.col("k") == 50).alias("all_zero"), (F.col("k") * 2.55).alias("brightness"),
        F.col("value").alias("blur"), (F.col("k") % 23 * 1.0).alias("contrast"),
        (F.col("frame_id") % 1500).alias("features"), "k", "value")


LADDER = """CASE WHEN k < 2 THEN 'invalid: unreadable image' WHEN k = 50 THEN 'invalid: image contains no non-zero pixel data'
 WHEN k * 2.55::DOUBLE < 8 THEN 'low_light' WHEN k * 2.55::DOUBLE > 247 THEN 'overexposed' WHEN value < 20 THEN 'blur'
 WHEN k % 23 < 5 THEN 'low_contrast' END"""


@query("photo_rejection_ladder", f"SELECT capture_id, frame_id, {LADDER} AS rejection_reason FROM {FRAMES} f")
def photo_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return quality(spark, sf).select("capture_id", "frame_id", ops.photo_rejection().alias("rejection_reason"))


@query("photo_reason_counts", f"""SELECT capture_id, rejection_reason, count(*) AS n FROM
(SELECT capture_id, {LADDER} AS rejection_reason FROM {FRAMES} f) t GROUP BY ALL""")
def photo_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reason_counts(photo_ladder(spark, sf), ["capture_id"], "rejection_reason")


@query("photo_quality_score", f"""SELECT frame_id, round(sqrt(value) + (k % 23) * 2.0::DOUBLE
 + least(frame_id % 1500, 1000) / 10.0::DOUBLE - abs(k * 2.55::DOUBLE - 127.5) / 10.0::DOUBLE, 6) AS score FROM {FRAMES} f""")
def photo_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality(spark, sf).select("frame_id", F.round(photo_quality(
        F.col("blur"), F.col("contrast"), F.col("features"), F.col("brightness")), 6).alias("score"))


# A camera on a slow walk: position and heading from value and k.
POSE_X, POSE_Y, YAW = "value / 1000", "k / 200.0", "k * 0.004"


def posed(spark: SparkSession, sf: str) -> DataFrame:
    yaw = F.col("k") * 0.004
    pose = rigid.quaternion_pose(
        (F.lit(0.0), F.lit(0.0), F.sin(yaw / 2), F.cos(yaw / 2)),
        (F.col("value") / 1000, F.col("k") / 200.0, F.lit(1.4)))
    return sequenced(spark, sf).withColumn("pose", pose)


@query("motion_keyframes", f"""
WITH RECURSIVE s AS (SELECT capture_id, frame_id, seq, value / 1000 AS px, k / 200.0::DOUBLE AS py, k * 0.004::DOUBLE AS yaw FROM {SEQ} q),
w AS (SELECT capture_id, seq, true AS selected, px, py, yaw, 1 AS kept FROM s WHERE seq = 0
 UNION ALL
 SELECT s.capture_id, s.seq, sel, CASE WHEN sel THEN s.px ELSE w.px END, CASE WHEN sel THEN s.py ELSE w.py END,
  CASE WHEN sel THEN s.yaw ELSE w.yaw END, w.kept + sel::INT
 FROM w JOIN s ON s.capture_id = w.capture_id AND s.seq = w.seq + 1, LATERAL (SELECT w.kept < 80 AND
  (sqrt((s.px - w.px) * (s.px - w.px) + (s.py - w.py) * (s.py - w.py)) >= 0.15 OR degrees(abs(s.yaw - w.yaw)) >= 16) AS sel) c)
SELECT capture_id, seq, selected FROM w""")
def motion_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    cfg = FrameConfig(min_translation=0.15, min_rotation=16.0)
    return folds.motion_keyframes(posed(spark, sf), ["capture_id"], cfg)


@query("visual_keyframes", f"""
WITH RECURSIVE s AS (SELECT capture_id, seq, k, value, seq / 3.0::DOUBLE AS t FROM {SEQ} q),
w AS (SELECT capture_id, seq, NULL::DOUBLE AS visual_change, r AS rejection_reason,
  CASE WHEN r IS NULL THEN k END AS last_k, CASE WHEN r IS NULL THEN t END AS last_t, (r IS NULL)::INT AS kept
 FROM s, LATERAL (SELECT CASE WHEN k < 12 THEN 'dark' WHEN value < 30 THEN 'blur' END AS r) c WHERE seq = 0
 UNION ALL
 SELECT s.capture_id, s.seq, d, r, CASE WHEN r IS NULL THEN s.k ELSE w.last_k END,
  CASE WHEN r IS NULL THEN s.t ELSE w.last_t END, w.kept + (r IS NULL)::INT
 FROM w JOIN s ON s.capture_id = w.capture_id AND s.seq = w.seq + 1,
  LATERAL (SELECT abs(s.k - w.last_k)::DOUBLE * 1.0 AS d) a,
  LATERAL (SELECT CASE WHEN s.k < 12 THEN 'dark' WHEN s.value < 30 THEN 'blur'
   WHEN w.kept > 0 AND s.t - w.last_t < 0.5 THEN 'time' WHEN d < 8 THEN 'duplicate' WHEN w.kept >= 60 THEN 'budget' END AS r) c)
SELECT capture_id, seq, round(visual_change, 6) AS visual_change, rejection_reason FROM w""")
def visual_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    base = sequenced(spark, sf).select(
        "capture_id", "seq", F.col("k").cast("double").alias("brightness"), F.col("value").alias("blur"),
        (F.col("seq") / 3.0).alias("ts"), F.array_repeat(F.col("k").cast("double"), 12).alias("thumb"))
    out = folds.visual_keyframes(base, ["capture_id"], VideoConfig(duplicate=8.0, min_gap=0.5))
    return out.withColumn("visual_change", F.round("visual_change", 6))


@query("photo_selection", f"""
WITH RECURSIVE u AS (SELECT capture_id, frame_id, k, row_number() OVER (PARTITION BY capture_id ORDER BY
  sqrt(value) + (k % 23) * 2.0::DOUBLE + least(frame_id % 1500, 1000) / 10.0::DOUBLE - abs(k * 2.55::DOUBLE - 127.5) / 10.0::DOUBLE DESC, frame_id) - 1 AS seq
  FROM {FRAMES} f WHERE {LADDER} IS NULL),
w AS (SELECT capture_id, seq, [k] AS chosen, NULL::VARCHAR AS reason FROM u WHERE seq = 0
 UNION ALL
 SELECT u.capture_id, u.seq, CASE WHEN r IS NULL THEN list_append(w.chosen, u.k) ELSE w.chosen END, r
 FROM w JOIN u ON u.capture_id = w.capture_id AND u.seq = w.seq + 1, LATERAL (SELECT CASE
  WHEN len(list_filter(w.chosen, lambda c: abs(c - u.k) < 2)) > 0 THEN 'near_duplicate' WHEN len(w.chosen) >= 8 THEN 'selection_budget' END AS r) c),
n AS (SELECT capture_id, count(*) FILTER (WHERE reason IS NULL) AS chosen FROM w GROUP BY 1),
d AS (SELECT w.*, n.chosen AS total, row_number() OVER (PARTITION BY w.capture_id, reason ORDER BY seq) AS nth FROM w JOIN n USING (capture_id))
SELECT capture_id, frame_id, r IS NULL AS selected, r AS rejection_reason FROM (SELECT d.capture_id, u.frame_id,
 CASE WHEN reason = 'near_duplicate' AND nth <= 2 - total THEN NULL ELSE reason END AS r
 FROM d JOIN u ON u.capture_id = d.capture_id AND u.seq = d.seq) z""")
def photo_selection(spark: SparkSession, sf: str) -> DataFrame:
    good = quality(spark, sf).filter(ops.photo_rejection().isNull()).withColumn(
        "score", photo_quality(F.col("blur"), F.col("contrast"), F.col("features"), F.col("brightness")))
    ranked = positions(good.withColumn("_worst", -F.col("score")), ["capture_id"], ["_worst", "frame_id"],
                       F.floor(F.col("_worst")), "seq")
    ranked = ranked.withColumn("thumb", F.array_repeat(F.col("k").cast("double"), 12))
    chosen = folds.select_photos(ranked, ["capture_id"], PhotoConfig())
    return chosen.join(ranked.select("capture_id", "seq", "frame_id"), ["capture_id", "seq"]).select(
        "capture_id", "frame_id", "selected", "rejection_reason")


@query("same_camera", f"""SELECT capture_id, coalesce(bool_and(mk <> '') AND min(sig) = max(sig), false) AS same_camera FROM (
 SELECT capture_id, event_type AS mk, event_type || '|' || (640 + 10 * (k % 2)) AS sig, capture_id * 100 + (frame_id % 25) AS room
 FROM {FRAMES} f) t GROUP BY capture_id, room""".replace("SELECT capture_id, coalesce", "SELECT room, coalesce").replace("GROUP BY capture_id, room", "GROUP BY room"))
def same_camera(spark: SparkSession, sf: str) -> DataFrame:
    photos = P.frames(spark, sf).select(
        (F.col("capture_id") * 100 + F.col("frame_id") % 25).alias("room"), F.col("event_type").alias("camera_make"),
        F.col("event_type").alias("camera_model"), (640 + 10 * (F.col("k") % 2)).alias("width"),
        F.lit(480).alias("height"), F.lit(None).cast("double").alias("focal_length"),
        F.lit(None).cast("double").alias("focal_length_35mm"))
    return ops.same_camera(photos, ["room"])


@query("frame_counters", f"""SELECT capture_id, count(*) AS frames_total, count(*) FILTER (WHERE value >= 20) AS frames_loaded,
 count(*) FILTER (WHERE value < 20) AS frames_invalid, count(*) FILTER (WHERE value >= 20 AND seq % 4 <> 0) AS frames_not_selected,
 count(*) - count(*) FILTER (WHERE value >= 20 AND seq % 4 = 0) AS frames_skipped FROM {SEQ} s GROUP BY 1""")
def frame_counters(spark: SparkSession, sf: str) -> DataFrame:
    status = sequenced(spark, sf).withColumn("status", F.when(F.col("value") >= 20, "ok").otherwise("invalid_depth")) \
        .withColumn("selected", (F.col("status") == "ok") & (F.col("seq") % 4 == 0))
    return ops.frame_counters(status, ["capture_id"])


@query("photo_counters", f"""SELECT capture_id, count(*) AS images_total, count(*) FILTER (WHERE k >= 2) AS images_valid,
 count(*) FILTER (WHERE ({LADDER}) IS NOT NULL) AS images_rejected, count(*) FILTER (WHERE ({LADDER}) IS NULL) AS images_selected
 FROM {FRAMES} f GROUP BY 1""")
def photo_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ops.photo_counters(quality(spark, sf).withColumn("selected", ops.photo_rejection().isNull()), ["capture_id"])


@query("camera_up_prior", f"""SELECT capture_id, round(sqrt(ux * ux + uy * uy + uz * uz), 6) AS coherence,
 sqrt(ux * ux + uy * uy + uz * uz) >= 0.7 AS resolved FROM (SELECT capture_id,
 avg(-cos(k * 0.03::DOUBLE)) AS ux, avg(-sin(k * 0.03::DOUBLE)) AS uy, 0.0 AS uz FROM {FRAMES} f GROUP BY 1) t""")
def camera_up(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.operators.planes import up_prior
    angle = F.col("k") * 0.03
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.sin(angle), F.cos(angle), zero, zero, -F.cos(angle), F.sin(angle), zero, zero,
                   zero, zero, one, zero, zero, zero, zero, one)
    out = up_prior(P.frames(spark, sf).withColumn("pose", pose), ["capture_id"], VideoConfig().up_coherence)
    return out.select("capture_id", F.round("coherence", 6).alias("coherence"), "resolved")


@query("levelled_poses", f"""WITH u AS (SELECT capture_id, ux / n AS ux, uy / n AS uy FROM (SELECT *, sqrt(ux * ux + uy * uy) AS n FROM (SELECT capture_id, avg(-cos(k * 0.03::DOUBLE)) AS ux,
 avg(-sin(k * 0.03::DOUBLE)) AS uy FROM {FRAMES} f GROUP BY 1) a) b WHERE n >= 0.7)
 SELECT f.capture_id, frame_id, 1.4::DOUBLE AS x, round(uy * value / 1000 - ux * k / 200.0::DOUBLE, 6) AS y, round(ux * value / 1000 + uy * k / 200.0::DOUBLE, 6) AS height,
 round(ux * cos(k * 0.03::DOUBLE) + uy * sin(k * 0.03::DOUBLE), 6) AS down FROM {FRAMES} f JOIN u ON u.capture_id = f.capture_id""")
def levelled_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Camera poses turned so that the agreed up direction of their capture is +Z; captures without one have none."""
    from roomfold.operators.planes import up_prior, up_rotation
    angle = F.col("k") * 0.03
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.sin(angle), F.cos(angle), zero, F.col("value") / 1000, -F.cos(angle), F.sin(angle), zero, F.col("k") / 200.0, zero, zero, one, F.lit(1.4), zero, zero, zero, one)
    poses = P.frames(spark, sf).withColumn("pose", pose).select("capture_id", "frame_id", "pose")
    turn = up_rotation(up_prior(poses, ["capture_id"], VideoConfig().up_coherence).filter("resolved"))
    out = ops.level_poses(poses, turn, ["capture_id"])
    return out.select("capture_id", "frame_id", *[F.round(F.col("pose")[i], 6).alias(n) for i, n in ((3, "x"), (7, "y"), (11, "height"), (9, "down"))])
