"""Queries over matches, registrations and metric scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import FrameConfig, GeometryConfig, ScaleConfig, StitchConfig
from roomfold.functions import rigid
from roomfold.operators import folds, matching, planes, scale
from roomfold.operators.ordering import next_by_position
from roomfold.plans import frames as FR
from roomfold.plans.registry import query
from roomfold.plans.tables import table


@query("descriptor_matches", """WITH e AS (SELECT vec_id, vec_id // 64 AS frame, embedding::DOUBLE[] AS d FROM embeddings),
 p AS (SELECT a.frame AS pair_id, a.vec_id AS a_id, b.vec_id AS b_id, list_distance(a.d, b.d) AS dist FROM e a JOIN e b ON b.frame = a.frame + 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a_id ORDER BY dist, b_id) AS n FROM p)
 SELECT x.pair_id, x.a_id, x.b_id, round(x.dist, 5) AS distance FROM r x JOIN r y ON y.a_id = x.a_id AND y.pair_id = x.pair_id AND x.n = 1 AND y.n = 2 WHERE x.dist < 0.95 * y.dist""")
def descriptor_matches(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 64").alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("descriptor"))
    first = vectors.select(F.col("frame").alias("pair_id"), F.col("vec_id").alias("a_id"), "descriptor")
    second = vectors.select((F.col("frame") - 1).alias("pair_id"), F.col("vec_id").alias("b_id"), "descriptor")
    out = matching.descriptor_matches(first, second, ["pair_id"], StitchConfig(ratio_test=0.95))
    return out.select("pair_id", "a_id", "b_id", F.round("distance", 5).alias("distance"))


@query("loop_candidates", f"""WITH f AS (SELECT capture_id, seq, value / 1000 AS px, k / 200.0::DOUBLE AS py, k * 0.004::DOUBLE AS yaw FROM {FR.SEQ} q),
 p AS (SELECT a.capture_id, b.seq AS source, a.seq AS target, sqrt((a.px - b.px) ^ 2 + (a.py - b.py) ^ 2) AS d FROM f a JOIN f b ON a.capture_id = b.capture_id AND a.seq - b.seq >= 8
 WHERE degrees(abs(a.yaw - b.yaw)) <= 35 AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= 0.64),
 r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, target ORDER BY d, source) AS n FROM p) SELECT capture_id, source, target, round(d, 6) AS distance FROM r WHERE n <= 2""")
def loop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = matching.loop_candidates(FR.posed(spark, sf), ["capture_id"], FrameConfig())
    return out.select("capture_id", "source", "target", F.round("distance", 6).alias("distance"))


PLANAR = """(SELECT l_suppkey, l_quantity / 10 AS bx, l_discount * 20 AS by_, 3 + cos(0.4::DOUBLE) * l_quantity / 10 - sin(0.4::DOUBLE) * l_discount * 20 + l_tax AS ax,
 -1 + sin(0.4::DOUBLE) * l_quantity / 10 + cos(0.4::DOUBLE) * l_discount * 20 - l_tax AS ay FROM lineitem)"""


def planar_points(spark: SparkSession, sf: str) -> DataFrame:
    bx, by, c, s = F.col("l_quantity") / 10, F.col("l_discount") * 20, F.cos(F.lit(0.4)), F.sin(F.lit(0.4))
    return table(spark, sf, "lineitem").select(
        "l_suppkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("i"), bx.alias("bx"), by.alias("by"), (3 + c * bx - s * by + F.col("l_tax")).alias("ax"),
        (-1 + s * bx + c * by - F.col("l_tax")).alias("ay"))


@query("planar_fit", f"""SELECT l_suppkey, support, round(yaw, 6) AS yaw, round(max_ - (cos(yaw) * mbx - sin(yaw) * mby), 6) AS tx FROM (SELECT l_suppkey, count(*) AS support, avg(bx) AS mbx, avg(by_) AS mby, avg(ax) AS max_,
 atan2(covar_pop(bx, ay) - covar_pop(by_, ax), covar_pop(bx, ax) + covar_pop(by_, ay)) AS yaw FROM {PLANAR} p GROUP BY 1) t""")
def planar_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = matching.fit_se2(planar_points(spark, sf), ["l_suppkey"])
    return out.select("l_suppkey", "support", F.round("yaw", 6).alias("yaw"), F.round("tx", 6).alias("tx"))


@query("robust_planar_fit")
def robust_planar_fit(spark: SparkSession, sf: str) -> DataFrame:
    refit, _ = matching.robust_se2(planar_points(spark, sf), ["l_suppkey"], StitchConfig())
    return refit.select("l_suppkey", F.round("yaw", 3).alias("yaw"), F.round("tx", 3).alias("tx"), "support")


@query("two_view_verification")
def two_view_verification(spark: SparkSession, sf: str) -> DataFrame:
    # A plane seen twice; items with tax far from the plane's are outliers. A group is one part's items.
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("pair_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey").alias("match_id"), (F.col("l_quantity") * 10).alias("ax"), (F.col("l_suppkey") * 1.0).alias("ay"),
        (F.col("l_quantity") * 9 + F.col("l_suppkey") * 0.1 + F.when(F.col("l_tax") > 0.06, 90.0).otherwise(0.0)).alias("bx"), (F.col("l_suppkey") * 1.1 - F.col("l_quantity") * 0.3).alias("by"))
    return matching.verify_pairs(rows, ["pair_id"]).groupBy("pair_id").agg(F.count("*").alias("matches"), F.count_if("inlier").alias("inliers"))


@query("pair_scores", """SELECT l_orderkey, l_linenumber, l_partkey, round(v, 6) AS visual, round(g, 6) AS geometry, round(0.45 * v + 0.55 * g, 6) AS score,
 has AND raw >= 30 AND inl / raw >= 0.25 AND 0.45 * v + 0.55 * g >= 0.35 AS accepted FROM (SELECT *, least(1, inl / 24.0::DOUBLE) * (inl / raw) AS v, metric / greatest(inl, 1) AS g FROM
 (SELECT *, l_quantity + 7 AS raw, floor((l_quantity + 7) * l_discount * 10) AS inl, floor((l_quantity + 7) * l_discount * 10 * 0.7) AS metric, l_returnflag <> 'N' AS has FROM lineitem) a) b""")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("l_quantity") + 7
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw_matches"), F.floor(raw * F.col("l_discount") * 10).cast("double").alias("inliers"),
        F.floor(raw * F.col("l_discount") * 10 * 0.7).cast("double").alias("metric_inliers"), (F.col("l_returnflag") != "N").alias("has_transform"))
    return matching.score_pairs(rows).select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in ("visual", "geometry", "score")], "accepted")


@query("registration_verdicts", """SELECT l_orderkey, l_linenumber, l_partkey, nullif(array_to_string(list_filter([CASE WHEN f < CASE WHEN lp THEN 0.5 ELSE 0.25 END THEN 'low fitness' END,
 CASE WHEN f = 0 OR l_tax > CASE WHEN lp THEN 0.05 ELSE 0.06 END THEN 'insufficient correspondences or high RMSE' END, CASE WHEN lp AND least(f, l_quantity / 50) < 0.5 THEN 'low bidirectional overlap' END,
 CASE WHEN l_linenumber / 10.0 > 0.5 OR l_quantity / 3 > 15 THEN 'excessive transform deviation' END], lambda x: x IS NOT NULL), '; '), '') AS rejection_reason FROM (SELECT *, l_discount * 10 AS f, l_returnflag = 'A' AS lp FROM lineitem) t""")
def registration_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "loop").otherwise("neighbor").alias("kind"), (F.col("l_discount") * 10).alias("fitness"), F.col("l_tax").alias("rmse"),
        (F.col("l_quantity") / 50).alias("reverse_fitness"), (F.col("l_linenumber") / 10.0).alias("translation_change"), (F.col("l_quantity") / 3).alias("rotation_change"))
    return matching.judge_registrations(rows).select("l_orderkey", "l_linenumber", "l_partkey", "rejection_reason")


def keyframe_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Motion keyframes, and neighbour edges whose fit differs slightly from the device poses."""
    from roomfold.session import cut
    posed = cut(FR.posed(spark, sf))
    kept = folds.motion_keyframes(posed, ["capture_id"], FrameConfig(min_translation=0.15, min_rotation=16.0)).filter("selected")
    chosen = posed.join(kept, ["capture_id", "seq"]).select("capture_id", "seq", "pose", "k")
    from roomfold.operators.ordering import positions
    nodes = cut(positions(chosen, ["capture_id"], ["seq"], F.floor(F.col("seq") / 1000), "node").drop("seq").withColumnRenamed("node", "seq"))
    steps = next_by_position(nodes.withColumn("me", F.col("seq")), ["capture_id"], "seq", "pose", "next_pose")
    initial = rigid.compose(rigid.invert(F.col("next_pose")), F.col("pose"))
    nudge = F.transform(F.col("initial"), lambda v, i: F.when(i == 3, v + 0.01).otherwise(v))
    eye = F.array(*[F.lit(100.0 if r == c else 0.0) for r in range(6) for c in range(6)])
    edges = steps.withColumn("initial", initial).select(
        "capture_id", F.col("seq").alias("source"), (F.col("seq") + 1).alias("target"), F.lit("neighbor").alias("kind"), "initial", nudge.alias("optimized"), eye.alias("information"),
        (F.col("k") % 4 != 0).alias("accepted"))
    return nodes, cut(edges)


@query("drift_correction")
def drift_correction(spark: SparkSession, sf: str) -> DataFrame:
    nodes, records = keyframe_edges(spark, sf)
    edges = matching.graph_edges(records).select("capture_id", "source", "target", "transform", "information", "uncertain")
    after = matching.correct_drift(nodes, edges, ["capture_id"])
    out = matching.pose_corrections(nodes, after, ["capture_id"])
    return out.select("capture_id", "seq", F.round("translation_m", 4).alias("translation_m"), F.round("rotation_degrees", 3).alias("rotation_degrees"))


# Edges disagree with the device poses by 1, 2 or 3 cm; the corrected poses are the device's, so both residuals are that.
@query("drift_comparison", f"""SELECT capture_id, seq - 1 AS source, round(0.01::DOUBLE * (1 + (seq - 1) % 3), 6) AS before, round(0.01::DOUBLE * (1 + (seq - 1) % 3), 6) AS after, 0.0::DOUBLE AS turned
 FROM {FR.SEQ} q WHERE seq > 0""")
def drift_comparison(spark: SparkSession, sf: str) -> DataFrame:
    posed = FR.posed(spark, sf)
    steps = next_by_position(posed, ["capture_id"], "seq", "pose", "next_pose").withColumn("initial", rigid.compose(rigid.invert(F.col("next_pose")), F.col("pose")))
    off = F.lit(0.01) * (1 + F.col("source") % 3)
    records = steps.withColumn("source", F.col("seq")).select("capture_id", "source", (F.col("seq") + 1).alias("target"), F.lit("neighbor").alias("kind"), F.lit(True).alias("accepted"), "initial",
                                                              F.transform("initial", lambda v, i: F.when(i == 3, v + off).otherwise(v)).alias("optimized"))
    out = matching.drift_comparison(records, posed, ["capture_id"])
    turned = F.round(F.greatest("rotation_before", "rotation_after"), 3) + 0.0
    return out.select("capture_id", "source", F.round("translation_before", 6).alias("before"), F.round("translation_after", 6).alias("after"), turned.alias("turned"))


RATIOS = "(SELECT l_suppkey AS capture_id, l_linenumber AS frame_id, 2 + (l_linenumber - 4) * 0.15::DOUBLE + l_discount * 2 + CASE WHEN l_partkey % 29 = 0 THEN 8 ELSE 0 END AS ratio FROM lineitem)"


@query("metric_scale", f"""WITH c AS (SELECT capture_id, frame_id, count(*) AS n, median(ratio) AS med FROM {RATIOS} r GROUP BY 1, 2 HAVING count(*) >= 70),
 s AS (SELECT capture_id, frame_id, any_value(med) AS med, median(abs(ratio - med)) AS mad FROM {RATIOS} r JOIN c USING (capture_id, frame_id) GROUP BY 1, 2),
 k AS (SELECT capture_id, frame_id, ratio FROM {RATIOS} r JOIN s USING (capture_id, frame_id) WHERE abs(ratio - med) <= greatest(0.05 * med, 3.5 * 1.4826 * mad)),
 f AS (SELECT capture_id, frame_id, median(ratio) AS fs FROM k GROUP BY 1, 2 HAVING count(*) >= 70),
 m AS (SELECT capture_id, count(*) AS frames, median(fs) AS centre FROM f GROUP BY 1),
 a AS (SELECT f.*, abs(fs / centre - 1) <= 0.12 AS ok, frames, centre FROM f JOIN m USING (capture_id)),
 g AS (SELECT capture_id, any_value(frames) AS frames, any_value(centre) AS centre, count(*) FILTER (WHERE ok) AS acc, median(fs) FILTER (WHERE ok) AS scale FROM a GROUP BY 1),
 p AS (SELECT k.capture_id, ratio, scale FROM k JOIN a ON a.capture_id = k.capture_id AND a.frame_id = k.frame_id AND a.ok JOIN g ON g.capture_id = k.capture_id),
 d AS (SELECT capture_id, median(abs(ratio - scale)) AS mad FROM p GROUP BY 1),
 u AS (SELECT p.capture_id, count(*) FILTER (WHERE abs(ratio - scale) <= greatest(0.05 * scale, 3.5 * 1.4826 * mad)) AS used FROM p JOIN d USING (capture_id) GROUP BY 1)
 SELECT x.capture_id, CASE WHEN coalesce(frames, 0) < 3 THEN 'Insufficient frames with reliable depth/SfM correspondences' WHEN acc < 3 THEN 'Frame scale estimates are inconsistent'
 WHEN used < 100 OR mad / scale > 0.25 THEN 'Insufficient consistent scale support or excessive relative dispersion' END AS failure_reason,
 CASE WHEN frames >= 3 AND acc >= 3 AND used >= 100 AND mad / scale <= 0.25 THEN round(scale, 6) END AS global_scale, CASE WHEN frames >= 3 AND acc >= 3 THEN used ELSE 0 END AS correspondences_used,
 CASE WHEN frames >= 3 THEN round(centre, 6) END AS frame_scale_median FROM (SELECT DISTINCT capture_id FROM {RATIOS} r) x LEFT JOIN g USING (capture_id) LEFT JOIN d USING (capture_id) LEFT JOIN u USING (capture_id)""")
def metric_scale(spark: SparkSession, sf: str) -> DataFrame:
    ratio = 2 + (F.col("l_linenumber") - 4) * 0.15 + F.col("l_discount") * 2 + F.when(F.col("l_partkey") % 29 == 0, 8).otherwise(0)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_linenumber").alias("frame_id"), ratio.alias("ratio"))
    out = scale.estimate_scale(rows, rows.select("capture_id"), ScaleConfig(min_frame_correspondences=70, consistency=0.12))
    return out.select("capture_id", "failure_reason", F.round("global_scale", 6).alias("global_scale"), "correspondences_used", F.round("frame_scale_median", 6).alias("frame_scale_median"))


# Sparse points per (supplier, part); frames look along +Z from x = line number / 10.
OBS = """(SELECT l_suppkey AS s, l_linenumber AS f, l_partkey AS p, 500 * (l_partkey % 13 / 5.0::DOUBLE - l_linenumber * 0.1::DOUBLE) / (4 + l_partkey % 7) + 320 AS u, 500 * (l_partkey % 11 / 5.0::DOUBLE) / (4 + l_partkey % 7) + 240 AS v,
 500 * (l_partkey % 13 / 5.0::DOUBLE - l_linenumber * 0.1::DOUBLE) / (4 + l_partkey % 7) + 320 + l_discount * 30 AS ox, 500 * (l_partkey % 11 / 5.0::DOUBLE) / (4 + l_partkey % 7) + 240 AS oy, 4 + l_partkey % 7 AS z FROM lineitem)"""


@query("scale_correspondences", f"""SELECT s AS capture_id, f AS frame_id, count(*) AS n, round(sum((z * 2 + f * 0.01::DOUBLE) / z), 5) AS ratio_sum FROM {OBS} o WHERE abs(u - ox) <= 2 AND u >= 5 AND u < 635 AND v >= 5 AND v < 475 AND p % 10 <> 3 GROUP BY 1, 2""")
def scale_correspondences(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_linenumber").alias("frame_id"), F.col("l_partkey").alias("point_id"), "l_discount")
    z = 4 + F.col("point_id") % 7
    points = items.select("capture_id", "point_id").distinct().select(
        "capture_id", "point_id", (F.col("point_id") % 13 / 5.0).alias("px"), (F.col("point_id") % 11 / 5.0).alias("py"), z.cast("double").alias("pz"),
        F.when(F.col("point_id") % 10 == 3, 9.0).otherwise(0.1).alias("reprojection_error"))
    zero, one = F.lit(0.0), F.lit(1.0)
    shift = F.col("frame_id") * 0.1
    frames = items.select("capture_id", "frame_id").distinct().select(
        "capture_id", F.col("frame_id").alias("image_id"), "frame_id", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"),
        F.lit(240.0).alias("cy"), F.array(one, zero, zero, shift, zero, one, zero, zero, zero, zero, one, zero, zero, zero, zero, one).alias("camera_to_world"))
    u = 500 * (F.col("point_id") % 13 / 5.0 - shift) / z + 320
    v = 500 * (F.col("point_id") % 11 / 5.0) / z + 240
    seen = items.select("capture_id", F.col("frame_id").alias("image_id"), "point_id", (u + F.col("l_discount") * 30).alias("ox"), v.alias("oy"))
    # One depth sample per pixel and point depth: the nearest surface wins in a real map, here the map is keyed by point depth.
    depth = items.withColumn("row", F.rint(v).cast("int")).withColumn("col", F.rint(u).cast("int")).select(
        "capture_id", "frame_id", "row", "col", (z * 2 + F.col("frame_id") * 0.01).alias("z"), z.alias("zone")).distinct()
    keyed = lambda df, zone: df.withColumn("capture_id", F.concat_ws(":", F.col("capture_id"), zone))
    zone = F.col("point_id") % 7
    frames7 = frames.withColumn("_zone", F.explode(F.sequence(F.lit(0), F.lit(6))))
    out = scale.correspondences(keyed(frames7, F.col("_zone")), keyed(seen, zone), keyed(points, zone), keyed(depth, F.col("zone") - 4), ScaleConfig(depth_max=30.0))
    return out.groupBy(F.split("capture_id", ":")[0].cast("long").alias("capture_id"), "frame_id").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 5).alias("ratio_sum"))


@query("weak_room_scales", """SELECT o_custkey AS property_id, list_sort(list_distinct(list(o_orderkey))) AS rooms FROM orders WHERE 1 / (1 + o_totalprice / 1000000) < 0.7 OR o_totalprice / 1000000 > 0.25 GROUP BY 1""")
def weak_room_scales(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("room_id"), F.lit(2.0).alias("global_scale"),
                                             (F.col("o_totalprice") / 500000).alias("scale_mad"), (1 / (1 + F.col("o_totalprice") / 1000000)).alias("quality"))
    return scale.weak_rooms(scale.room_scale_quality(rows, ScaleConfig(min_room_quality=0.7)), ["property_id"])


# Plane moments of the clutter, floor and ceiling layers of every supplier cloud.
@query("vertical_agreement", """SELECT l_suppkey AS capture_id, l_linenumber AS pair, count(*) FILTER (WHERE abs(l_discount * 5) <= 0.36) AS metric_inliers,
 count(*) FILTER (WHERE abs(l_discount * 5) <= 0.36) >= 12 AS supported FROM lineitem GROUP BY 1, 2""")
def vertical_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Inliers of a pair that agree in height too, and whether enough are left."""
    inliers = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_linenumber").alias("pair"), F.lit(0.0).alias("az"), (F.col("l_discount") * 5).alias("bz"))
    return matching.vertical_agreement(inliers, ["capture_id", "pair"])


@query("plane_fits", """SELECT l_suppkey AS capture_id, l_returnflag AS plane_no, count(*) AS n, round(avg(l_quantity / 10), 6) AS cx, round(avg(l_discount * 40), 6) AS cy,
 0::DOUBLE AS tilt, round(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN -2.8 ELSE -1.5 END, 6)::DOUBLE AS "offset" FROM lineitem GROUP BY 1, 2""")
def plane_fits(spark: SparkSession, sf: str) -> DataFrame:
    z = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "R", 2.8).otherwise(1.5)
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_returnflag").alias("plane_no"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 40).alias("y"), z.alias("z"))
    out = planes.fit_planes(members, ["capture_id", "plane_no"])
    return out.select("capture_id", "plane_no", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), (F.round(F.abs("nx") + F.abs("ny"), 6) + 0.0).alias("tilt"),
                      (F.round("offset", 6) + 0.0).alias("offset"))


def layered(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier clouds in metres with unique point ids."""
    from roomfold.plans import projections as P
    return P.points(spark, sf).select("capture_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "x_mm", "y_mm").alias("point_id"), (F.col("x_mm") / 1000).alias("x"),
                                      (F.col("y_mm") / 1000).alias("y"), (F.col("z_mm") / 1000).alias("z"))


# The two layers are exact planes, so the first two extracted planes are the two layers, larger first.
@query("extracted_planes", """SELECT l_suppkey AS capture_id, count(*) AS inliers FROM lineitem WHERE l_returnflag IN ('A', 'R') OR floor(l_tax * 35000) <= 25 OR floor(l_tax * 35000) >= 2775 GROUP BY 1""")
def extracted_planes(spark: SparkSession, sf: str) -> DataFrame:
    members = planes.extract_planes(layered(spark, sf), ["capture_id"], GeometryConfig())
    return members.groupBy("capture_id").agg(F.count("*").alias("inliers"))


@query("room_geometry")
def room_geometry(spark: SparkSession, sf: str) -> DataFrame:
    rooms = planes.room_geometry(layered(spark, sf), ["capture_id"], GeometryConfig())["rooms"]
    return rooms.select("capture_id", "points", F.round("ceiling_height", 3).alias("ceiling_height"), F.round("floor_rmse", 4).alias("floor_rmse"), "codes")
