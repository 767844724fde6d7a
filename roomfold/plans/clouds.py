"""Queries over point clouds derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import FrameConfig, GeometryConfig
from roomfold.operators import clouds, quantiles
from roomfold.operators.measurements import calibration_profiles
from roomfold.plans import projections as P
from roomfold.plans.registry import query
from roomfold.plans.tables import table

POINTS = P.source("lineitem", P.POINTS)
MM = ["x_mm", "y_mm", "z_mm"]


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """Cloud points in metres."""
    return P.points(spark, sf).select("capture_id", *[(F.col(c) / 1000).alias(c[0]) for c in MM])


@query("voxel_sums", f"""SELECT capture_id, floor(x_mm / 250)::BIGINT AS vx, floor(y_mm / 250)::BIGINT AS vy, floor(z_mm / 250)::BIGINT AS vz,
 count(*) AS n, sum(x_mm)::BIGINT AS sum_x_mm, sum(y_mm)::BIGINT AS sum_y_mm, sum(z_mm)::BIGINT AS sum_z_mm FROM {POINTS} p GROUP BY 1, 2, 3, 4""")
def voxel_sums(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.voxel_sums(P.points(spark, sf), ["capture_id"], 250, MM)


@query("frame_fusion", f"""WITH v AS (SELECT capture_id, floor(x_mm / 1000.0::DOUBLE / 0.03) AS vx, floor(y_mm / 1000.0::DOUBLE / 0.03) AS vy, floor(z_mm / 1000.0::DOUBLE / 0.03) AS vz,
 count(*) AS n, avg(x_mm / 1000.0::DOUBLE) AS x FROM {POINTS} p GROUP BY 1, 2, 3, 4)
 SELECT capture_id, count(*) AS cells, sum(n)::BIGINT AS points, round(avg(x), 6) AS mean_x, CASE WHEN count(*) > 2000 THEN 'FUSION_POINT_BUDGET_EXCEEDED' END AS issue FROM v GROUP BY 1""")
def frame_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused, issues = clouds.fuse_frames(metric_points(spark, sf), ["capture_id"], FrameConfig(max_fused_points=2000))
    sums = fused.groupBy("capture_id").agg(F.count("*").alias("cells"), F.sum("n").alias("points"),
                                           F.round(F.avg("x"), 6).alias("mean_x"))
    return sums.join(issues.select("capture_id", F.col("code").alias("issue")), "capture_id", "left")


@query("point_budget_issues", f"""SELECT capture_id, 'POINT_BUDGET_EXCEEDED' AS code, count(*) AS points FROM {POINTS} p GROUP BY 1 HAVING count(*) > 600""")
def point_budget_issues(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.over_budget(P.points(spark, sf), ["capture_id"], 600, "POINT_BUDGET_EXCEEDED")[1]


@query("cloud_checks", f"""SELECT capture_id, count(*) AS points, count(*) FILTER (WHERE l_linenumber = 7 AND capture_id % 9 = 0) AS non_finite,
 CASE WHEN count(*) FILTER (WHERE l_linenumber = 7 AND capture_id % 9 = 0) > 0 THEN 'non_finite' WHEN count(*) < 590 THEN 'insufficient' ELSE 'ok' END AS status
 FROM {POINTS} p GROUP BY 1""")
def cloud_checks(spark: SparkSession, sf: str) -> DataFrame:
    broken = (F.col("l_linenumber") == 7) & (F.col("capture_id") % 9 == 0)
    metric = P.points(spark, sf).select("capture_id", F.when(broken, float("nan")).otherwise(F.col("x_mm") / 1000).alias("x"),
                                        (F.col("y_mm") / 1000).alias("y"), (F.col("z_mm") / 1000).alias("z"))
    return clouds.cloud_checks(metric, ["capture_id"], GeometryConfig(min_points=590))


@query("robust_extents", f"""SELECT capture_id, count(*) AS n, round(quantile_cont(y_mm, 0.02), 6) AS low, round(quantile_cont(y_mm, 0.98), 6) AS high,
 round(quantile_cont(y_mm, 0.005), 6) AS floor_q FROM {POINTS} p GROUP BY 1""")
def robust_extents(spark: SparkSession, sf: str) -> DataFrame:
    out = quantiles.weighted_quantiles(P.points(spark, sf).select("capture_id", F.col("y_mm").cast("double").alias("y_mm")),
                                       ["capture_id"], "y_mm", {"low": 0.02, "high": 0.98, "floor_q": 0.005}, 100)
    return out.select("capture_id", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "floor_q")])


@query("median_and_mad", f"""WITH m AS (SELECT capture_id, median(y_mm) AS med FROM {POINTS} p GROUP BY 1)
 SELECT p.capture_id, count(*) AS n, round(any_value(med), 6) AS median, round(median(abs(y_mm - med)), 6) AS mad,
 round(1.4826 * median(abs(y_mm - med)), 6) AS scaled_mad FROM {POINTS} p JOIN m USING (capture_id) GROUP BY 1""")
def median_and_mad(spark: SparkSession, sf: str) -> DataFrame:
    pts = P.points(spark, sf).select("capture_id", F.col("y_mm").cast("double").alias("y"))
    out = quantiles.median_mad(pts, ["capture_id"], "y", 100)
    return out.select("capture_id", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"),
                      F.round(F.col("mad") * 1.4826, 6).alias("scaled_mad"))


@query("convex_hulls")
def convex_hulls(spark: SparkSession, sf: str) -> DataFrame:
    hull = clouds.convex_hulls(P.points(spark, sf), ["capture_id"], "x_mm", "y_mm")
    return hull.select("capture_id", F.round("hull_area", 3).alias("hull_area"), "min_x", "min_y", "max_x", "max_y",
                       F.size("ring").alias("vertices"))


def voxelised(spark: SparkSession, sf: str) -> DataFrame:
    """One point per 250 mm cell, at the cell centre, with an id that orders ties."""
    cells = clouds.voxel_sums(P.points(spark, sf), ["capture_id"], 250, MM)
    place = [(F.col(f"v{c}") * 0.25).alias(c) for c in "xyz"]
    return cells.select("capture_id", (F.col("vx") * 10000 + F.col("vy") * 100 + F.col("vz")).alias("point_id"), *place)


CELLS = f"""(SELECT DISTINCT capture_id, floor(x_mm / 250)::BIGINT AS vx, floor(y_mm / 250)::BIGINT AS vy, floor(z_mm / 250)::BIGINT AS vz FROM {POINTS} p)"""
PAIRS = f"""(SELECT a.capture_id, a.vx * 10000 + a.vy * 100 + a.vz AS point_id, b.vx * 10000 + b.vy * 100 + b.vz AS b_id,
 b.vx * 0.25::DOUBLE AS bx, b.vy * 0.25::DOUBLE AS by_, b.vz * 0.25::DOUBLE AS bz,
 ((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)+(a.vz-b.vz)*(a.vz-b.vz))::DOUBLE * 0.0625 AS d2 FROM {CELLS} a JOIN {CELLS} b
 ON a.capture_id = b.capture_id)"""


@query("radius_neighbours", f"""SELECT capture_id, point_id, count(*) AS neighbours, round(sum(sqrt(d2)), 6) AS distance_sum FROM {PAIRS} q WHERE d2 <= 0.36 GROUP BY 1, 2""")
def radius_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = clouds.fold_in_radius(voxelised(spark, sf), ["capture_id"], "point_id", 0.6, None, clouds.distances, "neighbours long, distance_sum double")
    return near.withColumn("distance_sum", F.round("distance_sum", 6))


@query("nearest_k_neighbours", f"""SELECT capture_id, point_id, round(avg(sqrt(d2)), 6) AS mean_distance FROM (SELECT *, row_number() OVER
 (PARTITION BY capture_id, point_id ORDER BY d2, b_id) AS r FROM {PAIRS} q) t WHERE r <= 8 GROUP BY 1, 2""")
def nearest_k(spark: SparkSession, sf: str) -> DataFrame:
    near = clouds.nearest_k(voxelised(spark, sf), ["capture_id"], "point_id", 8, 0.6)
    return near.groupBy("capture_id", "point_id").agg(F.round(F.avg(F.sqrt("d2")), 6).alias("mean_distance"))


@query("statistical_outliers", f"""WITH m AS (SELECT capture_id, point_id, avg(sqrt(d2)) AS d FROM (SELECT *, row_number() OVER
 (PARTITION BY capture_id, point_id ORDER BY d2, b_id) AS r FROM {PAIRS} q) t WHERE r <= 8 GROUP BY 1, 2),
 l AS (SELECT capture_id, avg(d) + 1.5 * stddev_samp(d) AS lim FROM m GROUP BY 1)
 SELECT capture_id, count(*) AS kept, sum(point_id)::BIGINT AS id_sum FROM m JOIN l USING (capture_id) WHERE d > 0 AND d < lim GROUP BY 1""")
def statistical_outliers(spark: SparkSession, sf: str) -> DataFrame:
    kept = clouds.drop_outliers(voxelised(spark, sf), ["capture_id"], "point_id", 8, 1.5, 0.6)
    return kept.groupBy("capture_id").agg(F.count("*").alias("kept"), F.sum("point_id").alias("id_sum"))


@query("point_normals")
def point_normals(spark: SparkSession, sf: str) -> DataFrame:
    out = clouds.point_normals(voxelised(spark, sf), ["capture_id"], "point_id", 0.6, 12)
    return out.select("capture_id", "point_id", *[F.round(c, 4).alias(c) for c in ("nx", "ny", "nz")], "neighbours")


TRUTH = """(SELECT l_returnflag AS tier, p_type AS measurement_type, l_extendedprice / l_quantity AS measured_value,
 p_retailprice AS ground_truth_value FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("tier"), F.col("p_type").alias("measurement_type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("measured_value"),
        F.col("p_retailprice").alias("ground_truth_value"))


@query("calibration_profiles", f"""SELECT tier, measurement_type, 0.95::DOUBLE AS profile_level, count(*) AS benchmark_rows,
 round(quantile_cont(abs(measured_value - ground_truth_value), 0.95), 6) AS absolute_error FROM {TRUTH} t GROUP BY 1, 2""")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return calibration_profiles(truth(spark, sf), width=5.0).withColumn("absolute_error", F.round("absolute_error", 6))
