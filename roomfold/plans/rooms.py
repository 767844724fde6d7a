"""Queries over walls found twice: merging, crossings, closed rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import GeometryConfig
from roomfold.operators import planes, polygons
from roomfold.plans.registry import query
from roomfold.plans.tables import table
from roomfold.session import cut

# Every line item is a point on a wall of its supplier's room: four walls, or six around a corner. A wall is seen in two
# pieces that overlap and share points; in every fifth room the second piece of the first wall stands 20 cm off.
_BASE = """SELECT l_suppkey AS capture_id, (l_orderkey * 8 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) % 100000000 AS point_id,
 l_orderkey, l_suppkey % 2 AS bend, cast(5 + l_suppkey % 3 AS double) AS w, cast(4 + l_suppkey % 5 % 2 AS double) AS d,
 (l_orderkey + l_partkey) % (CASE WHEN l_suppkey % 2 = 0 THEN 4 ELSE 6 END) AS k, (l_quantity - 1) / 49 AS f, l_tax * 35 AS z FROM lineitem"""
_SX = "CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN w WHEN k = 2 THEN w WHEN bend = 0 THEN 0 WHEN k < 5 THEN w - 2 ELSE 0 END"
_SY = "CASE WHEN k < 2 THEN 0 WHEN bend = 0 THEN d WHEN k < 4 THEN 2 ELSE d END"
_EX = "CASE WHEN k < 2 THEN w WHEN bend = 0 THEN 0 WHEN k < 4 THEN w - 2 ELSE 0 END"
_EY = "CASE WHEN k = 0 THEN 0 WHEN bend = 0 THEN CASE WHEN k < 3 THEN d ELSE 0 END WHEN k < 3 THEN 2 WHEN k < 5 THEN d ELSE 0 END"
_ENDS = f"SELECT *, {_SX} AS sx, {_SY} AS sy, {_EX} AS ex, {_EY} AS ey FROM ({_BASE}) b"
_FIRST, _LAST = "(f <= 0.4 OR (f < 0.6 AND (l_orderkey % 2 = 0 OR f BETWEEN 0.48 AND 0.52)))", "(f >= 0.6 OR (f > 0.4 AND (l_orderkey % 2 = 1 OR f BETWEEN 0.48 AND 0.52)))"
_PIECES = " UNION ALL ".join(
    f"SELECT capture_id, point_id, w, d, bend, k, f, z, sx, sy, ex, ey, cast(2 * k + {n} AS int) AS plane_no FROM ({_ENDS}) e WHERE {seen}"
    for n, seen in ((1, _FIRST), (2, _LAST)))
MEMBERS = f"""SELECT capture_id, plane_no, point_id, sx + (ex - sx) * f AS x, sy + (ey - sy) * f + CASE WHEN plane_no = 2 AND capture_id % 5 = 0 THEN 0.2 ELSE 0 END AS y, z,
 k, f, w, d, bend, sx, sy, ex, ey FROM ({_PIECES}) p"""

# Walls after merging, from what is known of the rooms: the eligible pieces of a wall are one, but for the one that stands off.
_MERGED = f"""q AS (SELECT *, f * (abs(ex - sx) + abs(ey - sy)) AS t FROM ({MEMBERS}) a),
 e AS (SELECT capture_id, plane_no FROM q GROUP BY 1, 2 HAVING quantile_cont(t, 0.995) - quantile_cont(t, 0.005) >= 0.7
  AND quantile_cont(z, 0.995) - quantile_cont(z, 0.005) >= 1.2 AND abs(quantile_cont(z, 0.005)) <= 0.35),
 m AS (SELECT capture_id, min(plane_no) AS plane_no, point_id, x, y, z, t, abs(ex - sx) + abs(ey - sy) AS len, sx, sy, ex, ey, w, d, bend,
  CASE WHEN plane_no = 2 AND capture_id % 5 = 0 THEN -1 ELSE k END AS line FROM q JOIN e USING (capture_id, plane_no) GROUP BY ALL),
 wall AS (SELECT capture_id, min(plane_no) AS plane_no, count(*) AS n, sum(point_id % 1000003)::BIGINT AS id_sum, quantile_cont(t, 0.005) AS t0, quantile_cont(t, 0.995) AS t1,
  quantile_cont(z, 0.995) - quantile_cont(z, 0.005) AS height, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) = max(x) AS upright, min(sx) AS sx, min(sy) AS sy, min(ex) AS ex, min(ey) AS ey,
  min(len) AS len, min(y) AS y_line, min(x) AS x_line, min(w) AS w, min(d) AS d, min(bend) AS bend FROM m GROUP BY capture_id, line)"""
_CROSSED = f"""{_MERGED},
 seg AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY round(cx, 9), round(cy, 9), cz) AS wall_no,
  CASE WHEN upright THEN least(sy + sign(ey - sy) * t0, sy + sign(ey - sy) * t1) ELSE least(sx + sign(ex - sx) * t0, sx + sign(ex - sx) * t1) END AS low,
  CASE WHEN upright THEN greatest(sy + sign(ey - sy) * t0, sy + sign(ey - sy) * t1) ELSE greatest(sx + sign(ex - sx) * t0, sx + sign(ex - sx) * t1) END AS high FROM wall),
 hit AS (SELECT a.capture_id, least(a.wall_no, b.wall_no) AS a_wall_no, greatest(a.wall_no, b.wall_no) AS b_wall_no, a.x_line AS x, b.y_line AS y,
  least(abs(b.y_line - a.low), abs(b.y_line - a.high)) AS ga, least(abs(a.x_line - b.low), abs(a.x_line - b.high)) AS gb
  FROM seg a JOIN seg b ON a.capture_id = b.capture_id AND a.upright AND NOT b.upright
  WHERE b.y_line BETWEEN a.low - 0.3 AND a.high + 0.3 AND a.x_line BETWEEN b.low - 0.3 AND b.high + 0.3
  AND least(abs(b.y_line - a.low), abs(b.y_line - a.high)) <= 0.3 AND least(abs(a.x_line - b.low), abs(a.x_line - b.high)) <= 0.3)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the wall pieces, a shared point once in each piece."""
    lines = table(spark, sf, "lineitem")
    return spark.sql(MEMBERS.replace("FROM lineitem", "FROM {lines}"), lines=lines).select("capture_id", "plane_no", "point_id", "x", "y", "z")


def walls(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible pieces merged, described again as whole walls and put in order."""
    cfg, keys = GeometryConfig(), ["capture_id"]
    points = cut(members(spark, sf))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("points"))
    eligible, _ = planes.select_walls(cut(planes.descriptors(points, planes.fit_planes(points, [*keys, "plane_no"]), sizes, keys, cfg)), keys, cfg)
    merged, sets = planes.merge_walls(eligible, points, keys, cfg)
    described = planes.descriptors(sets, merged, sizes, keys, cfg)
    ids = sets.groupBy(*keys, "plane_no").agg(F.sum(F.col("point_id") % 1000003).alias("id_sum"))
    return cut(planes.wall_segments(described.join(ids, [*keys, "plane_no"]), keys))


@query("wall_merges", f"""WITH {_MERGED} SELECT capture_id, plane_no, n, id_sum, round(t1 - t0, 6) AS length, round(height, 6) AS height FROM wall""")
def wall_merges(spark: SparkSession, sf: str) -> DataFrame:
    return walls(spark, sf).select("capture_id", "plane_no", "n", "id_sum", F.round("length", 6).alias("length"), F.round("height_coverage", 6).alias("height"))


@query("wall_crossings", f"""WITH {_CROSSED} SELECT capture_id, a_wall_no::INTEGER AS a_wall_no, b_wall_no::INTEGER AS b_wall_no, round(x, 6) AS x, round(y, 6) AS y FROM hit""")
def wall_crossings(spark: SparkSession, sf: str) -> DataFrame:
    hits = planes.wall_crossings(walls(spark, sf), ["capture_id"])
    return hits.select("capture_id", "a_wall_no", "b_wall_no", *[(F.round(c, 6) + 0.0).alias(c) for c in "xy"])


@query("room_polygons", f"""WITH {_CROSSED},
 ends AS (SELECT capture_id, wall_no, count(*) AS n FROM (SELECT capture_id, unnest([a_wall_no, b_wall_no]) AS wall_no FROM hit) u GROUP BY 1, 2),
 room AS (SELECT capture_id, count(*) AS walls, min(w) AS w, min(d) AS d, min(bend) AS bend FROM seg GROUP BY 1),
 found AS (SELECT capture_id, count(*) AS corners, max(greatest(ga, gb)) AS gap FROM hit GROUP BY 1),
 even AS (SELECT capture_id, count(*) AS n FROM ends WHERE n = 2 GROUP BY 1)
 SELECT room.capture_id, coalesce(corners, 0)::INTEGER AS corners, CASE WHEN ok THEN walls END::INTEGER AS vertices, CASE WHEN ok THEN CASE WHEN bend = 0 THEN w * d ELSE 2 * w + (w - 2) * (d - 2) END END AS area,
 CASE WHEN ok THEN 2 * (w + d) END AS perimeter, CASE WHEN ok THEN round(gap, 6) END AS closure_error
 FROM (SELECT room.*, corners, gap, coalesce(even.n = walls AND corners = walls, false) AS ok FROM room LEFT JOIN found USING (capture_id) LEFT JOIN even USING (capture_id)) room""")
def room_polygons(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["capture_id"]
    segments = walls(spark, sf)
    rooms = cut(planes.close_polygons(segments, planes.wall_crossings(segments, keys), keys))
    sides = polygons.edges(rooms.filter("ring IS NOT NULL"), keys, "ring").groupBy(*keys).agg(
        F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6).alias("perimeter"))
    return rooms.join(sides, keys, "left").select(*keys, "corners", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("vertices"),
                                                  F.round("area", 6).alias("area"), "perimeter", F.round("closure_error", 6).alias("closure_error"))
