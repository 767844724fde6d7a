"""Queries over floor-plan data: supplier walls with line-item openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.operators import floorplan as ops
from roomfold.plans import openings as O
from roomfold.plans.registry import query
from roomfold.plans.stitching import RECTS, rect_rooms
from roomfold.plans.tables import table

W = O.W
OPENING = """(SELECT l_suppkey // 4 AS room_id, l_orderkey * 100 + l_linenumber AS opening_id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS wall_id, CASE WHEN l_returnflag <> 'R' THEN 0.1 + l_discount ELSE 0.3 END AS width,
 CASE WHEN l_linestatus = 'F' OR l_tax > 0.01 THEN l_quantity / 10 END AS position, l_suppkey, l_linenumber FROM lineitem)"""


def walls(spark: SparkSession, sf: str) -> DataFrame:
    return O.spark_walls(spark, sf)


def doors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("l_suppkey div 4").alias("room_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("opening_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("wall_id"),
        F.when(F.col("l_returnflag") != "R", 0.1 + F.col("l_discount")).otherwise(0.3).alias("width"),
        F.when((F.col("l_linestatus") == "F") | (F.col("l_tax") > 0.01), F.col("l_quantity") / 10).alias("position"), "l_suppkey", "l_linenumber")


LOCATED = f"(SELECT o.*, w.x0, w.y0, w.x1, w.y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {OPENING} o LEFT JOIN {W} w ON w.wall_id = o.wall_id)"


@query("opening_positions", f"""SELECT opening_id, round(x0 + (x1 - x0) / len * position, 6) AS ax, round(y0 + (y1 - y0) / len * position, 6) AS ay, round(x0 + (x1 - x0) / len * (position + width), 6) AS bx
 FROM {LOCATED} t WHERE wall_id IS NOT NULL AND position IS NOT NULL AND position + width <= len + 1e-8""")
def opening_positions(spark: SparkSession, sf: str) -> DataFrame:
    placed, _, _ = ops.locate_openings(doors(spark, sf), walls(spark, sf), ["room_id"])
    return placed.select("opening_id", *[F.round(c, 6).alias(c) for c in ("ax", "ay", "bx")])


@query("opening_position_warnings", f"""SELECT opening_id, CASE WHEN wall_id IS NULL OR position IS NULL THEN 'OPENING_NOT_POSITIONED' ELSE 'OPENING_BEYOND_WALL' END AS code FROM {LOCATED} t
 WHERE wall_id IS NULL OR position IS NULL OR position + width > len + 1e-8""")
def opening_position_warnings(spark: SparkSession, sf: str) -> DataFrame:
    _, warnings, errors = ops.locate_openings(doors(spark, sf), walls(spark, sf), ["room_id"])
    return warnings.unionByName(errors).select("opening_id", "code")


# Openings by supplier item; positions repeat, so each is identified by its own place on the wall.
PLACE = """(SELECT DISTINCT l_suppkey // 4 AS room_id, l_suppkey AS wall_id, l_quantity / 10 AS position, 0.1 + l_discount AS width, l_suppkey * 10000 + (l_quantity * 100)::BIGINT + round(l_discount * 100)::BIGINT AS opening_id FROM lineitem)"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("l_suppkey div 4").alias("room_id"), F.col("l_suppkey").alias("wall_id"), (F.col("l_quantity") / 10).alias("position"), (0.1 + F.col("l_discount")).alias("width"),
        (F.col("l_suppkey") * 10000 + (F.col("l_quantity") * 100).cast("long") + F.round(F.col("l_discount") * 100).cast("long")).alias("opening_id")).distinct()


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows, hosts = places(spark, sf), walls(spark, sf)
    placed, _, _ = ops.locate_openings(rows, hosts, ["room_id"])
    # Every third opening is listed by the next wall too; all walls of the room may coincide with it.
    links = rows.filter("opening_id % 3 = 0").select("room_id", "opening_id", (F.col("wall_id") + 1).alias("wall_id"))
    return _gaps(placed, links, hosts)


def _gaps(placed: DataFrame, links: DataFrame, hosts: DataFrame) -> DataFrame:
    prop = lambda df: df.withColumn("property_id", F.col("room_id"))
    rooms = prop(placed).select("property_id", "opening_id", "room_id")
    return ops.wall_gaps(prop(placed), rooms, prop(links), prop(hosts), ["property_id"])


GAPS = f"""(SELECT DISTINCT p.room_id AS property_id, w.wall_id, p.opening_id, greatest(0, least(a, b)) AS lo, least(w.len, greatest(a, b)) AS hi, w.len AS length FROM
 (SELECT p.*, h.x0 + (h.x1 - h.x0) / h.len * position AS ax, h.y0 + (h.y1 - h.y0) / h.len * position AS ay, h.x0 + (h.x1 - h.x0) / h.len * (position + width) AS bx, h.y0 + (h.y1 - h.y0) / h.len * (position + width) AS by_
  FROM {PLACE} p JOIN (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {W} w) h ON h.wall_id = p.wall_id WHERE position + width <= h.len + 1e-8) p
 JOIN (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {W} w) w ON w.room_id = p.room_id,
 LATERAL (SELECT (ax - w.x0) * (w.x1 - w.x0) / w.len + (ay - w.y0) * (w.y1 - w.y0) / w.len AS a, (bx - w.x0) * (w.x1 - w.x0) / w.len + (by_ - w.y0) * (w.y1 - w.y0) / w.len AS b,
  abs((ay - w.y0) * (w.x1 - w.x0) - (ax - w.x0) * (w.y1 - w.y0)) / w.len AS da, abs((by_ - w.y0) * (w.x1 - w.x0) - (bx - w.x0) * (w.y1 - w.y0)) / w.len AS db) q
 WHERE greatest(da, db) <= 0.02 AND least(a, b) >= -0.02 AND greatest(a, b) <= w.len + 0.02)"""


@query("wall_gaps", f"SELECT property_id, wall_id, opening_id, round(lo, 6) + 0.0::DOUBLE AS lo, round(hi, 6) AS hi FROM {GAPS} g")
def wall_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(spark, sf).select("property_id", "wall_id", "opening_id", (F.round("lo", 6) + 0.0).alias("lo"), F.round("hi", 6).alias("hi"))


@query("gap_overlaps", f"""SELECT wall_id, opening_id FROM (SELECT *, lag(hi) OVER (PARTITION BY wall_id ORDER BY lo, hi) AS p FROM (SELECT wall_id, opening_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM {GAPS} g) r) t WHERE lo < p - 1e-8""")
def gap_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    tidy = gaps(spark, sf).withColumn("lo", F.round("lo", 6)).withColumn("hi", F.round("hi", 6))
    return ops.gap_overlaps(tidy, ["property_id"]).select("wall_id", "opening_id")


# Sparse gaps: one per wall and discount step, all disjoint.
SPARSE = f"""(SELECT DISTINCT l_suppkey AS wall_id, round(l_discount * 100) * 0.4::DOUBLE AS lo, round(l_discount * 100) * 0.4::DOUBLE + 0.1::DOUBLE + l_linenumber % 2 * 0.05::DOUBLE AS hi FROM lineitem WHERE l_linenumber % 2 = round(l_discount * 100) % 2)"""


@query("solid_wall_runs", f"""SELECT wall_id, round(start, 6) AS start, round(lo, 6) AS "end" FROM (SELECT wall_id, lo, coalesce(lag(hi) OVER (PARTITION BY wall_id ORDER BY lo, hi), 0) AS start FROM
 (SELECT * FROM {SPARSE} s UNION ALL SELECT wall_id, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE FROM {W} w) u) t WHERE lo > start""")
def solid_wall_runs(spark: SparkSession, sf: str) -> DataFrame:
    step = F.round(F.col("l_discount") * 100)
    sparse = table(spark, sf, "lineitem").filter((F.col("l_linenumber") % 2) == step % 2).select(
        F.col("l_suppkey").alias("wall_id"), (step * 0.4).alias("lo"), (step * 0.4 + 0.1 + F.col("l_linenumber") % 2 * 0.05).alias("hi"))
    runs = ops.solid_runs(walls(spark, sf), sparse, [])
    return runs.select("wall_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("unique_dimensions", f"""SELECT room_id // 2 AS property_id, min(wall_id) AS wall_id FROM (SELECT *, CASE WHEN (x0, y0) <= (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS seg FROM {W} w) t GROUP BY 1, seg""")
def unique_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    rows = walls(spark, sf).withColumn("property_id", F.expr("room_id div 2"))
    return ops.unique_dimensions(rows, ["property_id"]).select("property_id", "wall_id")


@query("scene_extents", f"""SELECT property_id, round(min(x), 6) AS origin_x, round(max(x + w) - min(x), 6) AS width, round(max(y + h) - min(y), 6) AS height, round((SELECT max(s * 10.0 ^ floor(log10(t))) FROM
 (VALUES (0.1), (0.2), (0.5), (1), (2), (5)) v(s) WHERE s * 10.0 ^ floor(log10(t)) <= t), 6) AS scale_bar FROM (SELECT *, (max(x + w) OVER (PARTITION BY property_id) - min(x) OVER (PARTITION BY property_id)) / 3 AS t FROM {RECTS} r) q GROUP BY property_id, t""")
def scene_extents(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.scene_extent(rect_rooms(spark, sf), ["property_id"])
    return out.select("property_id", *[F.round(c, 6).alias(c) for c in ("origin_x", "width", "height", "scale_bar")])


@query("room_labels", f"""SELECT room_id, round(x + w / 2, 4) AS x, 'Room ' || (room_id % 5 + 1) || chr(10) || printf('%.2f m²', w * h + 0.0013) || chr(10) || CASE WHEN room_id % 3 = 0 THEN 'Ceiling: unavailable' ELSE 'Ceiling: 2.40 m' END AS text FROM {RECTS} r""")
def room_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = rect_rooms(spark, sf).withColumn("area", F.col("area") + 0.0013).select("*", F.lit(None).cast("string").alias("name"), (F.col("room_id") % 5 + 1).alias("room_no"), F.when(F.col("room_id") % 3 != 0, 2.4).alias("ceiling"))
    return ops.room_labels(rows, ["property_id"]).select("room_id", F.round("x", 4).alias("x"), "text")


@query("damage_markers", f"""SELECT l_suppkey // 4 AS property_id, l_orderkey AS damage_id, round(CASE WHEN w.wall_id IS NULL THEN l_quantity / 20 ELSE x0 + (x1 - x0) / sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) * l_quantity / 20 END - 0.5, 6) AS x,
 round(CASE WHEN w.wall_id IS NULL THEN l_tax ELSE y0 + (y1 - y0) / sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) * l_quantity / 20 END - 0.25, 6) AS y FROM lineitem LEFT JOIN {W} w ON w.wall_id = l_suppkey AND l_returnflag <> 'N'""")
def damage_markers(spark: SparkSession, sf: str) -> DataFrame:
    prop = F.expr("l_suppkey div 4").alias("property_id")
    rows = table(spark, sf, "lineitem").select(prop, F.col("l_orderkey").alias("damage_id"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("surface_id"),
                                               F.lit(0.0).alias("min_x"), (F.col("l_quantity") / 10).alias("max_x"), F.lit(0.0).alias("min_y"), (F.col("l_tax") * 2).alias("max_y"))
    hosts = walls(spark, sf).withColumnRenamed("room_id", "property_id")
    scene = hosts.select("property_id").distinct().select("property_id", F.lit(0.5).alias("origin_x"), F.lit(0.25).alias("origin_y"))
    out = ops.damage_markers(rows, hosts, scene, ["property_id"])
    return out.select("property_id", "damage_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("plan_faults", f"""WITH w AS (SELECT room_id, count(*) AS n FROM {W} w WHERE wall_id % 7 <> 3 GROUP BY 1), r AS (SELECT DISTINCT room_id FROM {W} w)
 SELECT room_id, 'room_without_polygon' AS fault FROM r WHERE room_id % 5 = 4 UNION ALL SELECT room_id, 'room_without_walls' FROM r WHERE room_id NOT IN (SELECT room_id FROM w)
 UNION ALL SELECT room_id, 'boundary_uncovered' FROM r JOIN w USING (room_id) WHERE room_id % 5 <> 4 AND (n < 4 OR room_id % 5 = 2)
 UNION ALL SELECT room_id, 'wall_off_polygon' FROM r JOIN w USING (room_id) WHERE room_id % 5 = 4
 UNION ALL SELECT DISTINCT room_id, 'wall_off_polygon' FROM {W} w WHERE wall_id % 7 <> 3 AND wall_order = 2 AND room_id % 5 = 2""")
def plan_faults(spark: SparkSession, sf: str) -> DataFrame:
    base = walls(spark, sf)
    rows = base.filter("wall_id % 7 <> 3")
    # In every fifth room the third wall leaves the polygon by ten centimetres.
    shifted = rows.withColumn("y0", F.when((F.col("wall_order") == 2) & (F.col("room_id") % 5 == 2), 4.1).otherwise(F.col("y0"))) \
        .withColumn("y1", F.when((F.col("wall_order") == 2) & (F.col("room_id") % 5 == 2), 4.1).otherwise(F.col("y1")))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(point(0.0, 0.0), point(5.0, 0.0), point(5.0, 4.0), point(0.0, 4.0))
    rooms = base.select("room_id").distinct().withColumn("ring", F.when(F.col("room_id") % 5 != 4, ring))
    return ops.plan_faults(rooms, shifted, []).select("room_id", "fault")


@query("plan_primitives")
def plan_primitives(spark: SparkSession, sf: str) -> DataFrame:
    hosts = walls(spark, sf).withColumn("property_id", F.col("room_id"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(point(0.0, 0.0), point(5.0, 0.0), point(5.0, 4.0), point(0.0, 4.0))
    rooms = hosts.select("property_id", "room_id").distinct().select(
        "property_id", "room_id", ring.alias("ring"), F.lit(20.0).alias("area"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("room_no"), F.lit(2.6).alias("ceiling"))
    scene = ops.scene_extent(rooms, ["property_id"])
    out = ops.plan_primitives(hosts, rooms, gaps(spark, sf), scene, ["property_id"])
    return out.select("property_id", "kind", "entity_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "text")
