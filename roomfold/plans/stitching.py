"""Queries over room graphs derived from orders: one property per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import StitchConfig
from roomfold.functions import rigid
from roomfold.operators import footprint, graph, polygons, stitching
from roomfold.plans import projections as P
from roomfold.plans.registry import query
from roomfold.session import grown

EDGES = P.source("orders", P.EDGES)
ROOMS = f"(SELECT DISTINCT property_id, room_id FROM (SELECT property_id, unnest([room_a, room_b]) AS room_id FROM {EDGES} e) t WHERE room_id <> 'm02')"


def room_ring(width, height):
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.cast("double").alias("x"),
                                  F.lit(y).cast("double").alias("y") if not hasattr(y, "alias") else y.cast("double").alias("y"))
    return F.array(point(0.0, 0.0), point(width, 0.0), point(width, height), point(0.0, height))


def rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms of every property: 4 x 3 metres for priorities, 3 x 3 for months."""
    found = P.edges(spark, sf).select("property_id", F.explode(F.array("room_a", "room_b")).alias("room_id")).distinct() \
        .filter("room_id <> 'm02'")
    wide = F.when(F.col("room_id").startswith("p"), 4.0).otherwise(3.0)
    return found.withColumn("ring", room_ring(wide, F.lit(3.0))).withColumn("area", wide * 3.0)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    transform = rigid.se2(F.col("dx"), F.col("dy"), F.col("quarter") * F.lit(1.5707963267948966))
    return P.edges(spark, sf).select(
        "property_id", "connection_id", "room_a", "room_b", "score", F.col("connection_id").alias("ordinal"),
        F.when(F.col("connection_id") % 11 != 0, transform).alias("relative_transform"), F.lit(True).alias("accepted"),
        F.when(F.col("connection_id") % 13 == 0, "kept_reason").alias("rejection_reason"))


REASON = """CASE WHEN room_a = 'm02' OR room_b = 'm02' THEN 'unknown_room'
 WHEN connection_id % 11 = 0 THEN CASE WHEN connection_id % 13 = 0 THEN 'kept_reason' ELSE 'relative_transform_unavailable' END
 WHEN score < 0.35 THEN CASE WHEN connection_id % 13 = 0 THEN 'kept_reason' ELSE 'below_acceptance_threshold' END END"""


@query("evidence_screening", f"""SELECT property_id, connection_id, r IS NULL AS accepted, r AS rejection_reason FROM (SELECT *, {REASON} AS r FROM {EDGES} e) t""")
def evidence_screening(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.screen_evidence(evidence(spark, sf), rooms(spark, sf))
    return out.select("property_id", "connection_id", "accepted", "rejection_reason")


@query("room_pairs", f"""SELECT a.property_id, a.room_id AS room_a, b.room_id AS room_b FROM {ROOMS} a JOIN {ROOMS} b ON a.property_id = b.property_id AND a.room_id < b.room_id""")
def room_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.room_pairs(rooms(spark, sf))


@query("best_pair_evidence", f"""WITH p AS (SELECT a.property_id, a.room_id AS room_a, b.room_id AS room_b FROM {ROOMS} a JOIN {ROOMS} b ON a.property_id = b.property_id AND a.room_id < b.room_id),
 e AS (SELECT property_id, least(room_a, room_b) AS room_a, greatest(room_a, room_b) AS room_b, connection_id, score, row_number() OVER
 (PARTITION BY property_id, room_a, room_b ORDER BY score DESC, connection_id) AS n FROM {EDGES} e)
 SELECT p.property_id, p.room_a, p.room_b, e.connection_id, coalesce(round(score + 1e-9, 6), 0) AS score,
 CASE WHEN score IS NULL THEN 'NO_CROSS_ROOM_MATCHES' END AS rejection_reason FROM p LEFT JOIN e ON e.property_id = p.property_id
 AND e.room_a = p.room_a AND e.room_b = p.room_b AND e.n = 1""")
def best_pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.edges(spark, sf).select("property_id", F.least("room_a", "room_b").alias("room_a"),
                                     F.greatest("room_a", "room_b").alias("room_b"), "connection_id", "score",
                                     F.col("connection_id").alias("ordinal"), F.lit(True).alias("accepted"),
                                     F.lit(None).cast("string").alias("rejection_reason"))
    out = graph.best_evidence(rows, graph.room_pairs(rooms(spark, sf)))
    return out.select("property_id", "room_a", "room_b", "connection_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "rejection_reason")


ACCEPTED = f"(SELECT * FROM {EDGES} e WHERE ({REASON}) IS NULL)"
REACH = f"""reach(property_id, room_id, other) AS (SELECT property_id, room_id, room_id FROM {ROOMS} r
 UNION SELECT reach.property_id, reach.room_id, CASE WHEN e.room_a = reach.other THEN e.room_b ELSE e.room_a END FROM reach JOIN {ACCEPTED} e
 ON e.property_id = reach.property_id AND (e.room_a = reach.other OR e.room_b = reach.other))"""


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return graph.screen_evidence(evidence(spark, sf), rooms(spark, sf)).filter("accepted")


@query("room_components", f"""WITH RECURSIVE {REACH}, c AS (SELECT property_id, room_id, min(other) AS component FROM reach GROUP BY 1, 2)
 SELECT property_id, component, count(*) AS size, row_number() OVER (PARTITION BY property_id ORDER BY count(*) DESC, component) AS component_no FROM c GROUP BY 1, 2""")
def room_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_list(graph.components(rooms(spark, sf), accepted(spark, sf)))


ROOT = f"""root AS (SELECT property_id, room_id AS root FROM (SELECT r.property_id, r.room_id, row_number() OVER (PARTITION BY r.property_id ORDER BY count(e.score) DESC,
 coalesce(sum(e.score), 0) DESC, CASE WHEN r.room_id LIKE 'p%' THEN 12 ELSE 9 END DESC, r.room_id) AS n FROM {ROOMS} r LEFT JOIN {ACCEPTED} e
 ON e.property_id = r.property_id AND (e.room_a = r.room_id OR e.room_b = r.room_id) GROUP BY 1, 2) t WHERE n = 1)"""


@query("layout_root", f"WITH {ROOT} SELECT * FROM root")
def layout_root(spark: SparkSession, sf: str) -> DataFrame:
    return graph.choose_root(rooms(spark, sf), accepted(spark, sf))


# An edge is in the maximum spanning forest when no path of strictly better edges joins its ends.
TREE = f"""better(id, property_id, score, target, cur) AS (SELECT connection_id, property_id, score, room_b, room_a FROM {ACCEPTED} e
 UNION SELECT b.id, b.property_id, b.score, b.target, CASE WHEN e.room_a = b.cur THEN e.room_b ELSE e.room_a END FROM better b JOIN {ACCEPTED} e
 ON e.property_id = b.property_id AND (e.room_a = b.cur OR e.room_b = b.cur) AND (e.score > b.score OR (e.score = b.score AND e.connection_id < b.id))),
 tree AS (SELECT * FROM {ACCEPTED} e WHERE connection_id NOT IN (SELECT id FROM better WHERE cur = target))"""


@query("spanning_tree", f"WITH RECURSIVE {TREE} SELECT property_id, connection_id, room_a, room_b FROM tree")
def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.spanning_edges(accepted(spark, sf)).select("property_id", "connection_id", "room_a", "room_b")


# Quarter turns keep cosine and sine whole, so poses are (x, y, q).
LAYOUT = f"""steps AS (SELECT property_id, room_a AS cur, room_b AS dest, dx, dy, quarter AS q FROM tree UNION ALL
 SELECT property_id, room_b, room_a, -([1, 0, -1, 0][quarter + 1] * dx + [0, 1, 0, -1][quarter + 1] * dy),
  -([0, -1, 0, 1][quarter + 1] * dx + [1, 0, -1, 0][quarter + 1] * dy), (4 - quarter) % 4 FROM tree),
 pose(property_id, room_id, parent, x, y, q) AS (SELECT property_id, root, NULL::VARCHAR, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM root
 UNION ALL SELECT p.property_id, s.dest, p.room_id, p.x + [1, 0, -1, 0][p.q + 1] * s.dx - [0, 1, 0, -1][p.q + 1] * s.dy,
  p.y + [0, 1, 0, -1][p.q + 1] * s.dx + [1, 0, -1, 0][p.q + 1] * s.dy, (p.q + s.q) % 4
 FROM pose p JOIN steps s ON s.property_id = p.property_id AND s.cur = p.room_id AND s.dest IS DISTINCT FROM p.parent)"""


@query("room_layout", f"WITH RECURSIVE {TREE}, {ROOT}, {LAYOUT} SELECT property_id, room_id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, [1, 0, -1, 0][q + 1]::DOUBLE AS c FROM pose")
def room_layout(spark: SparkSession, sf: str) -> DataFrame:
    edges = accepted(spark, sf)
    poses = graph.layout(graph.choose_root(rooms(spark, sf), edges), graph.spanning_edges(edges))
    tidy = lambda i: F.round(F.col("pose")[i], 6) + 0.0
    return poses.select("property_id", "room_id", tidy(2).alias("x"), tidy(5).alias("y"), tidy(0).alias("c"))


@query("cycle_check", f"""WITH RECURSIVE {TREE}, {ROOT}, {LAYOUT}, d AS (SELECT e.*, [1, 0, -1, 0][a.q + 1] * (b.x - a.x) + [0, 1, 0, -1][a.q + 1] * (b.y - a.y) - e.dx AS ex,
 [0, -1, 0, 1][a.q + 1] * (b.x - a.x) + [1, 0, -1, 0][a.q + 1] * (b.y - a.y) - e.dy AS ey, (b.q - a.q - e.quarter + 8) % 4 AS eq
 FROM {ACCEPTED} e JOIN pose a ON a.property_id = e.property_id AND a.room_id = e.room_a JOIN pose b ON b.property_id = e.property_id AND b.room_id = e.room_b)
 SELECT connection_id, connection_id IN (SELECT connection_id FROM tree) AS in_tree, round(r, 6) + 0 AS residual,
 connection_id IN (SELECT connection_id FROM tree) OR r <= 0.35 AS retained FROM (SELECT *, sqrt(ex * ex + ey * ey + (least(eq, 4 - eq) * pi() / 2) ^ 2) AS r FROM d) t""")
def cycle_check(spark: SparkSession, sf: str) -> DataFrame:
    edges = grown(accepted(spark, sf))
    tree = grown(graph.spanning_edges(edges))
    poses = graph.layout(graph.choose_root(rooms(spark, sf), edges), tree)
    out = graph.check_cycles(edges, tree, poses, 0.35)
    return out.select("connection_id", "in_tree", (F.round("residual", 6) + 0.0).alias("residual"), "retained")


# One placed room per order: its transform turns and shifts the ring and the first wall.
@query("room_placement", f"""SELECT connection_id, round(CASE quarter WHEN 0 THEN dx + 4 WHEN 1 THEN dx WHEN 2 THEN dx - 4 ELSE dx END, 6) + 0 AS x1,
 round(CASE quarter WHEN 0 THEN dy WHEN 1 THEN dy + 4 WHEN 2 THEN dy ELSE dy - 4 END, 6) + 0 AS y1, round((300 + quarter * 90) % 360, 4)::DOUBLE AS orientation,
 round(12.0, 6)::DOUBLE AS area FROM {EDGES} e""")
def room_placement(spark: SparkSession, sf: str) -> DataFrame:
    base = P.edges(spark, sf).select(
        F.col("connection_id").alias("property_id"), F.col("room_a").alias("room_id"), room_ring(F.lit(4.0), F.lit(3.0)).alias("ring"),
        rigid.se2(F.col("dx"), F.col("dy"), F.col("quarter") * F.lit(1.5707963267948966)).alias("pose"))
    walls = base.select("property_id", "room_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(4.0).alias("x1"),
                        F.lit(0.0).alias("y1"), F.lit(300.0).alias("orientation"))
    placed = stitching.place_walls(walls, base)
    rings = stitching.place_rooms(base.drop("pose"), base).select(
        "property_id", F.round(polygons.area(F.col("ring")), 6).alias("area"))
    return placed.join(rings, "property_id").select(
        F.col("property_id").alias("connection_id"), (F.round("x1", 6) + 0.0).alias("x1"), (F.round("y1", 6) + 0.0).alias("y1"),
        F.round("orientation", 4).alias("orientation"), "area")


def l_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """An L-shaped room per order, cut corner from the score."""
    cut_x, cut_y = 1 + F.col("score"), 1 + F.col("quarter") * 0.25
    point = lambda x, y: F.struct((x + F.col("dx")).alias("x"), (y + F.col("dy")).alias("y"))
    zero, w, h = F.lit(0.0), F.lit(4.0), F.lit(3.0)
    ring = F.array(point(zero, zero), point(w, zero), point(w, cut_y), point(cut_x, cut_y), point(cut_x, h), point(zero, h))
    return P.edges(spark, sf).select("property_id", F.col("connection_id").alias("room_id"), "dx", "dy", "score", "quarter",
                                     ring.alias("ring"))


@query("polygon_measures", f"""SELECT connection_id AS room_id, round(a + 1e-9, 6) AS area, round(1e-9 + dx + (cx * 3 * cx / 2 + (4 - cx) * cy * (cx + 4) / 2) / a, 6) AS centroid_x,
 round(dx, 6) AS min_x, round(dy + 3, 6) AS max_y FROM (SELECT *, 1 + score AS cx, 1 + quarter * 0.25 AS cy, (1 + score) * 3 + (3 - score) * (1 + quarter * 0.25) AS a FROM {EDGES} e) t""")
def polygon_measures(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.col("ring")
    box = polygons.bounds(ring)
    cx, _ = polygons.centroid(ring)
    return l_rooms(spark, sf).select("room_id", F.round(polygons.area(ring) + 1e-9, 6).alias("area"), F.round(cx + 1e-9, 6).alias("centroid_x"),
                                     F.round(box["min_x"], 6).alias("min_x"), F.round(box["max_y"], 6).alias("max_y"))


@query("polygon_edges", f"""SELECT connection_id AS room_id, sum(CASE n WHEN 0 THEN 4 WHEN 1 THEN cy WHEN 2 THEN 4 - cx WHEN 3 THEN 3 - cy WHEN 4 THEN cx ELSE 3 END)::DOUBLE AS dummy, 6 AS edges FROM
 (SELECT *, 1 + score AS cx, 1 + quarter * 0.25 AS cy FROM {EDGES} e) t, range(6) r(n) GROUP BY 1""".replace("sum(", "round(sum(").replace("::DOUBLE AS dummy", ", 6)::DOUBLE AS perimeter"))
def polygon_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = polygons.edges(l_rooms(spark, sf), ["room_id"], "ring")
    return rows.groupBy("room_id").agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6).alias("perimeter"),
                                       F.count("*").cast("int").alias("edges"))


def rect_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """An axis-aligned room per order, 1 x 1 metres up to 1.75 x 1.8, on a spread grid."""
    x, y = F.col("dx") * 2 + F.col("connection_id") % 10 * 0.35, F.col("dy") * 2
    w, h = 1 + F.col("quarter") * 0.25, 1 + F.col("connection_id") % 9 * 0.1
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return P.edges(spark, sf).select("property_id", F.col("connection_id").alias("room_id"),
                                     F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)).alias("ring"),
                                     (w * h).alias("area"))


RECTS = f"""(SELECT property_id, connection_id AS room_id, dx * 2 + connection_id % 10 * 0.35::DOUBLE AS x, dy * 2 AS y, 1 + quarter * 0.25::DOUBLE AS w,
 1 + connection_id % 9 * 0.1::DOUBLE AS h FROM {EDGES} e)"""


@query("room_overlaps", f"""SELECT property_id, room_id, b_room_id, round(o, 6) AS overlap_area, o > 0.08 AND o / least(a1, a2) > 0.02 AS material FROM (
 SELECT a.property_id, a.room_id, b.room_id AS b_room_id, a.w * a.h AS a1, b.w * b.h AS a2,
 (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o FROM {RECTS} a JOIN {RECTS} b
 ON a.property_id = b.property_id AND a.room_id < b.room_id AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 1e-9
 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 1e-9) t""")
def room_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    out = stitching.overlaps(rect_rooms(spark, sf)).filter("overlap_area > 1e-9")
    return out.select("property_id", "room_id", "b_room_id", F.round("overlap_area", 6).alias("overlap_area"), "material")


@query("property_totals", f"""SELECT property_id, count(*) AS rooms, count(*) FILTER (WHERE room_id % 4 <> 0) AS placed,
 round(sum(w * h) FILTER (WHERE room_id % 4 <> 0), 6) AS total_area, round(max(x + w) FILTER (WHERE room_id % 4 <> 0) - min(x) FILTER (WHERE room_id % 4 <> 0), 6) AS length,
 round(max(y + h) FILTER (WHERE room_id % 4 <> 0) - min(y) FILTER (WHERE room_id % 4 <> 0), 6) AS width, count(*) FILTER (WHERE room_id % 4 = 0) AS unplaced FROM {RECTS} r GROUP BY 1""")
def property_totals(spark: SparkSession, sf: str) -> DataFrame:
    all_rooms = rect_rooms(spark, sf)
    out = stitching.property_totals(all_rooms, all_rooms.filter("room_id % 4 <> 0"))
    return out.select("property_id", "rooms", F.coalesce("placed", F.lit(0)).alias("placed"), *[F.round(c, 6).alias(c) for c in ("total_area", "length", "width")],
                      "unplaced")


@query("boundary_distances", f"""SELECT a.room_id AS connection_id, round(CASE WHEN a.w < 10 THEN greatest(0, greatest(b.x - a.x - a.w, a.x - b.x - b.w)) END, 6) AS gap FROM {RECTS} a
 JOIN (SELECT room_id, x + w + 0.2 + h / 10 AS x, y, w, h FROM {RECTS} r) b USING (room_id)""")
def boundary_distances(spark: SparkSession, sf: str) -> DataFrame:
    first = rect_rooms(spark, sf).select(F.col("room_id").alias("property_id"), F.lit("a").alias("room_id"), "ring")
    height = 1 + F.col("property_id") % 9 * 0.1
    width = F.col("ring")[1]["x"] - F.col("ring")[0]["x"]
    second = first.select("property_id", F.lit("b").alias("room_id"), F.transform("ring", lambda p: F.struct(
        (p["x"] + width + 0.2 + height / 10).alias("x"), p["y"].alias("y"))).alias("ring"))
    links = first.select("property_id", F.col("property_id").alias("connection_id"), F.lit("a").alias("room_a"), F.lit("b").alias("room_b"))
    return stitching.boundary_distances(links, first.unionByName(second)).select(
        "connection_id", F.round("boundary_distance", 6).alias("gap"))


FACTS = """(SELECT o_custkey AS property_id, count(*) % 3 AS unplaced, count(*) % 2 AS cycle_rejected, max(o_totalprice) / 1000000 AS cycle_error, count(*) FILTER (WHERE o_orderstatus = 'F') % 2 AS material_overlaps,
 1 + count(*) % 2 AS footprint_parts, min(o_totalprice) / 100000 AS max_boundary_distance, sum(o_totalprice) AS total_area FROM orders GROUP BY 1)"""


@query("layout_verdicts", f"""SELECT property_id, unplaced = 0 AND material_overlaps = 0 AS valid_layout, list_filter([CASE WHEN max_boundary_distance > 0.35 THEN 'WEAK_ROOM_CONNECTION' END,
 CASE WHEN unplaced > 0 THEN 'DISCONNECTED_ROOM_GRAPH' END, CASE WHEN cycle_rejected > 0 THEN 'AMBIGUOUS_ROOM_CONNECTION' END,
 CASE WHEN material_overlaps > 0 THEN 'EXCESSIVE_ROOM_OVERLAP' END, CASE WHEN material_overlaps > 0 THEN 'PROPERTY_LAYOUT_CONFLICT' END,
 CASE WHEN footprint_parts > 1 THEN 'PROPERTY_FOOTPRINT_DISCONNECTED' END, CASE WHEN cycle_error > 0.35 THEN 'HIGH_CYCLE_CLOSURE_ERROR' END], lambda x: x IS NOT NULL) AS codes FROM {FACTS} f""")
def layout_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return stitching.verdicts(facts(spark, sf)).select("property_id", "valid_layout", "codes")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.plans.tables import table
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("property_id")).agg(
        (F.count("*") % 3).alias("unplaced"), (F.count("*") % 2).alias("cycle_rejected"),
        (F.max("o_totalprice") / 1000000).alias("cycle_error"), (F.count_if(F.col("o_orderstatus") == "F") % 2).alias("material_overlaps"),
        (1 + F.count("*") % 2).alias("footprint_parts"), (F.min("o_totalprice") / 100000).alias("max_boundary_distance"),
        F.sum("o_totalprice").alias("total_area"))


@query("layout_fallback", f"""SELECT property_id, round(CASE WHEN unplaced = 0 AND material_overlaps = 0 THEN total_area ELSE total_area / 3 END, 2) AS total_floor_area,
 CASE WHEN unplaced = 0 AND material_overlaps = 0 THEN 'property_shared' ELSE 'room_local_unstitched' END AS coordinate_scope FROM {FACTS} f""")
def layout_fallback(spark: SparkSession, sf: str) -> DataFrame:
    verdict = stitching.verdicts(facts(spark, sf))
    local = facts(spark, sf).select("property_id", (F.col("total_area") / 3).alias("local_area"))
    return stitching.adopt_layout(verdict, local).select(
        "property_id", F.round("total_floor_area", 2).alias("total_floor_area"), "coordinate_scope")


# Rooms on whole metres, one per order, so that the twin can count the squares they cover.
PLOTS = """SELECT o_custkey AS property_id, o_orderkey AS room_id, o_orderkey % 9 AS x, floor(o_totalprice)::BIGINT % 7 AS y, 1 + o_orderkey % 3 AS w, 1 + o_orderkey % 4 AS d FROM orders"""


@query("property_footprints", f"""WITH c AS (SELECT DISTINCT property_id, i, j FROM (SELECT property_id, unnest(range(x, x + w)) AS i, y, d FROM ({PLOTS}) p) q, unnest(range(y, y + d)) t(j)),
 v AS (SELECT property_id, i + a AS i, j + b AS j, count(*) AS n, sum((2 * a - 1) * (2 * b - 1)) AS s FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b) GROUP BY 1, 2, 3),
 corner AS (SELECT property_id, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND s <> 0 THEN 2 ELSE 0 END)::BIGINT AS corners,
  (sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND s <> 0 THEN 2 ELSE 0 END) / 4)::BIGINT AS rings_less_holes FROM v GROUP BY 1),
 side AS (SELECT property_id, count(*) AS shared FROM c JOIN c b USING (property_id) WHERE abs(c.i - b.i) + abs(c.j - b.j) = 1 GROUP BY 1),
 size AS (SELECT property_id, count(*) AS cells FROM c GROUP BY 1)
 SELECT property_id, cells::DOUBLE AS union_area, (4 * cells - coalesce(shared, 0))::DOUBLE AS perimeter, corners, rings_less_holes FROM size JOIN corner USING (property_id) LEFT JOIN side USING (property_id)""")
def property_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Covered area and outlines of every property's rooms."""
    from roomfold.plans.tables import table
    spot = lambda x, y: F.struct((F.col("x") + x).cast("double").alias("x"), (F.col("y") + y).cast("double").alias("y"))
    plots = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("room_id"), (F.col("o_orderkey") % 9).alias("x"),
        (F.floor("o_totalprice") % 7).alias("y"), (1 + F.col("o_orderkey") % 3).alias("w"), (1 + F.col("o_orderkey") % 4).alias("d"))
    placed = plots.select("property_id", "room_id", F.array(spot(0, 0), spot(F.col("w"), 0), spot(F.col("w"), F.col("d")), spot(0, F.col("d"))).alias("ring"))
    rings = footprint.outlines(grown(footprint.slabs(placed, ["property_id"])), ["property_id"])
    return rings.groupBy("property_id").agg(
        F.round(F.sum("area"), 6).alias("union_area"), F.round(F.sum("perimeter"), 6).alias("perimeter"), F.sum(F.size("outline")).alias("corners"),
        F.sum(F.signum("area")).cast("bigint").alias("rings_less_holes"))


@query("property_layout")
def property_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship layout: every step from evidence to verdict for all properties."""
    out = stitching.stitch(rooms(spark, sf), evidence(spark, sf), outlined=False)["verdict"]
    return out.select("property_id", "rooms", "placed", "unplaced", "valid_layout", "codes", "footprint_parts",
                      *[F.round(c, 4).alias(c) for c in ("total_area", "union_area", "cycle_error", "layout_residual", "max_overlap")])
