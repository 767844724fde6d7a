"""Queries over openings and damage: line items as surface points and candidates of supplier walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import DamageConfig, OpeningConfig
from roomfold.operators import damage, frames as frame_ops, masks, openings
from roomfold.operators.ordering import best_per_group
from roomfold.plans import projections as P
from roomfold.plans.registry import query
from roomfold.plans.tables import table

# Four suppliers make the walls of one 5 x 4 m room.
WALLS = ["s_suppkey AS wall_id", "s_suppkey // 4 AS room_id", "s_suppkey % 4 AS wall_order",
         "CASE WHEN s_suppkey % 4 IN (0, 3) THEN 0.0 ELSE 5.0 END AS x0", "CASE WHEN s_suppkey % 4 IN (0, 1) THEN 0.0 ELSE 4.0 END AS y0",
         "CASE WHEN s_suppkey % 4 IN (2, 3) THEN 0.0 ELSE 5.0 END AS x1", "CASE WHEN s_suppkey % 4 IN (0, 3) THEN 0.0 ELSE 4.0 END AS y1"]
POINTS = ["l_suppkey * 8 + l_linenumber AS candidate_id", "l_suppkey // 4 AS room_id", "l_quantity / 10 AS wx",
          "CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 4 - l_discount END AS wy", "l_extendedprice / 40000 AS wz"]


def spark_walls(spark: SparkSession, sf: str) -> DataFrame:
    cols = [c.replace("s_suppkey // 4", "s_suppkey div 4").replace("0.0 ", "0.0D ").replace("5.0 ", "5.0D ").replace("4.0 ", "4.0D ") for c in WALLS]
    return table(spark, sf, "supplier").selectExpr(*cols)


def spark_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[c.replace("l_suppkey // 4", "l_suppkey div 4") for c in POINTS])


W, PT = P.source("supplier", WALLS), P.source("lineitem", POINTS)
ASSOCIATED = f"""(WITH j AS (SELECT p.candidate_id, w.wall_id, w.wall_order, p.wz, len, ((wx - x0) * (x1 - x0) + (wy - y0) * (y1 - y0)) / len AS u,
 abs((wx - x0) * (y1 - y0) - (wy - y0) * (x1 - x0)) / len AS d FROM {PT} p JOIN (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {W} w) w USING (room_id)),
 s AS (SELECT candidate_id, wall_id, wall_order, count(*) AS sample_count, median(d) AS wall_distance, any_value(len) AS wall_length,
  greatest(0, quantile_cont(u, 0.02)) AS u_min, least(any_value(len), quantile_cont(u, 0.98)) AS u_max, greatest(0, quantile_cont(wz, 0.02)) AS v_min, quantile_cont(wz, 0.98) AS v_max
  FROM j WHERE u BETWEEN -0.12 AND len + 0.12 AND d <= 0.18 GROUP BY 1, 2, 3 HAVING count(*) >= 25)
 SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sample_count / (1 + wall_distance / 0.18) DESC, wall_order) AS n FROM s) t WHERE n = 1)"""


def associated(spark: SparkSession, sf: str) -> DataFrame:
    return openings.associate_walls(spark_points(spark, sf), spark_walls(spark, sf), ["room_id"])


@query("wall_association", f"""SELECT candidate_id, wall_id, sample_count, round(wall_distance, 6) AS wall_distance, round(u_min, 6) AS u_min, round(u_max, 6) AS u_max,
 round(v_min, 6) AS v_min, round(v_max, 6) AS v_max FROM {ASSOCIATED} a""")
def wall_association(spark: SparkSession, sf: str) -> DataFrame:
    return associated(spark, sf).select("candidate_id", "wall_id", "sample_count", *[F.round(c, 6).alias(c) for c in ("wall_distance", "u_min", "u_max", "v_min", "v_max")])


KIND = "CASE WHEN candidate_id % 8 IN (1, 4, 6) THEN 'door' WHEN candidate_id % 8 IN (2, 3) THEN 'window' ELSE 'unknown' END"


@query("opening_candidate_ladder", f"""SELECT candidate_id, round(g, 6) AS geometry_score, round(q, 6) AS quality, CASE WHEN u_max - u_min <= 0 THEN 'OPENING_EXCEEDS_WALL_BOUNDS'
 WHEN v_max - v_min < 0.4 THEN 'OPENING_DIMENSIONS_UNRESOLVED' WHEN kind = 'door' AND u_max - u_min NOT BETWEEN 0.45 AND 2.5 THEN 'POSSIBLE_PHANTOM_OPENING'
 WHEN kind = 'window' AND u_max - u_min NOT BETWEEN 0.3 AND 5 THEN 'POSSIBLE_PHANTOM_OPENING' WHEN kind = 'window' AND v_min <= 0.22 AND q < 0.82 THEN 'POSSIBLE_PHANTOM_OPENING' END AS rejection_reason
 FROM (SELECT *, (0.45 * 0.8 + 0.55 * g) * CASE WHEN kind = 'door' AND v_min > 0.22 THEN 0.75 WHEN kind = 'window' AND v_min <= 0.22 THEN 0.5 ELSE 1 END AS q FROM
 (SELECT * REPLACE (u_min + CASE WHEN candidate_id % 3 = 0 THEN 3.0 ELSE 0 END AS u_min), {KIND} AS kind, 0.7 * greatest(0, 1 - wall_distance / 0.18) + 0.3 * least(1, sample_count / 75.0) AS g FROM {ASSOCIATED} a) b) t""")
def opening_candidate_ladder(spark: SparkSession, sf: str) -> DataFrame:
    # A third of the candidates are narrowed so that every size rule is met on both sides.
    rows = associated(spark, sf).withColumn("kind", F.expr(KIND)).withColumn("semantic_score", F.lit(0.8)) \
        .withColumn("u_min", F.col("u_min") + F.when(F.col("candidate_id") % 3 == 0, 3.0).otherwise(0.0))
    out = openings.judge_candidates(rows)
    return out.select("candidate_id", F.round("geometry_score", 6).alias("geometry_score"), F.round("quality", 6).alias("quality"), "rejection_reason")


@query("candidate_warnings", f"""SELECT candidate_id, n AS sample_count, CASE WHEN n < 25 THEN 'OPENING_DEPTH_UNAVAILABLE' ELSE 'OPENING_WALL_ASSOCIATION_FAILED' END AS rejection_reason FROM
 (SELECT candidate_id, count(*) AS n FROM {PT} p GROUP BY 1) t WHERE candidate_id NOT IN (SELECT candidate_id FROM {ASSOCIATED} a WHERE wall_distance <= 0.05)""")
def candidate_warnings(spark: SparkSession, sf: str) -> DataFrame:
    pts = spark_points(spark, sf)
    return openings.without_depth(pts.select("candidate_id").distinct(), pts, associated(spark, sf).filter("wall_distance <= 0.05"))


CAND = f"(SELECT * REPLACE (ordinal * 10000000 + l_partkey AS ordinal), (u_min + u_max) / 2 AS center FROM {P.source('lineitem', P.CANDIDATES)} c)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return P.candidates(spark, sf).withColumn("ordinal", F.col("ordinal") * 10000000 + F.col("l_partkey"))


@query("opening_clusters", f"""WITH RECURSIVE d AS (SELECT wall_id, center, min((u_min, ordinal)) AS first FROM {CAND} c GROUP BY 1, 2),
 s AS (SELECT wall_id, center, row_number() OVER (PARTITION BY wall_id ORDER BY first) AS n FROM d),
 w AS (SELECT wall_id, n, center, [center] AS leaders, 1::BIGINT AS group_no FROM s WHERE n = 1
 UNION ALL SELECT s.wall_id, s.n, s.center, CASE WHEN g IS NULL THEN list_append(w.leaders, s.center) ELSE w.leaders END, coalesce(g, len(w.leaders) + 1)
 FROM w JOIN s ON s.wall_id = w.wall_id AND s.n = w.n + 1, LATERAL (SELECT list_position(list_transform(w.leaders, lambda c: abs(c - s.center) <= 0.25), true) AS g) p)
 SELECT c.wall_id, c.ordinal, w.group_no FROM {CAND} c JOIN w ON w.wall_id = c.wall_id AND w.center = c.center""")
def opening_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return openings.cluster(candidates(spark, sf), ["wall_id"]).select("wall_id", "ordinal", "group_no")


GROUPED = f"(SELECT *, floor(u_min / 0.5)::BIGINT AS group_no FROM {CAND} c)"


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).withColumn("group_no", F.floor(F.col("u_min") / 0.5))


@query("opening_votes", f"""WITH s AS (SELECT wall_id, group_no, kind, sum(round(semantic_score * 10)) AS s, min(ordinal) AS o FROM {GROUPED} g GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY wall_id, group_no ORDER BY s DESC, o) AS n, sum(s) OVER (PARTITION BY wall_id, group_no) AS total FROM s),
 p AS (SELECT wall_id, group_no, max(CASE WHEN n = 1 THEN s END) AS s1, max(CASE WHEN n = 2 THEN s END) AS s2, max(CASE WHEN n = 1 THEN kind END) AS k, any_value(total) AS total FROM r GROUP BY 1, 2)
 SELECT wall_id, group_no, coalesce(s1 - s2 < 0.15::DOUBLE * total, false) AS ambiguous, CASE WHEN s1 - s2 < 0.15::DOUBLE * total THEN 'unknown' ELSE k END AS type FROM p""")
def opening_votes(spark: SparkSession, sf: str) -> DataFrame:
    whole = grouped(spark, sf).withColumn("semantic_score", F.round(F.col("semantic_score") * 10))
    return openings.vote(whole, ["wall_id", "group_no"])


@query("opening_fusion", f"""WITH m AS (SELECT wall_id, group_no, median(u_min) AS position, median(u_max - u_min) AS width, median(v_max - v_min) AS height, median(quality) AS quality,
  count(*) AS members, count(DISTINCT CASE WHEN kind <> 'open_passage' THEN frame_id END) AS views FROM {GROUPED} g GROUP BY 1, 2),
 d AS (SELECT wall_id, group_no, median(abs(u_max - u_min - width)) AS width_mad, median(abs(v_max - v_min - height)) AS height_mad FROM {GROUPED} g JOIN m USING (wall_id, group_no) GROUP BY 1, 2)
 SELECT wall_id, group_no, members, views, round(position, 6) AS position, round(width, 6) AS width, round(height, 6) AS height, round(width_mad, 6) AS width_mad, round(height_mad, 6) AS height_mad,
 (views >= 2 OR (views = 1 AND quality >= 0.82) OR views = 0) AND width_mad <= 0.25 AS accepted, CASE WHEN width_mad > 0.25 THEN 'OPENING_MULTI_VIEW_INCONSISTENT'
 WHEN NOT (views >= 2 OR (views = 1 AND quality >= 0.82) OR views = 0) THEN 'OPENING_LOW_SUPPORT' WHEN height_mad > 0.25 THEN 'OPENING_DIMENSIONS_UNRESOLVED' END AS reason FROM m JOIN d USING (wall_id, group_no)""")
def opening_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = grouped(spark, sf).withColumn("frame_id", F.when(F.col("kind") != "open_passage", F.col("frame_id")))
    out = openings.fuse(rows, ["wall_id", "group_no"])
    return out.select("wall_id", "group_no", "members", "views", *[F.round(c, 6).alias(c) for c in ("position", "width", "height", "width_mad", "height_mad")], "accepted", "reason")


@query("new_occupancy_holes", f"""WITH RECURSIVE h AS (SELECT * FROM {CAND} c WHERE kind = 'open_passage' AND NOT EXISTS (SELECT 1 FROM {CAND} a WHERE a.kind = 'door' AND a.wall_id = c.wall_id AND abs(a.center - c.center) <= 0.02)),
 s AS (SELECT wall_id, center, o, row_number() OVER (PARTITION BY wall_id ORDER BY o) AS n FROM (SELECT wall_id, center, min(ordinal) AS o FROM h GROUP BY 1, 2) t),
 w AS (SELECT wall_id, n, o, [center] AS kept, true AS opens FROM s WHERE n = 1 UNION ALL
 SELECT s.wall_id, s.n, s.o, CASE WHEN f THEN list_append(w.kept, s.center) ELSE w.kept END, f FROM w JOIN s ON s.wall_id = w.wall_id AND s.n = w.n + 1,
 LATERAL (SELECT len(list_filter(w.kept, lambda c: abs(c - s.center) <= 0.02)) = 0 AS f) p)
 SELECT wall_id, o AS ordinal FROM w WHERE opens""")
def new_occupancy_holes(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf)
    out = openings.keep_new_holes(rows.filter("kind = 'open_passage'"), rows.filter("kind = 'door'"), ["wall_id"], OpeningConfig(merge_distance=0.02))
    return out.select("wall_id", "ordinal")


@query("wall_occupancy", f"""SELECT wall_id, floor(u / 0.2)::INT AS i, floor(wz / 0.2)::INT AS j, count(*) AS points FROM (SELECT w.wall_id, p.wz, len, (wx - x0) * ((x1 - x0) / len) + (wy - y0) * ((y1 - y0) / len) AS u,
 abs((wx - x0) * (y1 - y0) - (wy - y0) * (x1 - x0)) / len AS d FROM {PT} p JOIN (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {W} w) w USING (room_id)) t
 WHERE u BETWEEN 0 AND len AND wz BETWEEN 0 AND 2.5 AND d <= 0.18 GROUP BY 1, 2, 3""")
def wall_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    walls = spark_walls(spark, sf).withColumn("ceiling", F.lit(2.5))
    return openings.occupancy(spark_points(spark, sf), walls, ["room_id"], OpeningConfig(cell=0.2)).select("wall_id", "i", "j", "points")


def _reach(source: str, keys: str, size: int) -> str:
    """Each cell once for every window that holds it."""
    low, high = size // 2 - size + 1, size // 2 + 1
    return f"(SELECT {keys}, r + o AS r, c + p AS c FROM {source}, unnest(range({low}, {high})) x(o), unnest(range({low}, {high})) y(p))"


def _dilated(source: str, keys: str, size: int) -> str:
    return f"SELECT DISTINCT {keys}, r, c FROM {_reach(source, keys, size)} q JOIN grid USING ({keys}) WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1"


def _eroded(source: str, keys: str, size: int) -> str:
    b = size // 2
    span = lambda n, i: f"(least({n} - 1, {i} - {b} + {size - 1}) - greatest(0, {i} - {b}) + 1)"
    return (f"SELECT {keys}, r, c FROM (SELECT {keys}, r, c, count(*) AS n FROM {_reach(source, keys, size)} q GROUP BY ALL) q JOIN grid USING ({keys})"
            f" WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1 AND n = {span('h', 'r')} * {span('w', 'c')}")


def _labelled(source: str, keys: str, near: str, steps: int) -> str:
    """Smallest cell of each region, handed on from neighbour to neighbour."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""link AS MATERIALIZED (SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, a.r, a.c, b.r * 4096 + b.c AS spot FROM {source} a JOIN {source} b ON {same} AND {near}),
 spread(step, {keys}, spot, label) AS (SELECT 0, {keys}, r * 4096 + c, r * 4096 + c FROM {source} UNION ALL
  SELECT any_value(step) + 1, {keys}, link.r * 4096 + link.c, min(label) FROM spread JOIN link USING ({keys}, spot) WHERE step < {steps} GROUP BY {keys}, link.r, link.c),
 region AS (SELECT {keys}, spot // 4096 AS r, spot % 4096 AS c, dense_rank() OVER (PARTITION BY {keys} ORDER BY label) AS component FROM spread WHERE step = {steps})"""


@query("occupancy_holes", f"""WITH RECURSIVE hit AS (SELECT wall_id, len, (floor(u / 0.1))::INT AS i, (floor(wz / 0.1))::INT AS j FROM (SELECT w.wall_id, p.wz, len, (wx - x0) * ((x1 - x0) / len) + (wy - y0) * ((y1 - y0) / len) AS u,
 abs((wx - x0) * (y1 - y0) - (wy - y0) * (x1 - x0)) / len AS d FROM {PT} p JOIN (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len FROM {W} w) w USING (room_id)) t
 WHERE len >= 0.2 AND u BETWEEN 0 AND len AND wz BETWEEN 0 AND 2.5 AND d <= 0.18),
 grid AS (SELECT wall_id, len, (ceil((len + 0.1::DOUBLE) / 0.1::DOUBLE) - 1)::INT AS h, (ceil((2.5::DOUBLE + 0.1::DOUBLE) / 0.1::DOUBLE) - 1)::INT AS w FROM hit GROUP BY 1, 2 HAVING count(*) >= 100),
 cell AS (SELECT DISTINCT wall_id, least(i, h - 1) AS r, least(j, w - 1) AS c FROM hit JOIN grid USING (wall_id)),
 wide AS MATERIALIZED ({_dilated('cell', 'wall_id', 3)} UNION SELECT wall_id, r, c FROM grid, unnest(range(0, h)) a(r), unnest(range(0, w)) b(c) WHERE r IN (0, h - 1) OR c IN (0, w - 1)),
 solid AS MATERIALIZED ({_eroded('wide', 'wall_id', 3)}),
 hole AS MATERIALIZED (SELECT wall_id, r, c FROM grid, unnest(range(0, h)) a(r), unnest(range(0, w)) b(c) WHERE NOT EXISTS (SELECT 1 FROM solid s WHERE s.wall_id = grid.wall_id AND s.r = a.r AND s.c = b.c)),
 {_labelled('hole', 'wall_id', 'abs(a.r - b.r) + abs(a.c - b.c) <= 1', 150)},
 box AS (SELECT wall_id, component, min(r) AS u0, max(r) + 1 AS u1, min(c) AS v0, max(c) + 1 AS v1 FROM region GROUP BY 1, 2)
 SELECT wall_id, component::INTEGER AS label, round(u0 * 0.1::DOUBLE, 4) AS u_min, round(least(len, u1 * 0.1::DOUBLE), 4) AS u_max, round(v0 * 0.1::DOUBLE, 4) AS v_min, round(least(2.5::DOUBLE, v1 * 0.1::DOUBLE), 4) AS v_max, 1.0::DOUBLE AS support,
 CASE WHEN v0 * 0.1::DOUBLE <= 0.22 AND (v1 - v0) * 0.1::DOUBLE >= 1.6 THEN 'open_passage' ELSE 'unknown' END AS kind FROM box JOIN grid USING (wall_id) WHERE u0 > 0 AND u1 < h AND v1 < w""")
def occupancy_holes(spark: SparkSession, sf: str) -> DataFrame:
    walls = spark_walls(spark, sf).withColumn("ceiling", F.lit(2.5))
    cfg = OpeningConfig(cell=0.1, door_min_width=0.1, min_height=0.1, min_boundary_support=0.2)
    out = openings.occupancy_holes(openings.occupancy(spark_points(spark, sf), walls, ["room_id"], cfg), cfg)
    return out.select("wall_id", "label", *[F.round(c, 4).alias(c) for c in ("u_min", "u_max", "v_min", "v_max", "support")], "kind")


def mask_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A 50 x 40 probability mask per supplier: how often a pixel is hit by discounted items."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame_id"), F.lit("door").alias("kind"),
                                                (F.col("l_quantity") - 1).cast("int").alias("row"), (F.col("l_partkey") % 20).cast("int").alias("col")).agg(
        F.max(F.col("l_discount") * 10).alias("probability"))


@query("mask_components", f"""WITH RECURSIVE pixel AS (SELECT l_suppkey AS frame_id, (l_quantity - 1)::INT AS r, (l_partkey % 20)::INT AS c, max(l_discount * 10) AS p FROM lineitem GROUP BY 1, 2, 3),
 grid AS (SELECT frame_id, max(r) + 1 AS h, max(c) + 1 AS w FROM pixel GROUP BY 1), raw AS (SELECT frame_id, r, c FROM pixel WHERE p >= 0.2),
 m1 AS MATERIALIZED ({_eroded('raw', 'frame_id', 2)}), m2 AS MATERIALIZED ({_dilated('m1', 'frame_id', 2)}), m3 AS MATERIALIZED ({_dilated('m2', 'frame_id', 2)}), clean AS MATERIALIZED ({_eroded('m3', 'frame_id', 2)}),
 {_labelled('clean', 'frame_id', 'abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1', 90)}
 SELECT frame_id, component::INTEGER AS component, count(*) AS pixel_area, min(c)::INTEGER AS "left", min(r)::INTEGER AS top, (max(c) + 1)::INTEGER AS "right", (max(r) + 1)::INTEGER AS bottom,
 round(median(coalesce(p, 0)), 6) AS semantic_score FROM region LEFT JOIN pixel USING (frame_id, r, c) GROUP BY 1, 2 HAVING count(*) >= 9""")
def mask_components(spark: SparkSession, sf: str) -> DataFrame:
    pixels = masks.mask_components(mask_pixels(spark, sf), OpeningConfig(min_score=0.2, min_pixel_area=9, morphology=2))
    return masks.component_table(pixels).select("frame_id", "component", "pixel_area", "left", "top", "right", "bottom", F.round("semantic_score", 6).alias("semantic_score"))


MASK = """(SELECT l_suppkey * 8 + l_linenumber AS candidate_id, l_suppkey AS frame_id, l_quantity::INT AS "row", (l_partkey % 640)::INT AS col, max(l_extendedprice) / 8000 AS z FROM lineitem GROUP BY ALL)"""


@query("mask_stride_sampling", f"""SELECT candidate_id, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY "row", col) - 1 AS n FROM {MASK} m) t WHERE n % 4 = 0 AND z BETWEEN 0.5 AND 10""")
def mask_stride_sampling(spark: SparkSession, sf: str) -> DataFrame:
    mask = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("candidate_id"), F.col("l_quantity").cast("int").alias("row"),
                                                (F.col("l_partkey") % 640).cast("int").alias("col")).agg((F.max("l_extendedprice") / 8000).alias("z"))
    return frame_ops.mask_samples(mask, ["candidate_id"], 4, 0.5, 10.0).select("candidate_id", "row", "col")


@query("mask_depth_join", """SELECT a.l_suppkey AS frame_id, a."row", a.col, round(b.z, 4) AS z FROM (SELECT DISTINCT l_suppkey, l_quantity::INT AS "row", (l_partkey % 64)::INT AS col FROM lineitem WHERE l_returnflag = 'A') a
 JOIN (SELECT l_suppkey, l_quantity::INT AS "row", (l_partkey % 64)::INT AS col, max(l_extendedprice) AS z FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) b USING (l_suppkey, "row", col)""")
def mask_depth_join(spark: SparkSession, sf: str) -> DataFrame:
    pixel = [F.col("l_suppkey").alias("frame_id"), F.col("l_quantity").cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")]
    items = table(spark, sf, "lineitem")
    mask = items.filter("l_returnflag = 'A'").select(*pixel).distinct()
    depth = items.filter("l_returnflag <> 'A'").groupBy(*pixel).agg(F.max("l_extendedprice").alias("z"))
    return frame_ops.mask_depth(mask, depth, ["frame_id"])[0].select("frame_id", "row", "col", F.round("z", 4).alias("z"))


LINKS = P.source("orders", P.EDGES)
RING = "(VALUES (0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 3), (0, 3, 0, 0)) r(ax, ay, bx, by_)"


OPENING_LINKS = f"""WITH RECURSIVE e AS (SELECT *, (connection_id * 7 % 50) / 10.0::DOUBLE AS mx, (connection_id * 3 % 40) / 10.0::DOUBLE AS my FROM {LINKS} x),
 o AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY connection_id) AS n FROM e),
 g AS (SELECT o.property_id, o.connection_id AS opening_id, o.n, c.connection_id, CASE WHEN c.room_a = o.room_a THEN c.room_b ELSE c.room_a END AS other,
  greatest(0.0, least(abs(o.mx - 0), abs(o.mx - 4), abs(o.my - 0), abs(o.my - 3))) AS inner_d, o.mx, o.my FROM o JOIN {LINKS} c ON c.property_id = o.property_id AND (c.room_a = o.room_a OR c.room_b = o.room_a)),
 d AS (SELECT property_id, opening_id, n, connection_id, other, CASE WHEN mx BETWEEN 0 AND 4 AND my BETWEEN 0 AND 3 THEN inner_d
  ELSE sqrt(greatest(0, mx - 4) ^ 2 + greatest(0, my - 3) ^ 2) END AS d FROM g),
 l AS (SELECT property_id, opening_id, n, list({{'d': round(d, 9), 'c': connection_id, 'r': other}} ORDER BY round(d, 9), connection_id) AS opts FROM d GROUP BY 1, 2, 3),
 w AS (SELECT property_id, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS opening_id, NULL::BIGINT AS connection_id, NULL::VARCHAR AS linked_room FROM (SELECT DISTINCT property_id FROM e) q
 UNION ALL SELECT l.property_id, l.n, CASE WHEN pick.d <= 0.25 THEN list_append(w.taken, pick.c) ELSE w.taken END, l.opening_id, CASE WHEN pick.d <= 0.25 THEN pick.c END, CASE WHEN pick.d <= 0.25 THEN pick.r END
 FROM w JOIN l ON l.property_id = w.property_id AND l.n = w.n + 1, LATERAL (SELECT list_filter(l.opts, lambda q: NOT list_contains(w.taken, q.c))[1] AS pick) p)
 SELECT * FROM (SELECT property_id, opening_id, nullif(concat('', connection_id), '') AS connection_id, linked_room FROM w WHERE n > 0) z"""


@query("opening_links", OPENING_LINKS)
def opening_links(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.operators.ordering import positions
    rows = P.edges(spark, sf)
    ranked = positions(rows, ["property_id"], ["connection_id"], F.floor(F.col("connection_id") / 100000), "ordinal")
    doors = ranked.select("property_id", F.col("connection_id").alias("opening_id"), F.col("room_a").alias("room_id"), "ordinal",
                          (F.col("connection_id") * 7 % 50 / 10.0).alias("mx"), (F.col("connection_id") * 3 % 40 / 10.0).alias("my"))
    links = rows.select("property_id", "connection_id", F.col("connection_id").alias("connection_order"), "room_a", "room_b", F.lit(None).cast("string").alias("opening_id"))
    rooms = rows.select("property_id", F.explode(F.array("room_a", "room_b")).alias("room_id")).distinct()
    sides = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(side, ("x0", "y0", "x1", "y1"))])
                                for side in ((0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 3), (0, 3, 0, 0))]))
    edges = rooms.withColumn("_s", sides).select("property_id", "room_id", "_s.*")
    return openings.link_openings(doors, links, edges, cfg=OpeningConfig(boundary_tolerance=0.25)).select("property_id", "opening_id", "connection_id", "linked_room")


@query("openings_on_walls", """SELECT l_suppkey AS wall_id, list_sort(list(DISTINCT concat('o', l_linenumber, '.', l_returnflag))) AS opening_ids FROM lineitem GROUP BY 1""")
def openings_on_walls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("wall_id"), F.concat(F.lit("o"), "l_linenumber", F.lit("."), "l_returnflag").alias("opening_id")).distinct()
    return openings.ids_by_owner(rows, ["wall_id"], "opening_id", "opening_ids").select("wall_id", "opening_ids")


@query("previous_openings_removed", """SELECT o_orderkey AS connection_id, CASE WHEN o_orderstatus = 'F' THEN 'inferred' ELSE 'door' END AS connection_type,
 CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS opening_id FROM orders""")
def previous_openings_removed(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    found = orders.select(F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("opening_id"),
                          F.when(F.col("o_orderstatus") == "F", "shared_opening_detector").otherwise("manual").alias("detector"))
    links = orders.select(F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("connection_id"), F.col("o_orderkey").alias("opening_id"), F.lit("door").alias("connection_type"))
    return openings.drop_previous(found, links, ["property_id"])[1].select("connection_id", "connection_type", "opening_id")


SURFACES = f"""(SELECT wall_id AS surface_id, room_id, 'wall' AS kind, wall_order AS surface_order, x0, y0, x1, y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))::DOUBLE AS len, NULL::DOUBLE AS height FROM {W} w
 UNION ALL SELECT DISTINCT -1 - 2 * room_id, room_id, 'floor', 10, NULL, NULL, NULL, NULL, NULL, NULL FROM {W} w UNION ALL SELECT DISTINCT -2 - 2 * room_id, room_id, 'ceiling', 11, NULL, NULL, NULL, NULL, NULL, 2.6 FROM {W} w)"""


def surfaces(spark: SparkSession, sf: str) -> DataFrame:
    walls = spark_walls(spark, sf)
    none = F.lit(None).cast("double")
    wall = walls.select(F.col("wall_id").alias("surface_id"), "room_id", F.lit("wall").alias("kind"), F.col("wall_order").cast("int").alias("surface_order"), "x0", "y0", "x1", "y1", none.alias("height"))
    rooms = walls.select("room_id").distinct()
    flat = lambda base, kind, order, height: rooms.select((F.lit(base) - 2 * F.col("room_id")).alias("surface_id"), "room_id", F.lit(kind).alias("kind"), F.lit(order).alias("surface_order"),
                                                          *[none.alias(c) for c in ("x0", "y0", "x1", "y1")], height.alias("height"))
    return wall.unionByName(flat(-1, "floor", 10, none)).unionByName(flat(-2, "ceiling", 11, F.lit(2.6)))


# Points for damage: three kinds of clutter, near a wall, the floor or the ceiling.
DPOINT = """(SELECT l_suppkey * 8 + l_linenumber AS candidate_id, l_suppkey // 4 AS room_id, l_quantity / 10 AS wx, CASE WHEN l_linenumber <= 3 THEN l_discount ELSE l_discount * 20 + 1 END AS wy,
 CASE WHEN l_linenumber <= 3 THEN l_extendedprice / 40000 WHEN l_linenumber <= 5 THEN l_tax ELSE 2.6 - l_tax END AS wz FROM lineitem)"""


def damage_points(spark: SparkSession, sf: str) -> DataFrame:
    near = F.col("l_linenumber") <= 3
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("candidate_id"), F.expr("l_suppkey div 4").alias("room_id"), (F.col("l_quantity") / 10).alias("wx"),
        F.when(near, F.col("l_discount")).otherwise(F.col("l_discount") * 20 + 1).alias("wy"),
        F.when(near, F.col("l_extendedprice") / 40000).when(F.col("l_linenumber") <= 5, F.col("l_tax")).otherwise(2.6 - F.col("l_tax")).alias("wz"))


@query("surface_association", f"""WITH j AS (SELECT candidate_id, surface_id, surface_order, CASE kind WHEN 'wall' THEN abs((wx - x0) * (y1 - y0) - (wy - y0) * (x1 - x0)) / len WHEN 'floor' THEN abs(wz) ELSE abs(wz - height) END AS d,
 CASE kind WHEN 'wall' THEN ((wx - x0) * (x1 - x0) + (wy - y0) * (y1 - y0)) / len ELSE wx END AS su, len, kind FROM {DPOINT} p JOIN {SURFACES} s USING (room_id)),
 m AS (SELECT candidate_id, surface_id, surface_order, median(d) AS residual, count(*) AS points, round(sum(su), 4) AS u_sum FROM j WHERE kind <> 'wall' OR su BETWEEN -0.18 AND len + 0.18 GROUP BY 1, 2, 3)
 SELECT candidate_id, surface_id, round(residual, 6) AS residual, points, u_sum FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY residual, surface_order) AS n FROM m) t WHERE n = 1 AND residual <= 0.18""")
def surface_association(spark: SparkSession, sf: str) -> DataFrame:
    spots = damage.associate_surfaces(damage_points(spark, sf), surfaces(spark, sf), ["room_id"])
    return spots.groupBy("candidate_id", "surface_id").agg(F.round(F.first("residual"), 6).alias("residual"), F.count("*").alias("points"), F.round(F.sum("su"), 4).alias("u_sum"))


@query("principal_extents", f"""WITH m AS (SELECT candidate_id, median(wx) AS mu, median(wy) AS mv FROM {DPOINT} p GROUP BY 1),
 a AS (SELECT candidate_id, any_value(mu) AS mu, any_value(mv) AS mv, 0.5 * atan2(2 * sum((wx - mu) * (wy - mv)), sum((wx - mu) * (wx - mu)) - sum((wy - mv) * (wy - mv))) AS t FROM {DPOINT} p JOIN m USING (candidate_id) GROUP BY 1)
 SELECT candidate_id, round(any_value(mu), 6) AS center_u, round(any_value(mv), 6) AS center_v, count(*) AS points,
 round(max((wx - mu) * cos(t) + (wy - mv) * sin(t)) - min((wx - mu) * cos(t) + (wy - mv) * sin(t)), 6) AS length FROM {DPOINT} p JOIN a USING (candidate_id) GROUP BY 1""")
def principal_extents(spark: SparkSession, sf: str) -> DataFrame:
    spots = damage_points(spark, sf).select("candidate_id", F.col("wx").alias("su"), F.col("wy").alias("sv"))
    return damage.candidate_lengths(spots).select("candidate_id", F.round("center_u", 6).alias("center_u"), F.round("center_v", 6).alias("center_v"), "points", F.round("length", 6).alias("length"))


@query("damage_hulls")
def damage_hulls(spark: SparkSession, sf: str) -> DataFrame:
    spots = damage_points(spark, sf).select("candidate_id", F.col("wx").alias("su"), F.col("wy").alias("sv"))
    return damage.candidate_hulls(spots).select("candidate_id", F.round("hull_area", 6).alias("hull_area"), F.size("ring").alias("vertices"))


DCAND = """(SELECT l_suppkey AS surface_id, CASE l_returnflag WHEN 'A' THEN 'crack' WHEN 'R' THEN 'mold' ELSE 'hole' END AS damage_type, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS ordinal,
 l_quantity / 10 AS center_u, l_discount * 20 AS center_v FROM lineitem)"""


def damage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("surface_id"), F.when(F.col("l_returnflag") == "A", "crack").when(F.col("l_returnflag") == "R", "mold").otherwise("hole").alias("damage_type"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("ordinal"), (F.col("l_quantity") / 10).alias("center_u"),
        (F.col("l_discount") * 20).alias("center_v"), F.col("l_linenumber").alias("frame_id"), (F.col("l_extendedprice") / 100000).alias("hull_area"),
        (F.col("l_tax") * 10).alias("length"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_tax") * 2).alias("residual"))


@query("damage_clusters", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY surface_id, damage_type ORDER BY o) AS n FROM (SELECT surface_id, damage_type, center_u, center_v, min(ordinal) AS o FROM {DCAND} c GROUP BY 1, 2, 3, 4) t),
 w AS (SELECT surface_id, damage_type, n, center_u, center_v, [{{'u': center_u, 'v': center_v}}] AS leaders, 1::BIGINT AS group_no FROM s WHERE n = 1
 UNION ALL SELECT s.surface_id, s.damage_type, s.n, s.center_u, s.center_v, CASE WHEN g IS NULL THEN list_append(w.leaders, {{'u': s.center_u, 'v': s.center_v}}) ELSE w.leaders END, coalesce(g, len(w.leaders) + 1)
 FROM w JOIN s ON s.surface_id = w.surface_id AND s.damage_type = w.damage_type AND s.n = w.n + 1,
 LATERAL (SELECT list_position(list_transform(w.leaders, lambda c: sqrt((c.u - s.center_u) * (c.u - s.center_u) + (c.v - s.center_v) * (c.v - s.center_v)) <= 0.31), true) AS g) p)
 SELECT c.surface_id, c.damage_type, c.ordinal, w.group_no FROM {DCAND} c JOIN w USING (surface_id, damage_type, center_u, center_v)""")
def damage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    spots = damage_candidates(spark, sf).select("surface_id", "damage_type", "ordinal", "center_u", "center_v")
    return damage.cluster(spots, [], DamageConfig(merge_distance=0.31)).select("surface_id", "damage_type", "ordinal", "group_no")


DGROUP = """(SELECT l_suppkey // 4 AS property_id, l_suppkey AS surface_id, CASE l_returnflag WHEN 'A' THEN 'crack' WHEN 'R' THEN 'mold' ELSE 'hole' END AS damage_type, floor(l_quantity / 10)::BIGINT AS group_no,
 (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS ordinal, l_linenumber AS frame_id, l_extendedprice / 100000 AS a, l_tax * 10 AS len, l_quantity / 50 AS score, l_tax * 2 AS residual FROM lineitem)"""


@query("damage_fusion", f"""WITH g AS (SELECT property_id, surface_id, damage_type, group_no, median(a) AS area, median(len) AS length, median(score) AS s, median(residual) AS r, min(ordinal) AS o, count(DISTINCT frame_id) AS views FROM {DGROUP} d GROUP BY 1, 2, 3, 4),
 n AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY o) AS idx FROM g),
 m AS (SELECT surface_id, damage_type, group_no, median(abs(a - area)) AS area_mad FROM {DGROUP} d JOIN g USING (surface_id, damage_type, group_no) GROUP BY 1, 2, 3)
 SELECT property_id, printf('damage_%03d', idx) AS damage_id, damage_type, views, round(area + 1e-9, 6) AS area, round(area_mad + 1e-9, 6) AS area_mad, round(CASE damage_type WHEN 'crack' THEN length END, 6) AS length,
 round(least(1, 0.45 * s + 0.3 * greatest(0, 1 - r / 0.18) + 0.25 * least(1, views / 3.0)), 6) AS quality FROM n JOIN m USING (surface_id, damage_type, group_no) WHERE views >= 2""")
def damage_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = damage_candidates(spark, sf).withColumn("property_id", F.expr("surface_id div 4")).withColumn("group_no", F.floor(F.col("center_u")))
    out = damage.fuse(rows, ["property_id"])
    return out.select("property_id", "damage_id", "damage_type", "views", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("area", "area_mad")], *[F.round(c, 6).alias(c) for c in ("length", "quality")])


@query("damage_gate", """SELECT l_suppkey * 8 + l_linenumber AS candidate_id, count(*) FILTER (WHERE l_tax > 0.03) < 40 AS lacks_depth FROM lineitem GROUP BY 1 HAVING count(*) >= 80 AND max(l_discount) * 10 >= 0.35""")
def damage_gate(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").withColumn("candidate_id", F.col("l_suppkey") * 8 + F.col("l_linenumber"))
    rows = items.groupBy("candidate_id").agg(F.count("*").alias("pixels"), (F.max("l_discount") * 10).alias("score"))
    kept, warned = damage.gate(rows, items.filter("l_tax > 0.03"), DamageConfig(min_points=40))
    return kept.select("candidate_id", F.lit(False).alias("lacks_depth")).unionByName(warned.select("candidate_id", F.lit(True).alias("lacks_depth")))


PARTS = "(SELECT p_partkey, 'd' || p_partkey AS damage_id, CASE p_type WHEN 'ECONOMY' THEN 'crack' WHEN 'LARGE' THEN 'moisture_stain' WHEN 'SMALL' THEN 'mold' WHEN 'MEDIUM' THEN 'hole' ELSE 'unknown' END AS damage_type, CASE WHEN p_size > 20 THEN p_retailprice / 1000 END AS area, CASE WHEN p_size > 10 THEN p_size / 10.0 END AS length FROM part)"


def regions(spark: SparkSession, sf: str) -> DataFrame:
    kind = "CASE p_type WHEN 'ECONOMY' THEN 'crack' WHEN 'LARGE' THEN 'moisture_stain' WHEN 'SMALL' THEN 'mold' WHEN 'MEDIUM' THEN 'hole' ELSE 'unknown' END"
    return table(spark, sf, "part").selectExpr("concat('d', p_partkey) AS damage_id", f"{kind} AS damage_type",
                                               "CASE WHEN p_size > 20 THEN p_retailprice / 1000 END AS area", "CASE WHEN p_size > 10 THEN p_size / 10.0D END AS length")


@query("repair_scope", f"""SELECT 'scope:' || damage_id || ':' || n AS line_item_id, action, round(coalesce(area, length), 6) AS quantity, CASE WHEN area IS NOT NULL THEN 'm2' WHEN length IS NOT NULL THEN 'm' END AS unit
 FROM {PARTS} p JOIN (VALUES ('crack', 1, 'inspect_crack'), ('crack', 2, 'repair_crack'), ('crack', 3, 'repaint'), ('moisture_stain', 1, 'inspect_moisture_source'), ('moisture_stain', 2, 'prepare_surface'),
 ('moisture_stain', 3, 'repaint'), ('mold', 1, 'inspect_moisture_source'), ('mold', 2, 'remediate'), ('hole', 1, 'patch'), ('hole', 2, 'finish'), ('unknown', 1, 'inspect')) a(damage_type, n, action) USING (damage_type)""")
def repair_scope(spark: SparkSession, sf: str) -> DataFrame:
    return damage.scope_items(regions(spark, sf)).select("line_item_id", "action", F.round("quantity", 6).alias("quantity"), "unit")


@query("concealed_flags", f"""SELECT 'flag:' || damage_id || CASE damage_type WHEN 'mold' THEN ':source' ELSE ':moisture' END AS flag_id,
 CASE damage_type WHEN 'mold' THEN 'RULE_MOLD_MOISTURE_SOURCE' ELSE 'RULE_WATER_STAIN_CONCEALED_MOISTURE' END AS rule_id FROM {PARTS} p WHERE damage_type IN ('mold', 'moisture_stain', 'water_damage')""")
def concealed_flags(spark: SparkSession, sf: str) -> DataFrame:
    return damage.concealed_flags(regions(spark, sf)).select("flag_id", "rule_id")


@query("best_of_group", """SELECT l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) t WHERE n = 1""")
def best_of_group(spark: SparkSession, sf: str) -> DataFrame:
    out = best_per_group(table(spark, sf, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query("typed_connections", f"""WITH l AS (SELECT * FROM ({OPENING_LINKS}) q WHERE connection_id IS NOT NULL),
 t AS (SELECT l.property_id, l.connection_id, concat('', l.opening_id) AS opening_id, CASE l.opening_id % 3 WHEN 0 THEN 'door' WHEN 1 THEN 'open_passage' ELSE 'window' END AS type FROM l)
 SELECT c.property_id, concat('', c.connection_id) AS connection_id, t.opening_id, CASE WHEN type IN ('door', 'open_passage') THEN type ELSE 'inferred' END AS connection_type
 FROM {LINKS} c LEFT JOIN t ON t.property_id = c.property_id AND t.connection_id = concat('', c.connection_id)""")
def typed_connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connections with the opening linked to them and, for doors and passages, its type."""
    links = P.edges(spark, sf).select("property_id", "connection_id", F.lit(None).cast("string").alias("opening_id"), F.lit("inferred").alias("connection_type"))
    kind = F.when(F.col("opening_id") % 3 == 0, "door").when(F.col("opening_id") % 3 == 1, "open_passage").otherwise("window")
    doors = P.edges(spark, sf).select("property_id", F.col("connection_id").alias("opening_id")).withColumn("type", kind)
    return openings.typed_connections(links, opening_links(spark, sf), doors).select("property_id", "connection_id", "opening_id", "connection_type")


@query("opening_ids", f"""WITH f AS (SELECT wall_id % 4 AS property_id, wall_id, group_no, count(*) AS members, min({{'u': u_min, 'o': ordinal}}) AS first FROM {GROUPED} g GROUP BY 1, 2, 3)
 SELECT property_id, wall_id, group_no, members, concat('detected:', wall_id, ':', CASE WHEN n < 10 THEN '0' ELSE '' END, n) AS opening_id
 FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY wall_id, first) AS n FROM f) t""")
def opening_ids(spark: SparkSession, sf: str) -> DataFrame:
    members = grouped(spark, sf).withColumn("property_id", F.col("wall_id") % 4)
    fused = members.groupBy("property_id", "wall_id", "group_no").agg(F.count("*").alias("members"))
    return openings.number_openings(fused, members, ["property_id"]).select("property_id", "wall_id", "group_no", "members", "opening_id")
