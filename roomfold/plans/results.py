"""Queries over result documents: measurements, intervals, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roomfold.config import ConfidenceConfig
from roomfold.operators import documents as docs, integrity, measurements as ops
from roomfold.plans.registry import query
from roomfold.plans.tables import table
from roomfold.schemas import result_schema
from roomfold.session import cut

TIER = "CASE o_orderstatus WHEN 'F' THEN 'lidar' WHEN 'O' THEN 'photo' ELSE 'video' END"
WALL_ID = "concat('w:', l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey)"


def measure(value: Column, unit: str, present: Column | None = None) -> Column:
    none = F.lit(None)
    body = F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"),
                    none.cast("double").alias("lower_bound"), none.cast("double").alias("upper_bound"),
                    none.cast("double").alias("confidence_level"), none.cast("double").alias("confidence_score"),
                    none.cast("string").alias("method"), F.lit("unavailable").alias("confidence_method"))
    return body if present is None else F.when(present, body)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms from orders; walls, openings and damage from their line items."""
    rooms = table(spark, sf, "orders").selectExpr(
        "concat('c', o_orderkey) AS capture_id", f"{TIER} AS tier", "concat('r', o_orderkey) AS room_id",
        "o_totalprice / 10000 AS area").withColumn("floor_area", measure(F.col("area"), "m2"))
    items = table(spark, sf, "lineitem").selectExpr(
        "concat('c', l_orderkey) AS capture_id", f"{WALL_ID} AS wall_id", "l_orderkey",
        "l_quantity", "l_tax", "l_discount", "l_partkey", "l_returnflag", "l_linestatus")
    room = lambda e: F.concat(F.lit("r"), e["l_orderkey"])
    share = lambda e, column: (e[column] / 10).cast("string")

    def wall(e: Column) -> Column:
        return F.struct(
            e["wall_id"].alias("wall_id"), room(e).alias("room_id"), measure(e["l_quantity"] / 10, "m").alias("length"),
            measure(e["l_tax"] * 10 + 2, "m").alias("height"), measure(e["l_partkey"] * 7 % 360, "degree").alias("orientation"),
            F.when(e["l_linestatus"] == "F", F.create_map(F.lit("residual_m"), share(e, "l_discount"))).alias("metadata"))

    def opening(e: Column) -> Column:
        return F.struct(
            F.concat(F.lit("o"), e["wall_id"]).alias("opening_id"), F.lit("door").alias("type"), e["wall_id"].alias("wall_id"),
            F.array(room(e)).alias("room_ids"), measure(e["l_discount"] * 10 + 0.5, "m").alias("width"),
            measure(F.lit(2.0), "m").alias("height"), measure(F.lit(0.9), "m", e["l_tax"] > 0.04).alias("sill_height"),
            measure(e["l_quantity"] / 20, "m").alias("position_along_wall"),
            F.create_map(F.lit("width_mad_m"), share(e, "l_discount")).alias("metadata"))

    def damage(e: Column) -> Column:
        return F.struct(
            F.concat(F.lit("d"), e["wall_id"]).alias("damage_id"), F.lit("mold").alias("damage_type"), e["wall_id"].alias("surface_id"),
            room(e).alias("room_id"), measure(e["l_discount"] * 3, "m2", e["l_discount"] > 0).alias("metric_area"),
            F.create_map(F.lit("area_mad_m2"), share(e, "l_tax")).alias("metadata"))

    return docs.assemble_results(rooms, items, "wall_id", wall, (lambda e: e["l_returnflag"] == "R", opening),
                                 (lambda e: e["l_returnflag"] == "A", damage))


ITEM = f"""(SELECT *, concat('c', l_orderkey) AS capture_id, concat('r', l_orderkey) AS room_id, {WALL_ID} AS wall_id, {TIER} AS tier
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ROOM = f"(SELECT *, concat('c', o_orderkey) AS capture_id, concat('r', o_orderkey) AS room_id, {TIER} AS tier FROM orders)"
ROWS = f"""(
 SELECT capture_id, tier, 'property:total_floor_area' AS measurement_id, NULL AS room_id, NULL AS surface_id, 'total_floor_area' AS measurement_type, o_totalprice / 10000 AS value, 'm2' AS unit, NULL::DOUBLE AS mad, NULL::DOUBLE AS res FROM {ROOM} a
 UNION ALL SELECT capture_id, tier, room_id || ':floor', room_id, room_id || ':floor', 'floor_area', o_totalprice / 10000, 'm2', NULL, NULL FROM {ROOM} a
 UNION ALL SELECT capture_id, tier, wall_id || ':wall_length', room_id, wall_id, 'wall_length', l_quantity / 10, 'm', NULL, CASE l_linestatus WHEN 'F' THEN l_discount / 10 END FROM {ITEM} a
 UNION ALL SELECT capture_id, tier, wall_id || ':wall_height', room_id, wall_id, 'wall_height', l_tax * 10 + 2, 'm', NULL, CASE l_linestatus WHEN 'F' THEN l_discount / 10 END FROM {ITEM} a
 UNION ALL SELECT capture_id, tier, wall_id || ':wall_orientation', room_id, wall_id, 'wall_orientation', (l_partkey * 7 % 360)::DOUBLE, 'degree', NULL, CASE l_linestatus WHEN 'F' THEN l_discount / 10 END FROM {ITEM} a
 UNION ALL SELECT capture_id, tier, 'o' || wall_id || ':opening_width', room_id, wall_id, 'opening_width', l_discount * 10 + 0.5, 'm', l_discount / 10, NULL FROM {ITEM} a WHERE l_returnflag = 'R'
 UNION ALL SELECT capture_id, tier, 'o' || wall_id || ':opening_height', room_id, wall_id, 'opening_height', 2, 'm', NULL, NULL FROM {ITEM} a WHERE l_returnflag = 'R'
 UNION ALL SELECT capture_id, tier, 'o' || wall_id || ':sill_height', room_id, wall_id, 'sill_height', 0.9, 'm', NULL, NULL FROM {ITEM} a WHERE l_returnflag = 'R' AND l_tax > 0.04
 UNION ALL SELECT capture_id, tier, 'o' || wall_id || ':opening_position', room_id, wall_id, 'opening_position', l_quantity / 20, 'm', NULL, NULL FROM {ITEM} a WHERE l_returnflag = 'R'
 UNION ALL SELECT capture_id, tier, 'd' || wall_id || ':damage_area', room_id, wall_id, 'damage_area', l_discount * 3, 'm2', l_tax / 10, NULL FROM {ITEM} a WHERE l_returnflag = 'A' AND l_discount > 0)"""


@query("measurement_rows", f"SELECT capture_id, tier, measurement_id, room_id, surface_id, measurement_type, round(value, 6) AS value, unit FROM {ROWS} r")
def measurement_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.unpivot_results(documents(spark, sf)).select(
        "capture_id", "tier", "measurement_id", "room_id", "surface_id", "measurement_type", F.round("value", 6).alias("value"), "unit")


# Profiles known for lidar rooms only: the error of a kind is its spread over all lidar rows.
PROFILE = f"(SELECT 'lidar' AS tier, measurement_type, avg(value) / 50 AS err FROM {ROWS} r WHERE tier = 'lidar' AND measurement_type LIKE 'wall%' GROUP BY 2)"


@query("measurement_intervals", f"""SELECT capture_id, measurement_id, method AS confidence_method, round(value, 6) AS value,
 round(1e-9 + CASE WHEN half IS NOT NULL THEN greatest(0, value - half) END, 6) AS lower_bound,
 round(1e-9 + CASE WHEN half IS NOT NULL THEN CASE WHEN unit = 'degree' THEN least(360, value + half) ELSE value + half END END, 6) AS upper_bound FROM (
 SELECT r.*, CASE WHEN err IS NOT NULL THEN err WHEN mad > 0 THEN 1.96 * 1.4826 * mad WHEN res > 0 THEN 1.96 * res
  ELSE value * CASE r.tier WHEN 'photo' THEN 0.1::DOUBLE WHEN 'video' THEN 0.08::DOUBLE ELSE 0.04::DOUBLE END END AS half,
 CASE WHEN err IS NOT NULL THEN 'benchmark_calibrated' WHEN mad > 0 THEN 'multi_view_dispersion' WHEN res > 0 THEN 'geometry_residual'
  ELSE 'tier_prior_uncalibrated' END AS method FROM {ROWS} r LEFT JOIN {PROFILE} p ON p.tier = r.tier AND p.measurement_type = r.measurement_type) t""")
def measurement_intervals(spark: SparkSession, sf: str) -> DataFrame:
    # Read twice: the profile comes from the rows themselves.
    rows = cut(ops.unpivot_results(documents(spark, sf)).drop("room_id", "surface_id"))
    profile = rows.filter("tier = 'lidar' AND measurement_type LIKE 'wall%'").groupBy("tier", "measurement_type").agg(
        (F.avg("value") / 50).alias("absolute_error"), F.lit(0.95).alias("profile_level"))
    out = ops.apply_confidence(rows, profile, ConfidenceConfig(allow_tier_prior=True))
    return out.select("capture_id", "measurement_id", "confidence_method",
                      F.round("value", 6).alias("value"),
                      *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("lower_bound", "upper_bound")])


@query("confidence_methods", f"""SELECT capture_id, list_sort(list_distinct(list(CASE WHEN mad > 0 THEN 'multi_view_dispersion' WHEN res > 0 THEN 'geometry_residual'
 ELSE 'tier_prior_uncalibrated' END))) AS methods, false AS profile_used FROM {ROWS} r GROUP BY 1""")
def confidence_methods(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.apply_confidence(ops.unpivot_results(documents(spark, sf)), None, ConfidenceConfig(allow_tier_prior=True))
    return ops.confidence_summary(rows)


@query("uncalibrated_warnings", f"""SELECT DISTINCT capture_id, 'UNCALIBRATED_CONFIDENCE_INTERVALS' AS code FROM {ROWS} r
 WHERE NOT (coalesce(mad, 0) > 0 OR coalesce(res, 0) > 0) AND tier <> 'video'""")
def uncalibrated_warnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.apply_confidence(ops.unpivot_results(documents(spark, sf)), None, ConfidenceConfig(allow_tier_prior=True))
    present = table(spark, sf, "orders").filter("o_orderstatus NOT IN ('F', 'O')").selectExpr(
        "concat('c', o_orderkey) AS capture_id", "'UNCALIBRATED_CONFIDENCE_INTERVALS' AS code")
    return ops.finalisation_warnings(rows, present).select("capture_id", "code")


@query("result_summary", f"""SELECT capture_id, 1 AS rooms, round(o_totalprice / 10000, 6) AS total_floor_area, coalesce(o, 0) AS openings, coalesce(d, 0) AS damages, 0 AS warnings
 FROM {ROOM} a LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS o, count(*) FILTER (WHERE l_returnflag = 'A') AS d FROM lineitem GROUP BY 1) b
 ON l_orderkey = o_orderkey""")
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.result_summary(documents(spark, sf)).withColumn("total_floor_area", F.round("total_floor_area", 6))


@query("room_summary", f"""SELECT capture_id, room_id, coalesce(w, 0) AS walls, coalesce(o, 0) AS openings, coalesce(d, 0) AS damages
 FROM {ROOM} a LEFT JOIN (SELECT l_orderkey, count(*) AS w, count(*) FILTER (WHERE l_returnflag = 'R') AS o, count(*) FILTER (WHERE l_returnflag = 'A') AS d
 FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey""")
def room_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.room_summary(documents(spark, sf))


# Entity tables of one property per order, full of conflicts.
def entities(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    li = table(spark, sf, "lineitem")
    pick = lambda *cols: li.selectExpr("l_orderkey AS capture_id", *cols)
    return {
        "rooms": pick("concat('r', l_linenumber) AS room_id"),
        "walls": pick("concat('w', l_partkey % 50) AS wall_id", "concat('r', l_linenumber) AS room_id",
                      "concat('r', CASE WHEN l_returnflag = 'A' THEN 1 ELSE l_linenumber END) AS listed_room_id"),
        "surfaces": pick("concat('w', l_partkey % 50) AS surface_id", "concat('r', l_linenumber) AS room_id"),
        "openings": pick("concat('o', l_suppkey % 20) AS opening_id", "concat('w', l_suppkey % 50) AS wall_id"),
        "opening_rooms": pick("concat('o', l_suppkey % 20) AS opening_id",
                              "explode(array(concat('r', l_linenumber), concat('r', l_suppkey % 7 + 1))) AS room_id"),
        "connections": pick("concat('c', l_linenumber) AS connection_id", "concat('r', l_linenumber) AS room_a_id",
                            "concat('r', l_suppkey % 7 + 1) AS room_b_id", "concat('o', l_partkey % 20) AS opening_id"),
        "damages": pick("concat('d', l_partkey % 30) AS damage_id", "concat('r', l_suppkey % 7 + 1) AS room_id",
                        "concat('w', l_partkey % 50) AS surface_id"),
        "scope": pick("concat('s', l_linenumber) AS line_item_id", "concat('r', l_linenumber) AS room_id",
                      "CAST(NULL AS STRING) AS surface_id", "concat('d', l_suppkey % 30) AS damage_id"),
    }


OR = """(SELECT DISTINCT l_orderkey AS capture_id, concat('o', l_suppkey % 20) AS opening_id, unnest([concat('r', l_linenumber), concat('r', l_suppkey % 7 + 1)]) AS room_id FROM lineitem)"""


@query("integrity_uniqueness", """SELECT l_orderkey AS capture_id, 'duplicate_room' AS rule_id, concat('r', l_linenumber) AS entity_id FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, 'duplicate_surface', concat('w', l_partkey % 50) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, 'duplicate_opening', concat('o', l_suppkey % 20) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, 'duplicate_connection', concat('c', l_linenumber) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, 'duplicate_damage', concat('d', l_partkey % 30) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, 'duplicate_scope_item', concat('s', l_linenumber) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1""")
def integrity_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.uniqueness(entities(spark, sf))


def _anti(select: str, entity: str, ref: str, rule: str, known: str) -> str:
    return (f"SELECT DISTINCT l_orderkey AS capture_id, '{rule}' AS rule_id, {entity} AS entity_id FROM (SELECT *, {ref} AS ref FROM lineitem) a "
            f"WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND {known} = a.ref)")


@query("integrity_references", " UNION ".join([
    _anti("", "concat('o', l_suppkey % 20)", "concat('r', l_suppkey % 7 + 1)", "opening_room_missing", "concat('r', b.l_linenumber)"),
    _anti("", "concat('o', l_suppkey % 20)", "concat('w', l_suppkey % 50)", "opening_wall_missing", "concat('w', b.l_partkey % 50)"),
    _anti("", "concat('c', l_linenumber)", "concat('r', l_suppkey % 7 + 1)", "connection_room_missing", "concat('r', b.l_linenumber)"),
    _anti("", "concat('c', l_linenumber)", "concat('o', l_partkey % 20)", "connection_opening_missing", "concat('o', b.l_suppkey % 20)"),
    _anti("", "concat('d', l_partkey % 30)", "concat('r', l_suppkey % 7 + 1)", "damages_room_missing", "concat('r', b.l_linenumber)"),
    _anti("", "concat('s', l_linenumber)", "concat('d', l_suppkey % 30)", "scope_damage_missing", "concat('d', b.l_partkey % 30)")]))
def integrity_references(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.references(entities(spark, sf))


@query("integrity_agreement", f"""SELECT DISTINCT l_orderkey AS capture_id, 'wall_owner' AS rule_id, concat('w', l_partkey % 50) AS entity_id FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 1
 UNION SELECT a.l_orderkey, 'opening_host_room', concat('o', a.l_suppkey % 20) FROM lineitem a JOIN lineitem w ON w.l_orderkey = a.l_orderkey AND w.l_partkey % 50 = a.l_suppkey % 50
  WHERE NOT EXISTS (SELECT 1 FROM {OR} r WHERE r.capture_id = a.l_orderkey AND r.opening_id = concat('o', a.l_suppkey % 20) AND r.room_id = concat('r', w.l_linenumber))
 UNION SELECT a.l_orderkey, 'connection_opening_rooms', concat('c', a.l_linenumber) FROM lineitem a JOIN {OR} r ON r.capture_id = a.l_orderkey AND r.opening_id = concat('o', a.l_partkey % 20)
  WHERE r.room_id NOT IN (concat('r', a.l_linenumber), concat('r', a.l_suppkey % 7 + 1))
 UNION SELECT a.l_orderkey, 'damages_surface_room', concat('d', a.l_partkey % 30) FROM lineitem a JOIN lineitem w ON w.l_orderkey = a.l_orderkey AND w.l_partkey % 50 = a.l_partkey % 50
  WHERE w.l_linenumber <> a.l_suppkey % 7 + 1
 UNION SELECT a.l_orderkey, 'scope_damage_room', concat('s', a.l_linenumber) FROM lineitem a JOIN lineitem d ON d.l_orderkey = a.l_orderkey AND d.l_partkey % 30 = a.l_suppkey % 30
  WHERE a.l_linenumber <> d.l_suppkey % 7 + 1""")
def integrity_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.agreement(entities(spark, sf))


@query("integrity_shapes", f"""SELECT DISTINCT l_orderkey AS capture_id, 'connection_self_loop' AS rule_id, concat('c', l_linenumber) AS entity_id FROM lineitem WHERE l_linenumber = l_suppkey % 7 + 1
 UNION ALL SELECT l_orderkey, 'opening_room_limit', concat('o', l_suppkey % 20) FROM lineitem GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT a.l_orderkey, 'opening_rooms_repeat', concat('o', a.l_suppkey % 20) FROM lineitem a GROUP BY 1, 3
  HAVING 2 * count(*) > (SELECT count(*) FROM {OR} r WHERE r.capture_id = a.l_orderkey AND r.opening_id = concat('o', a.l_suppkey % 20))""".replace(
    "SELECT a.l_orderkey, 'opening_rooms_repeat', concat('o', a.l_suppkey % 20) FROM lineitem a GROUP BY 1, 3\n  HAVING 2 * count(*) > (SELECT count(*) FROM " + OR + " r WHERE r.capture_id = a.l_orderkey AND r.opening_id = concat('o', a.l_suppkey % 20))",
    "SELECT k, 'opening_rooms_repeat', o FROM (SELECT l_orderkey AS k, concat('o', l_suppkey % 20) AS o, 2 * count(*) AS n FROM lineitem GROUP BY 1, 2) a JOIN (SELECT capture_id, opening_id, count(*) AS d FROM " + OR + " r GROUP BY 1, 2) b ON k = capture_id AND o = opening_id WHERE n > d"))
def integrity_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.shapes({k: v for k, v in entities(spark, sf).items() if k in ("connections", "opening_rooms")})


@query("integrity_domains", f"""SELECT l_orderkey AS capture_id, unnest(list_filter([CASE WHEN v < 0 THEN 'value_domain' END, CASE WHEN lo < 0 THEN 'bound_domain' END,
 CASE WHEN lo > v OR v > hi THEN 'bounds_order' END, CASE WHEN lv > 1 THEN 'level_domain' END, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'unit_mismatch' END,
 CASE WHEN l_returnflag <> 'A' AND greatest(v, lo, hi) > 360 THEN 'angle_limit' END], lambda x: x IS NOT NULL)) AS rule_id, concat('m', l_linenumber) AS entity_id FROM (SELECT *, l_quantity * 8 - 20 AS v,
 l_quantity * 8 - 30 AS lo, CASE WHEN l_tax > 0.02 THEN l_quantity * 8 - l_discount * 300 END AS hi, l_tax * 15 AS lv FROM lineitem) t""")
def integrity_domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS capture_id", "concat('m', l_linenumber) AS measurement_id",
        "CASE WHEN l_returnflag = 'A' THEN 'wall_length' ELSE 'wall_orientation' END AS measurement_type",
        "l_quantity * 8 - 20 AS value", "l_quantity * 8 - 30 AS lower_bound",
        "CASE WHEN l_tax > 0.02 THEN l_quantity * 8 - l_discount * 300 END AS upper_bound", "l_tax * 15 AS confidence_level",
        "CASE WHEN l_returnflag <> 'A' THEN 'degree' WHEN l_linestatus = 'F' THEN 'm2' ELSE 'm' END AS unit")
    return integrity.measurement_domains(rows)


@query("integrity_manifests", """SELECT o_orderkey AS capture_id, unnest(list_filter([CASE WHEN o_orderpriority LIKE '1%' THEN 'manifest_version' END, CASE WHEN o_orderstatus = 'F' THEN 'depth_scale' END,
 CASE WHEN o_orderkey % 5 = 0 THEN 'frame_count' END, CASE WHEN o_custkey % 6 = 0 THEN 'focal_length' END, CASE WHEN o_custkey % 700 >= 640 THEN 'principal_point' END],
 lambda x: x IS NOT NULL)) AS rule_id, concat('', o_orderkey) AS entity_id FROM orders""")
def integrity_manifests(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS capture_id", "CASE WHEN o_orderpriority LIKE '1%' THEN '0.9' ELSE '1.0.0' END AS format_version",
        "CASE WHEN o_orderstatus = 'F' THEN 'meter' ELSE 'millimeter' END AS depth_unit", "1000.0D AS depth_scale",
        "o_orderkey % 5 AS frame_count", "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 5 END AS distinct_frames",
        "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 5 END AS listed_frames",
        "cast(o_custkey % 6 AS double) AS fx", "1.0D AS fy", "cast(o_custkey % 700 AS double) AS cx", "10.0D AS cy",
        "640 AS width", "480 AS height")
    return integrity.manifest_limits(rows)


@query("closed_schema", """SELECT event_id AS capture_id, 'unknown_key' AS rule_id, 'k' AS entity_id FROM events
 UNION ALL SELECT event_id, 'schema_version', '0.' || regexp_extract(props, '[0-9]+') FROM events WHERE value > 100""")
def closed_schema(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("value") > 100, F.regexp_replace("props", "^\\{\"k\": ([0-9]+)", '{"schema_version": "0.$1", "k": $1')).otherwise(F.col("props"))
    raw = table(spark, sf, "events").select("event_id", text.alias("body"))
    return integrity.unknown_keys(raw, "body", ["schema_version", "capture", "property"], "event_id")


# One document per order, its line items as walls. Planted: keys outside the schema at three depths, an object where a list belongs,
# broken text and another version.
_LINES = "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS place FROM lineitem"


@query("nested_unknown_keys", f"""WITH d AS (SELECT * FROM orders WHERE o_orderkey % 50 <> 0), w AS (SELECT q.* FROM ({_LINES}) q JOIN d ON l_orderkey = o_orderkey)
 SELECT o_orderkey AS capture_id, 'unknown_key' AS rule_id, 'capture.device' AS entity_id FROM d WHERE o_orderkey % 3 = 0
 UNION ALL SELECT l_orderkey, 'unknown_key', concat('property.rooms[0].walls[', place, '].colour') FROM w WHERE l_returnflag = 'A'
 UNION ALL SELECT l_orderkey, 'unknown_key', concat('property.rooms[0].walls[', place, '].length.precision') FROM w WHERE l_linenumber = 3
 UNION ALL SELECT o_orderkey, 'wrong_kind', 'damages' FROM d WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_orderkey, 'schema_version', '0.9' FROM d WHERE o_orderpriority LIKE '1%'
 UNION ALL SELECT o_orderkey, 'malformed_document', '$' FROM orders WHERE o_orderkey % 50 = 0""")
def nested_unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", """concat('{"wall_id": "w', l_linenumber, '", "length": {"value": ', l_quantity,
        CASE WHEN l_linenumber = 3 THEN ', "precision": {"digits": [2]}' ELSE '' END, '}', CASE WHEN l_returnflag = 'A' THEN ', "colour": null' ELSE '' END, '}') AS wall""")
    walls = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "wall"))).alias("w"))
    text = F.expr("""concat('{"schema_version": "', CASE WHEN o_orderpriority LIKE '1%' THEN '0.9' ELSE '1.0.0' END, '", "capture": {"capture_id": "c', o_orderkey, '"',
        CASE WHEN o_orderkey % 3 = 0 THEN ', "device": "x"' ELSE '' END, ', "metadata": {"any key": "[1]"}}, "damages": ', CASE WHEN o_orderstatus = 'F' THEN '{}' ELSE '[]' END,
        ', "property": {"confidence": null, "rooms": [{"room_id": "r", "walls": [', coalesce(array_join(w.wall, ', '), ''), ']}]}', CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE '}' END)""")
    raw = table(spark, sf, "orders").join(walls, "o_orderkey", "left").select("o_orderkey", text.alias("body"))
    return integrity.nested_unknown_keys(raw, "body", result_schema(), "o_orderkey")
