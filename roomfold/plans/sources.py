"""Queries over sources and sinks: files are written from the given tables and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.config import FrameConfig
from roomfold.operators import documents as docs, frames as frame_ops, measurements as ops, status
from roomfold.plans import frames as FR, results as R
from roomfold.plans.registry import query
from roomfold.plans.tables import table
from roomfold.session import stage_path
from roomfold.sources import exports, hooks, listing, sparse, tables as T

# A listing of photo folders per customer: brand folders, some hidden, some flat.
LISTED = """(SELECT o_custkey AS property_id, CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '.cache/' ELSE replace(o_orderpriority, '-', CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '_' END) || '/' END
 || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '.JPG' WHEN o_orderstatus = 'O' THEN '.png' ELSE '.txt' END AS relative FROM orders)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey AS property_id", "concat(CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '.cache/' ELSE concat(replace(o_orderpriority, '-', "
        "CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '_' END), '/') END, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '.JPG' WHEN o_orderstatus = 'O' THEN '.png' ELSE '.txt' END) AS relative")
    return rows.withColumn("suffix", F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1))).withColumn("bytes", F.lit(10))


FOLDERS = f"""(SELECT property_id, relative, CASE WHEN property_id % 5 = 0 THEN concat('', property_id) ELSE split_part(relative, '/', 1) END AS folder FROM {LISTED} l WHERE relative NOT LIKE '.cache%' AND relative NOT LIKE '%.txt')"""


@query("photo_rooms", f"""SELECT property_id, relative, folder, regexp_replace(regexp_replace(lower(folder), '[^a-z0-9_.-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS room_id FROM {FOLDERS} f""")
def photo_rooms(spark: SparkSession, sf: str) -> DataFrame:
    return listing.photo_rooms(listed(spark, sf), ["property_id"]).select("property_id", "relative", "folder", "room_id")


@query("repeated_photo_rooms", f"""SELECT property_id, regexp_replace(regexp_replace(lower(folder), '[^a-z0-9_.-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS room_id, count(DISTINCT folder) AS folders FROM {FOLDERS} f GROUP BY 1, 2 HAVING count(DISTINCT folder) > 1""")
def repeated_photo_rooms(spark: SparkSession, sf: str) -> DataFrame:
    return listing.repeated_rooms(listing.photo_rooms(listed(spark, sf), ["property_id"]), ["property_id"])


@query("capture_path_issues", """WITH f AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS photos, count(*) FILTER (WHERE o_orderstatus = 'O') AS videos, count(*) FILTER (WHERE o_totalprice > 250000) AS visible FROM orders GROUP BY 1),
 j AS (SELECT c_custkey AS capture_id, ['photo', 'video', 'lidar'][c_custkey % 3 + 1] AS tier, coalesce(n, 0) AS n, coalesce(photos, 0) AS photos, coalesce(videos, 0) AS videos, coalesce(visible, 0) AS visible FROM customer LEFT JOIN f ON o_custkey = c_custkey)
 SELECT capture_id, tier, code FROM (SELECT *, CASE WHEN n = 0 THEN 'CAPTURE_NOT_FOUND' WHEN tier = 'photo' AND photos NOT BETWEEN 2 AND 8 THEN 'PHOTO_COUNT_2_8' WHEN tier = 'video' AND (videos <> 1 OR n <> 1) THEN 'VIDEO_NOT_MP4_MOV'
 WHEN tier = 'lidar' AND visible = 0 THEN 'LIDAR_EMPTY' END AS code FROM j) t WHERE code IS NOT NULL""")
def capture_path_issues(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").cast("string").alias("relative"), F.when(F.col("o_orderstatus") == "F", "jpg").when(F.col("o_orderstatus") == "O", "mov").otherwise("bin").alias("suffix"),
        F.when(F.col("o_totalprice") > 250000, 5).otherwise(0).alias("bytes"))
    tiers = F.array(*[F.lit(t) for t in ("photo", "video", "lidar")])
    captures = table(spark, sf, "customer").select(F.col("c_custkey").alias("capture_id"), tiers[(F.col("c_custkey") % 3).cast("int")].alias("tier"))
    return listing.capture_issues(files, captures)


@query("odometry_scan", """SELECT concat('capture_id=', user_id) AS capture_id, cast(regexp_extract(props, '[0-9]+') AS INT) AS frame_id, round(max_by(value, event_id), 4) AS x FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def odometry_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "odometry")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("capture_id="), "user_id").alias("capture_id"), "event_id", F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0))).otherwise("bad").alias("frame"),
        F.concat(F.col("value").cast("string"), F.lit(" ")).alias("x"), *[F.lit(v).alias(c) for c, v in (("y", "0"), ("z", "0"), ("qx", "0"), ("qy", "0"), ("qz", "0"), ("qw", "1"))])
    # Rows in time order, as the export has them; many captures share a file, as a file takes longer to make than its rows.
    rows.repartition("capture_id").sortWithinPartitions("capture_id", "event_id").drop("event_id").write.option("header", "true") \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    odometry = exports.read_odometry(spark, f"{path}/*.csv")
    return odometry.select("capture_id", "frame_id", F.round("x", 4).alias("x"))


@query("export_poses", """SELECT event_id AS frame_id, round(value, 6) AS x, -0.5::DOUBLE AS y, round(cast(regexp_extract(props, '[0-9]+') AS DOUBLE), 6) AS z FROM events WHERE event_type IN ('view', 'click')""")
def export_poses(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    odometry = events.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("frame_id"), F.col("value").alias("x"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"), F.lit(0.5).alias("z"),
                             *[F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    depth = events.filter("event_type IN ('view', 'click')").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("frame_id"))
    m = F.col("pose")
    return exports.odometry_poses(odometry, depth).select("frame_id", F.round(m[3], 6).alias("x"), F.round(m[7], 6).alias("y"), F.round(m[11], 6).alias("z"))


@query("metadata_scan", """SELECT page_id AS capture_id, 1920 + page_id % 4 AS width, 256 AS depth_width, (1000 + page_id % 9)::DOUBLE AS fx, (960 + page_id % 5)::DOUBLE AS cx, 2 AS poses, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS unusable FROM pages""")
def metadata_scan(spark: SparkSession, sf: str) -> DataFrame:
    text = F.format_string('{"w": %d, "h": 1440, "dw": 256, "dh": 192, "K": [%d, 0, 0, 0, 1001, 0, %d, 720, 1], "poses": [[0, 0, 0, 1, 1, 2, 3], [0, 0, 0, %d, 4, 5, 6]]}',
                           1920 + F.col("page_id") % 4, 1000 + F.col("page_id") % 9, 960 + F.col("page_id") % 5, F.when(F.col("page_id") % 3 == 0, 9).otherwise(1))
    parsed = exports.parse_metadata(table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), text.alias("value")))
    poses = exports.metadata_poses(parsed).groupBy("capture_id").agg(F.count("*").cast("int").alias("poses"), F.count_if(F.col("pose").isNull()).cast("int").alias("unusable"))
    return parsed.select("capture_id", "width", "depth_width", "fx", "cx").join(poses, "capture_id")


@query("export_intrinsics", "SELECT c_custkey AS capture_id, 256 AS width, round(abs(c_acctbal) * 256 / 1920, 6) AS fx, round(960.0::DOUBLE * 256 / 1920, 6) AS cx FROM customer")
def export_intrinsics(spark: SparkSession, sf: str) -> DataFrame:
    matrix = table(spark, sf, "customer").select(F.col("c_custkey").alias("capture_id"), F.abs("c_acctbal").alias("fx"), F.lit(1000.0).alias("fy"), F.lit(960.0).alias("cx"), F.lit(720.0).alias("cy"))
    sizes = matrix.select("capture_id", *[F.lit(v).alias(n) for n, v in (("depth_width", 256), ("depth_height", 192), ("rgb_width", 1920), ("rgb_height", 1440))])
    return exports.rescaled_intrinsics(matrix, sizes).select("capture_id", "width", F.round("fx", 6).alias("fx"), F.round("cx", 6).alias("cx"))


@query("sparse_observations", """SELECT o_custkey AS capture_id, o_orderkey AS image_id, round(o_totalprice / 1000, 2) AS ox, o_orderkey % 100 AS point_id FROM orders WHERE o_orderkey % 4 <> 0""")
def sparse_observations(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("o_orderkey") % 4 != 0, F.format_string("%.2f 5.0 %d 7.0 8.0 -1", F.round(F.col("o_totalprice") / 1000, 2), F.col("o_orderkey") % 100)).otherwise("")
    images = table(spark, sf, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("image_id"), line.alias("observations"))
    return sparse.observations(images).select("capture_id", "image_id", F.round("ox", 2).alias("ox"), "point_id")


# Image lists as text: each order is a header line and its observations, with comments, blank observations and blank noise between; a
# capture's file comes in pieces.
@query("sparse_images", """SELECT o_custkey % 40 AS capture_id, o_orderkey::INTEGER AS image_id, (o_orderkey % 5)::INTEGER AS camera_id,
 concat(CASE WHEN o_orderkey % 23 = 0 THEN '../' ELSE '' END, 'im ', o_orderkey, '.jpg') AS filename, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('5 6 ', o_custkey) END AS observations,
 o_orderkey % 23 <> 0 AND o_orderkey % 17 <> 0 AS posed, CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 17 <> 0 THEN -o_orderkey::DOUBLE END AS x FROM orders""")
def sparse_images(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "orders").selectExpr("o_custkey % 40 AS capture_id", "cast(floor(o_orderkey / 700) AS bigint) AS split", "o_orderkey", """array(
        CASE WHEN o_orderkey % 7 = 0 THEN '# comment' END,
        concat(o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN ' 2 0 0 0 ' ELSE ' 1 0 0 0 ' END, o_orderkey, ' 0 0 ', o_orderkey % 5, CASE WHEN o_orderkey % 23 = 0 THEN ' ../im ' ELSE ' im ' END, o_orderkey, '.jpg'),
        CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat('5 6 ', o_custkey, ' ') END, CASE WHEN o_orderkey % 3 = 0 THEN '' END) AS t""")
    lines = parts.select("capture_id", "split", "o_orderkey", F.posexplode("t").alias("p", "line")).filter("line IS NOT NULL").select(
        "capture_id", "split", (F.col("o_orderkey") * 4 + F.col("p")).alias("row"), "line")
    found = sparse.images(lines)
    return found.select("capture_id", "image_id", "camera_id", "filename", "observations", F.col("camera_to_world").isNotNull().alias("posed"),
                        F.round(F.col("camera_to_world")[3], 6).alias("x"))


@query("match_statistics", """SELECT l_suppkey AS capture_id, count(*) FILTER (WHERE l_quantity > 25) AS matched_pairs, coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 25), 0)::BIGINT AS inlier_matches FROM lineitem GROUP BY 1""")
def match_statistics(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_partkey").alias("image_id"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0).cast("long").alias("rows"))
    images = items.select("capture_id", "image_id").distinct().withColumn("name", F.concat("image_id", F.lit(".jpg")))
    return sparse.match_statistics(images, items, items)[1]


# A depth raster per supplier and line number: pixels are line items numbered into rows of ten.
RASTER = """(SELECT l_suppkey AS capture_id, l_linenumber AS frame_id, (row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) - 1) AS n,
 CASE WHEN l_linenumber = 3 AND l_partkey % 97 = 0 THEN -1 ELSE l_extendedprice / 10 END AS z FROM lineitem)"""


def raster(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.operators.ordering import positions
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_linenumber").alias("frame_id"), "l_orderkey", "l_partkey",
                                                F.when((F.col("l_linenumber") == 3) & (F.col("l_partkey") % 97 == 0), -1.0).otherwise(F.col("l_extendedprice") / 10).alias("z"))
    ranked = positions(items, ["capture_id", "frame_id"], ["l_orderkey", "l_partkey"], F.floor(F.col("l_orderkey") / 1000), "n")
    return ranked.select("capture_id", "frame_id", F.floor(F.col("n") / 10).cast("int").alias("row"), (F.col("n") % 10).cast("int").alias("col"), "z")


@query("depth_gate", f"""SELECT capture_id, frame_id, pixels, bad_pixels, valid_pixels, CASE WHEN frame_id = 5 THEN 'capture_failed' WHEN bad_pixels > 0 THEN 'invalid_depth' WHEN valid_pixels < 60 THEN 'sparse_depth' ELSE 'ok' END AS status FROM
 (SELECT capture_id * 8 + frame_id AS capture_id, frame_id, count(*) AS pixels, count(*) FILTER (WHERE z < 0) AS bad_pixels, count(*) FILTER (WHERE z / 1000 >= 0.15 AND z / 1000 <= 7.5) AS valid_pixels FROM {RASTER} r GROUP BY 1, 2) t""")
def depth_gate(spark: SparkSession, sf: str) -> DataFrame:
    # One capture per frame and one pixel per row, so each raster can be complete; every fifth one misses a row.
    samples = raster(spark, sf).select((F.col("capture_id") * 8 + F.col("frame_id")).alias("capture_id"), "frame_id",
                                       (F.col("row") * 10 + F.col("col")).alias("row"), F.lit(0).alias("col"), "z")
    calibration = samples.groupBy("capture_id").agg((F.count("*") + F.max((F.col("frame_id") == 5).cast("int"))).cast("int").alias("height")).select(
        "capture_id", F.lit(1).alias("width"), "height", F.lit(1000.0).alias("depth_scale"), F.lit(7.5).alias("depth_truncation"))
    return frame_ops.depth_status(samples, calibration, FrameConfig(min_valid_depth_pixels=60))


@query("posed_frames", f"""SELECT capture_id, frame_id, round(v, 6) AS x FROM (SELECT capture_id, frame_id, value / 1000 AS v, value FROM {FR.FRAMES} f WHERE event_type <> 'error') t WHERE value > 20""")
def posed_frames(spark: SparkSession, sf: str) -> DataFrame:
    base = FR.posed(spark, sf)
    frames = base.filter("event_type <> 'error'").select("capture_id", "frame_id", "seq")
    poses = base.filter("value > 20").select("capture_id", "frame_id", "pose")
    cameras = base.select("capture_id").distinct().withColumn("fx", F.lit(500.0))
    joined, _ = frame_ops.posed_frames(frames, poses, cameras)
    return joined.select("capture_id", "frame_id", F.round(F.col("pose")[3], 6).alias("x"))


@query("missing_pose_warnings", f"""SELECT capture_id, 'INVALID_RGBD_FRAME' AS code, 'Frame ' || frame_id || ' skipped: missing or invalid pose' AS message FROM {FR.FRAMES} f WHERE event_type <> 'error' AND value <= 20""")
def missing_pose_warnings(spark: SparkSession, sf: str) -> DataFrame:
    base = FR.posed(spark, sf)
    cameras = base.select("capture_id").distinct()
    return frame_ops.posed_frames(base.filter("event_type <> 'error'").select("capture_id", "frame_id"), base.filter("value > 20").select("capture_id", "frame_id", "pose"), cameras)[1]


@query("calibrated_frames", f"""SELECT capture_id, frame_id FROM {FR.FRAMES} f WHERE event_type <> 'error' AND value > 20 AND k % 2 = 0""")
def calibrated_frames(spark: SparkSession, sf: str) -> DataFrame:
    base = FR.posed(spark, sf)
    cameras = base.select("capture_id").distinct().withColumn("fx", F.lit(500.0))
    out = T.calibrated_frames(base.filter("event_type <> 'error'").select("capture_id", "frame_id"), base.filter("value > 20").select("capture_id", "frame_id", "pose"), cameras, base.filter("k % 2 = 0"))
    return out.select("capture_id", "frame_id")


@query("surviving_frames", f"""WITH s AS (SELECT capture_id, frame_id, value > 60 AS used FROM {FR.FRAMES} f), c AS (SELECT capture_id, count(*) FILTER (WHERE used) AS n FROM s GROUP BY 1)
 SELECT capture_id, frame_id FROM s JOIN c USING (capture_id) WHERE used AND n >= 20""")
def surviving_frames(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.plans import projections as P
    frames = P.frames(spark, sf)
    kept, _ = frame_ops.surviving_frames(frames.select("capture_id", "frame_id"), frames.filter("value > 60").select("capture_id", "frame_id"), ["capture_id"], 20)
    return kept


@query("structural_points", """SELECT l_suppkey AS capture_id, count(*) AS points FROM (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag = 'R' ELSE l_returnflag = 'A' END AS chosen FROM lineitem WHERE NOT (l_suppkey % 3 = 0 AND l_returnflag = 'A')) t WHERE chosen GROUP BY 1""")
def structural_points(spark: SparkSession, sf: str) -> DataFrame:
    variant = F.when(F.col("l_returnflag") == "A", "corrected").when(F.col("l_returnflag") == "R", "raw").otherwise("sparse")
    cloud = table(spark, sf, "lineitem").filter("NOT (l_suppkey % 3 = 0 AND l_returnflag = 'A')").select(
        F.col("l_suppkey").alias("capture_id"), variant.alias("variant"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"))
    return T.structural_points(cloud, ["capture_id"]).groupBy("capture_id").agg(F.count("*").alias("points"))


@query("usable_truth", "SELECT event_type AS tier, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def usable_truth(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(F.col("event_type").alias("tier"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("measured_value"), F.lit("1.0").alias("ground_truth_value"))
    return T.usable_truth(raw).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("measured_value"), 3).alias("total"))


@query("result_round_trip", f"SELECT capture_id, 1 AS rooms, round(o_totalprice / 10000, 6) AS total_floor_area, coalesce(d, 0) AS damages FROM {R.ROOM} a LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS d FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey")
def result_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "results")
    T.write_results(R.documents(spark, sf), path, check=False)
    out = ops.result_summary(T.read_result_lines(spark, path))
    return out.select("capture_id", "rooms", F.round("total_floor_area", 6).alias("total_floor_area"), "damages")


# Line items with the same keys are walls with one id; so are their openings and damage, which the room then lists twice, and openings with one id list the room again.
_WALLS = "(SELECT *, concat('c', l_orderkey) AS capture_id, concat('w:', l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) AS wall_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) w"
_TWICE = " UNION ALL ".join(f"SELECT capture_id, '{rule}' AS rule_id, {entity} AS entity_id FROM {_WALLS} WHERE {kind} GROUP BY capture_id, l_orderkey, wall_id HAVING count(*) > {n}" for rule, entity, kind, n in (
    ("duplicate_surface", "wall_id", "true", 1), ("duplicate_opening", "concat('o', wall_id)", "l_returnflag = 'R'", 1), ("duplicate_damage", "concat('d', wall_id)", "l_returnflag = 'A'", 1),
    ("duplicate_reference", "concat('r', l_orderkey, '/o', wall_id)", "l_returnflag = 'R'", 1), ("duplicate_reference", "concat('r', l_orderkey, '/d', wall_id)", "l_returnflag = 'A'", 1),
    ("opening_rooms_repeat", "concat('o', wall_id)", "l_returnflag = 'R'", 1), ("opening_room_limit", "concat('o', wall_id)", "l_returnflag = 'R'", 2)))


@query("document_violations", _TWICE)
def document_violations(spark: SparkSession, sf: str) -> DataFrame:
    from roomfold.operators.integrity import validate_documents
    return validate_documents(R.documents(spark, sf))


@query("measurement_csv", f"SELECT measurement_id, round(value, 6) AS value, unit, coalesce(surface_id, '') AS surface_id FROM {R.ROWS} r")
def measurement_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "measurements")
    T.write_measurements(ops.unpivot_results(R.documents(spark, sf)), path)
    rows = T.read_measurements(spark, path)
    return rows.select("measurement_id", F.round(F.col("value").cast("double"), 6).alias("value"), "unit", F.coalesce("surface_id", F.lit("")).alias("surface_id"))


@query("stage_overwrite", "SELECT o_custkey % 16 AS shard, count(*) AS n, round(sum(CASE WHEN o_custkey % 16 < 4 THEN 2 ELSE 1 END), 1)::DOUBLE AS marks FROM orders GROUP BY 1")
def stage_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "stage-table")
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 16).alias("shard"), "o_orderkey", F.lit(1.0).alias("mark"))
    T.write_stage(rows, path, "shard")
    T.write_stage(rows.filter("shard < 4").withColumn("mark", F.lit(2.0)), path, "shard")  # a rerun of some properties
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("mark"), 1).alias("marks"))


@query("room_documents", """SELECT l_suppkey AS room_id, count(*) AS walls, round(sum(l_quantity), 4) AS length FROM lineitem GROUP BY 1""")
def room_documents(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        F.lit(1).alias("property_id"), F.col("l_suppkey").alias("room_id"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("wall_id"), F.col("l_quantity").alias("length"),
        *[F.col(c).alias(n) for n, c in (("x0", "l_tax"), ("y0", "l_tax"), ("x1", "l_discount"), ("y1", "l_discount"))])
    rooms = items.select("property_id", "room_id").distinct().withColumn("has_ceiling", F.lit(True))
    # One document per room, of some hundred walls each; a second one would show as a second row.
    length = F.aggregate("walls", F.lit(0.0), lambda total, w: total + w["length"]["value"])
    return docs.room_document(items, rooms).select("room_id", F.size("walls").cast("long").alias("walls"), F.round(length, 4).alias("length"))


@query("status_warnings", """SELECT o_orderkey AS room_id, unnest(list_filter([CASE WHEN o_orderkey % 8 = 2 THEN 'LOW_PHOTO_COUNT' END, CASE WHEN o_orderkey % 3 > 0 THEN 'EXCESSIVE_BLUR' END, CASE WHEN o_orderkey % 5 > 2 AND o_orderstatus = 'O' THEN 'REDUNDANT_PHOTOS' END,
 CASE WHEN o_custkey % 4 = 2 AND o_orderstatus = 'F' THEN 'LOW_VIEW_COUNT' END, CASE WHEN o_custkey % 4 < o_orderkey % 8 AND o_orderstatus = 'F' THEN 'LOW_IMAGE_OVERLAP' END, CASE WHEN o_custkey % 4 < o_orderkey % 8 AND o_orderstatus <> 'F' THEN 'PARTIAL_SFM' END,
 CASE WHEN o_totalprice > 300000 THEN 'LEARNED_METRIC_SCALE' END], lambda x: x IS NOT NULL)) AS code FROM orders""")
def status_warnings(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("room_id"), F.when(F.col("o_orderstatus") == "F", "photo").otherwise("video").alias("tier"), (F.col("o_orderkey") % 8).alias("selected"), (F.col("o_orderkey") % 3).alias("blur_rejected"),
        F.when(F.col("o_orderstatus") == "O", F.greatest(F.lit(0), F.col("o_orderkey") % 5 - 2)).otherwise(0).alias("near_duplicates"), (F.col("o_custkey") % 4).alias("registered"), (F.col("o_totalprice") > 300000).alias("scale_resolved"))
    return status.warnings(facts, ["room_id"])


@query("room_failures", """SELECT o_custkey AS property_id, count(*) AS rooms_discovered, count(*) FILTER (WHERE o_orderstatus = 'O') AS rooms_successful, count(*) FILTER (WHERE o_orderstatus <> 'O') AS rooms_failed,
 round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS total_area FROM orders GROUP BY 1""")
def room_failures(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "F", "METRIC_SCALE_UNRESOLVED").when(F.col("o_orderstatus") == "P", "who knows")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("property_id"), F.when(stage.isNotNull(), status.failure_code(stage)).alias("error_code"), F.col("o_totalprice").alias("area"))
    return status.room_totals(rows, ["property_id"]).withColumn("total_area", F.round("total_area", 2))


@query("tier_routing", """SELECT o_orderkey AS capture_id, CASE o_orderstatus WHEN 'F' THEN 8 ELSE 12 END AS steps FROM orders""")
def tier_routing(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("o_orderstatus") == "F", "lidar").when(F.col("o_orderstatus") == "O", "photo").otherwise("video")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("capture_id"), tier.alias("tier"))
    return status.by_tier(rows, status.STAGES).select("capture_id", F.size("stages").alias("steps"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("capture_id"), F.col("vec_id").cast("string").alias("frame_id"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                                                 F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


@query("depth_prediction", "SELECT concat('', vec_id) AS frame_id, count(*) AS samples, round(sum(embedding[i + 1]::DOUBLE * 2 + 5), 3) AS total FROM embeddings, range(64) t(i) GROUP BY 1")
def depth_prediction(spark: SparkSession, sf: str) -> DataFrame:
    rows = hooks.predict_depth(images(spark, sf), lambda grey: grey * 2 + 5)
    return rows.groupBy("frame_id").agg(F.count("*").alias("samples"), F.round(F.sum("z"), 3).alias("total"))


@query("surface_prediction", "SELECT concat('', vec_id) AS frame_id, count(*) FILTER (WHERE embedding[i + 1] > 0) AS door_pixels FROM embeddings, range(64) t(i) GROUP BY 1")
def surface_prediction(spark: SparkSession, sf: str) -> DataFrame:
    rows = hooks.predict_surfaces(images(spark, sf), lambda grey: {"door": (grey > 0).astype(float), "wall": (grey <= 0).astype(float)})
    return rows.groupBy("frame_id").agg(F.count_if((F.col("kind") == "door") & (F.col("probability") > 0.5)).alias("door_pixels"))


@query("damage_prediction", "SELECT concat('', vec_id) AS frame_id, count(*) AS pixels FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0.1 GROUP BY 1")
def damage_prediction(spark: SparkSession, sf: str) -> DataFrame:
    rows = hooks.predict_damage(images(spark, sf), lambda grey: [("crack", grey > np.float32(0.1), 0.9)])
    return rows.filter("row IS NOT NULL").groupBy("frame_id").agg(F.count("*").alias("pixels"))
