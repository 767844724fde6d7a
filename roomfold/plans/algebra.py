"""Queries over poses, calibrations, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roomfold.config import OpeningConfig
from roomfold.functions import camera, images, rigid, scores, text
from roomfold.plans import projections as P
from roomfold.plans.registry import query
from roomfold.plans.tables import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS = ", ".join(KEY)


def r6(value: Column, name: str) -> Column:
    """Rounded to six digits, with negative zero folded into zero."""
    return (F.round(value, 6) + 0.0).alias(name)


def s6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


# Quaternion of every line item, before normalisation.
QX, QY, QZ, QW = "l_discount", "l_tax", "l_quantity / 50", "0.5::DOUBLE"
UNIT = f"(SELECT *, {QX} / n AS x, {QY} / n AS y, {QZ} / n AS z, {QW} / n AS w FROM (SELECT *, sqrt({QX}*{QX}+{QY}*{QY}+{QZ}*{QZ}+0.25::DOUBLE) AS n FROM lineitem) a)"


def quaternion() -> tuple[Column, Column, Column, Column]:
    return F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.5)


def poses(spark: SparkSession, sf: str, variant: str = "plain") -> DataFrame:
    shift = (F.col("l_quantity") / 10, F.col("l_discount") * 7, F.col("l_tax") * 11)
    return lineitem(spark, sf).select(*KEY, "l_discount", "l_tax", "l_quantity",
                                      rigid.quaternion_pose(quaternion(), shift, variant).alias("pose"))


@query("pose_from_quaternion", f"""SELECT {KEYS}, {s6('1 - 2 * (y * y + z * z)', 'm00')}, {s6('2 * (x * y - z * w)', 'm01')},
 {s6('2 * (x * z + y * w)', 'm02')}, {s6('2 * (x * y + z * w)', 'm10')}, {s6('2 * (y * z + x * w)', 'm21')},
 {s6('1 - 2 * (x * x + y * y)', 'm22')}, {s6('l_quantity / 10', 'm03')} FROM {UNIT} u""")
def pose_from_quaternion(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("pose")
    return poses(spark, sf).select(*KEY, r6(m[0], "m00"), r6(m[1], "m01"), r6(m[2], "m02"), r6(m[4], "m10"),
                                   r6(m[9], "m21"), r6(m[10], "m22"), r6(m[3], "m03"))


@query("pose_from_quaternion_flipped", f"""SELECT {KEYS}, CASE WHEN ok THEN {s6('1 - 2 * (y * y + z * z)', 'm00')[:-7]} END AS m00,
 CASE WHEN ok THEN round(-2 * (x * y - z * w), 6) + 0.0::DOUBLE END AS m01, CASE WHEN ok THEN round(-(1 - 2 * (x * x + y * y)), 6) + 0.0::DOUBLE END AS m22
 FROM (SELECT *, n BETWEEN 0.5 AND 1.5 AS ok FROM {UNIT} v) u""")
def pose_flipped(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("pose")
    return poses(spark, sf, "flip").select(*KEY, r6(m[0], "m00"), r6(m[1], "m01"), r6(m[10], "m22"))


@query("pose_normalisation", f"""SELECT {KEYS}, {s6("-(CASE WHEN c THEN -(a01 * tx + a11 * ty + a21 * tz) ELSE ty END)", 'm03')},
 {s6("CASE WHEN c THEN -(a00 * tx + a10 * ty + a20 * tz) ELSE tx END", 'm13')}, {s6("CASE WHEN c THEN a20 ELSE a02 END", 'm12')}
 FROM (SELECT *, l_returnflag = 'R' AS c, l_quantity / 10 AS tx, l_discount * 7 AS ty, l_tax * 11 AS tz,
  1 - 2 * (y * y + z * z) AS a00, 2 * (x * y - z * w) AS a01, 2 * (x * z + y * w) AS a02, 2 * (x * y + z * w) AS a10,
  1 - 2 * (x * x + z * z) AS a11, 2 * (x * z - y * w) AS a20, 2 * (y * z + x * w) AS a21 FROM {UNIT} u) t""")
def pose_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    shift = (F.col("l_quantity") / 10, F.col("l_discount") * 7, F.col("l_tax") * 11)
    base = lineitem(spark, sf).withColumn("raw", rigid.quaternion_pose(quaternion(), shift))
    convention = F.when(F.col("l_returnflag") == "R", "world_to_camera").otherwise("camera_to_world")
    m = rigid.normalize_pose(F.col("raw"), convention, turn)
    return base.withColumn("m", m).select(*KEY, r6(F.col("m")[3], "m03"), r6(F.col("m")[7], "m13"), r6(F.col("m")[6], "m12"))


@query("rigid_pose_check", f"SELECT {KEYS}, l_discount < 0.0005 OR l_returnflag <> 'A' AS rigid FROM lineitem")
def rigid_pose_check(spark: SparkSession, sf: str) -> DataFrame:
    stretch = F.when(F.col("l_returnflag") == "A", 1.0 + F.col("l_discount")).otherwise(F.lit(1.0))
    base = lineitem(spark, sf)
    shift = (F.col("l_quantity") / 10, F.col("l_discount") * 7, F.col("l_tax") * 11)
    pose = F.transform(rigid.quaternion_pose(quaternion(), shift),
                       lambda v, i: F.when(i.isin(0, 1, 2, 4, 5, 6, 8, 9, 10), v * stretch).otherwise(v))
    return base.withColumn("m", pose).select(*KEY, rigid.is_rigid(F.col("m")).alias("rigid"))


@query("rotation_angle", f"SELECT {KEYS}, round(degrees(acos(greatest(-1, least(1, (4 * w * w - 2) / 2)))), 4) AS angle FROM {UNIT} u")
def rotation_angle(spark: SparkSession, sf: str) -> DataFrame:
    return poses(spark, sf).select(*KEY, F.round(rigid.rotation_degrees(F.col("pose")), 4).alias("angle"))


@query("intrinsics_rescale", f"""SELECT {KEYS}, {s6('l_extendedprice / 100 * (256.0::DOUBLE / 1920)', 'fx')},
 {s6('(l_quantity * 20 + 0.5::DOUBLE) / 3 - 0.5::DOUBLE', 'cx')},
 {s6('CASE WHEN l_quantity * 20 - 300 >= 0 AND l_quantity * 20 - 300 < 640 THEN l_quantity * 20 - 300 ELSE 320 END', 'cx_clamped')} FROM lineitem""")
def intrinsics_rescale(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("l_quantity") * 20
    return lineitem(spark, sf).select(*KEY, r6(F.col("l_extendedprice") / 100 * (256.0 / 1920), "fx"),
                                      r6(camera.strided_centre(c, 3), "cx"),
                                      r6(camera.clamped_centre(c - 300, F.lit(640)), "cx_clamped"))


@query("se2_algebra", f"""SELECT connection_id, {s6('dx + cos(a) * dy - sin(a) * dx', 'x')}, {s6('dy + sin(a) * dy + cos(a) * dx', 'y')},
 {s6('atan2(sin(2 * a), cos(2 * a))', 'yaw')}, {s6('-(cos(a) * dx + sin(a) * dy)', 'inv_x')} FROM
 (SELECT *, score * 3 AS a FROM {P.source('orders', P.EDGES)} e) t""")
def se2_algebra(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("score") * 3
    base = P.edges(spark, sf).withColumn("one", rigid.se2(F.col("dx"), F.col("dy"), a)) \
        .withColumn("two", rigid.se2(F.col("dy"), F.col("dx"), a))
    both = base.withColumn("both", rigid.compose(F.col("one"), F.col("two"), 3)) \
        .withColumn("inv", rigid.invert(F.col("one"), 3))
    x, y, yaw = rigid.se2_components(F.col("both"))
    return both.filter(rigid.is_se2(F.col("both"))).select(
        "connection_id", r6(x, "x"), r6(y, "y"), r6(yaw, "yaw"), r6(F.col("inv")[2], "inv_x"))


@query("back_projection", f"""SELECT {KEYS}, {s6('(1-2*(y*y+z*z))*cx + 2*(x*y-z*w)*cy + 2*(x*z+y*w)*d + l_quantity/10 + 1e-8', 'wx')},
 {s6('2*(x*y+z*w)*cx + (1-2*(x*x+z*z))*cy + 2*(y*z-x*w)*d + l_discount*7 + 1e-8', 'wy')},
 {s6('2*(x*z-y*w)*cx + 2*(y*z+x*w)*cy + (1-2*(x*x+y*y))*d + l_tax*11 + 1e-8', 'wz')} FROM
 (SELECT *, (l_partkey % 640 - 320.0::DOUBLE) / 500 * d AS cx, (l_suppkey % 480 - 240.0::DOUBLE) / 510 * d AS cy FROM
  (SELECT *, l_extendedprice / 20000 AS d FROM {UNIT} u) b) t""")
def back_projection(spark: SparkSession, sf: str) -> DataFrame:
    shift = (F.col("l_quantity") / 10, F.col("l_discount") * 7, F.col("l_tax") * 11)
    base = lineitem(spark, sf).withColumn("pose", rigid.quaternion_pose(quaternion(), shift))
    x, y, z = camera.backproject(F.col("l_partkey") % 640, F.col("l_suppkey") % 480, F.col("l_extendedprice") / 20000,
                                 F.lit(500.0), F.lit(510.0), F.lit(320.0), F.lit(240.0), F.col("pose"))
    return base.select(*KEY, r6(x + 1e-8, "wx"), r6(y + 1e-8, "wy"), r6(z + 1e-8, "wz"))


@query("forward_projection", f"""SELECT {KEYS}, round(500 * qx / qz + 320, 4) AS u, round(500 * qy / qz + 240, 4) AS v FROM (SELECT *,
 (1-2*(y*y+z*z))*dx + 2*(x*y+z*w)*dy + 2*(x*z-y*w)*dz AS qx, 2*(x*y-z*w)*dx + (1-2*(x*x+z*z))*dy + 2*(y*z+x*w)*dz AS qy,
 2*(x*z+y*w)*dx + 2*(y*z-x*w)*dy + (1-2*(x*x+y*y))*dz AS qz FROM (SELECT *, l_extendedprice / 20000 - l_quantity / 10 AS dx,
  1 - l_discount * 7 AS dy, 9 - l_tax * 11 AS dz FROM {UNIT} u) b) t WHERE qz > 0.01 AND 500 * qx / qz + 320 BETWEEN 5 AND 635""")
def forward_projection(spark: SparkSession, sf: str) -> DataFrame:
    shift = (F.col("l_quantity") / 10, F.col("l_discount") * 7, F.col("l_tax") * 11)
    base = lineitem(spark, sf).withColumn("pose", rigid.quaternion_pose(quaternion(), shift))
    q = camera.to_camera(F.col("pose"), F.col("l_extendedprice") / 20000, F.lit(1.0), F.lit(9.0))
    seen = base.select(*KEY, *[part.alias(name) for part, name in zip(q, ("qx", "qy", "qz"))]).filter("qz > 0.01")
    u, v = camera.project((F.col("qx"), F.col("qy"), F.col("qz")), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return seen.withColumn("u", u).withColumn("v", v).filter(F.col("u").between(5, 635)).select(
        *KEY, F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query("up_axis_rotation", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE axis WHEN 'x' THEN y_mm WHEN '-x' THEN y_mm ELSE x_mm END AS rx,
 CASE axis WHEN 'x' THEN z_mm WHEN '-x' THEN -z_mm WHEN 'y' THEN -z_mm WHEN '-y' THEN z_mm WHEN 'z' THEN y_mm ELSE -y_mm END AS ry,
 CASE axis WHEN 'x' THEN x_mm WHEN '-x' THEN -x_mm WHEN 'y' THEN y_mm WHEN '-y' THEN -y_mm WHEN 'z' THEN z_mm ELSE -z_mm END AS rz
 FROM (SELECT *, ['x', '-x', 'y', '-y', 'z', '-z'][capture_id % 6 + 1] AS axis FROM {P.source('lineitem', P.POINTS)} p) t""")
def up_axis_rotation(spark: SparkSession, sf: str) -> DataFrame:
    names = ["x", "-x", "y", "-y", "z", "-z"]
    out = [None, None, None]
    for i, axis in enumerate(names):
        moved = rigid.up_axis(axis, F.col("x_mm"), F.col("y_mm"), F.col("z_mm"))
        hit = F.col("capture_id") % 6 == i
        out = [F.when(hit, m) if o is None else o.when(hit, m) for o, m in zip(out, moved)]
    return P.points(spark, sf).select(*KEY, *[o.cast("long").alias(n) for o, n in zip(out, ("rx", "ry", "rz"))])


@query("wall_local_coordinates", f"""SELECT {KEYS}, {s6('(px - 1) * ux + (py - 2) * uy', 'u')}, {s6('abs((px - 1) * uy - (py - 2) * ux)', 'd')} FROM
 (SELECT *, l_quantity / 10 AS px, l_discount * 40 AS py, 3 / sqrt(9 + dy * dy) AS ux, dy / sqrt(9 + dy * dy) AS uy
  FROM (SELECT *, l_tax * 50 AS dy FROM lineitem) a) t""")
def wall_local_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    u, d, _ = camera.wall_local(F.col("l_quantity") / 10, F.col("l_discount") * 40, F.lit(1.0), F.lit(2.0),
                                F.lit(4.0), 2.0 + F.col("l_tax") * 50)
    return lineitem(spark, sf).select(*KEY, r6(u, "u"), r6(d, "d"))


@query("room_names", """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9_.-]+', '_', 'g'),
 '^[_.-]+|[_.-]+$', '', 'g'), ''), 'room') AS slug, array_to_string(list_transform(string_split(trim(regexp_replace(p_name, '[_-]+', ' ', 'g')), ' '),
 lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part""")
def room_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"),
                                           text.room_label(F.col("p_name")).alias("label"))


# Labels of parts: part of them are damage vocabulary, part only look like it.
LABEL = ("CASE p_type WHEN 'ECONOMY' THEN 'Wall__Crack' WHEN 'LARGE' THEN ' water  stain ' WHEN 'SMALL' THEN 'Mold' "
         "WHEN 'PROMO' THEN 'water bottle' WHEN 'MEDIUM' THEN 'hole in_wall' ELSE 'molding' END")


@query("damage_labels", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'crack' WHEN 'LARGE' THEN 'moisture_stain' WHEN 'SMALL' THEN 'mold'
 WHEN 'MEDIUM' THEN 'hole' ELSE 'unknown' END AS damage_type FROM part""")
def damage_labels(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "part").selectExpr("p_partkey", f"{LABEL} AS label")
    return labelled.select("p_partkey", text.damage_type(F.col("label")).alias("damage_type"))


@query("exif_fields", """SELECT event_id, event_type AS camera_make, cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS focal_length,
 CASE WHEN event_type = 'error' THEN cast(value AS VARCHAR) ELSE 'original' END AS "timestamp" FROM events""")
def exif_fields(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.map_filter(F.create_map(
        F.lit("Make"), F.col("event_type"), F.lit("FocalLength"), F.regexp_extract("props", "[0-9]+", 0),
        F.lit("DateTimeOriginal"), F.when(F.col("event_type") != "error", "original"),
        F.lit("DateTime"), F.col("value").cast("string")), lambda k, v: v.isNotNull())
    fields = text.exif_fields(F.col("exif"))
    return table(spark, sf, "events").withColumn("exif", tags).select(
        "event_id", *[fields[n].alias(n) for n in ("camera_make", "focal_length", "timestamp")])


# Every embedding read as an 8 x 8 grey image; indices mirror at the border without repeating it.
@query("image_statistics", """WITH p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE * 100 AS v FROM embeddings, range(64) t(i)),
 l AS (SELECT p.vec_id, p.v, a.v + b.v + d.v + e.v - 4 * p.v AS lap FROM p
  JOIN p a ON a.vec_id = p.vec_id AND a.c = p.c AND a.r = abs(p.r - 1)
  JOIN p b ON b.vec_id = p.vec_id AND b.c = p.c AND b.r = 7 - abs(6 - p.r)
  JOIN p d ON d.vec_id = p.vec_id AND d.r = p.r AND d.c = abs(p.c - 1)
  JOIN p e ON e.vec_id = p.vec_id AND e.r = p.r AND e.c = 7 - abs(6 - p.c))
 SELECT vec_id, round(var_pop(lap), 3) AS blur, round(avg(v), 4) AS brightness, round(stddev_pop(v), 4) AS contrast,
 NOT bool_or(v <> 0) AS all_zero FROM l GROUP BY 1""")
def image_statistics(spark: SparkSession, sf: str) -> DataFrame:
    grey = table(spark, sf, "embeddings").select("vec_id", F.transform(
        "embedding", lambda v: v.cast("double") * 100).alias("grey"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    stats = grey.withColumn("s", images.grey_statistics("grey", "height", "width"))
    return stats.select("vec_id", F.round("s.blur", 3).alias("blur"), F.round("s.brightness", 4).alias("brightness"),
                        F.round("s.contrast", 4).alias("contrast"), "s.all_zero")


@query("quality_blends", f"""SELECT {KEYS}, {s6("0.7 * greatest(0, 1 - d / 0.18) + 0.3 * least(1, n / 75.0::DOUBLE)", 'geometry')},
 {s6('''(0.45 * l_discount * 10 + 0.55 * (0.7 * greatest(0, 1 - d / 0.18) + 0.3 * least(1, n / 75.0::DOUBLE))) * CASE
 WHEN l_returnflag = 'A' AND v > 0.22 THEN 0.75 WHEN l_returnflag = 'R' AND v <= 0.22 THEN 0.5 ELSE 1 END''', 'opening')},
 {s6("least(1, 0.45 * l_discount * 10 + 0.3 * greatest(0, 1 - d / 0.18) + 0.25 * least(1, l_linenumber / 3.0::DOUBLE))", 'damage')},
 {s6("0.45 * least(1, n / 24.0::DOUBLE) * (n / greatest(70, 1)) + 0.55 * l_discount * 10", 'connection')},
 {s6("exp(-d / 0.025)", 'plane')}, {s6("1 / (1 + d / (v + 1))", 'scale')} FROM
 (SELECT *, l_tax * 2 AS d, l_quantity AS n, l_tax * 5 AS v FROM lineitem) t""")
def quality_blends(spark: SparkSession, sf: str) -> DataFrame:
    cfg = OpeningConfig()
    d, n, v, s = F.col("l_tax") * 2, F.col("l_quantity"), F.col("l_tax") * 5, F.col("l_discount") * 10
    kind = F.when(F.col("l_returnflag") == "A", "door").when(F.col("l_returnflag") == "R", "window").otherwise("unknown")
    geometry = scores.opening_geometry_score(d, n, cfg)
    return lineitem(spark, sf).select(
        *KEY, r6(geometry, "geometry"), r6(scores.opening_quality(kind, s, geometry, v, cfg), "opening"),
        r6(scores.damage_quality(s, d, F.col("l_linenumber"), 0.18), "damage"),
        r6(scores.connection_score(scores.visual_score(n, F.lit(70), 12), s), "connection"),
        r6(scores.plane_quality(d, 0.025), "plane"), r6(scores.scale_quality(d, v + 1), "scale"))


@query("measurement_labels", f"""SELECT {KEYS}, printf('%.2f m', l_quantity / 7) || CASE WHEN l_returnflag = 'N' THEN '' ELSE chr(10) ||
 CASE WHEN l_returnflag = 'A' THEN '95% CI' ELSE 'Bounds' END || ': ' || printf('%.2f–%.2f m', l_quantity / 7 - 0.1, l_quantity / 7 + 0.1) END AS label,
 CASE WHEN l_returnflag = 'N' THEN 'Unavailable' ELSE printf('%.3f–%.3f m', l_quantity / 7 - 0.1, l_quantity / 7 + 0.1) END AS interval_text FROM lineitem""")
def measurement_labels(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("l_quantity") / 7
    known = F.col("l_returnflag") != "N"
    lo, hi = F.when(known, value - 0.1), F.when(known, value + 0.1)
    level = F.when(F.col("l_returnflag") == "A", 0.95)
    return lineitem(spark, sf).select(*KEY, text.measurement_label(value, lo, hi, level).alias("label"),
                                      text.interval_text(lo, hi, F.lit("m")).alias("interval_text"))


@query("scaled_poses", f"SELECT {KEYS}, {s6('l_quantity / 10 * (1 + l_discount)', 'tx')}, {s6('1 - 2 * (y * y + z * z)', 'm00')} FROM {UNIT} u")
def scaled_poses(spark: SparkSession, sf: str) -> DataFrame:
    m = rigid.scale_translation(F.col("pose"), 1 + F.col("l_discount"))
    return poses(spark, sf).withColumn("m", m).select(*KEY, r6(F.col("m")[3], "tx"), r6(F.col("m")[0], "m00"))


@query("content_identity", """SELECT doc_id, sha256(text) AS digest FROM documents""")
def content_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.content_digest(F.col("text")).alias("digest"))


@query("capture_uuid", """SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 substr('89ab', instr('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1)
 || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS capture_uuid FROM
 (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('stray:' || url)) AS h FROM pages) t""")
def capture_uuid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.url_uuid(F.concat(F.lit("stray:"), "url")).alias("capture_uuid"))
