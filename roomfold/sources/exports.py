"""Device exports: odometry CSV captures and metadata JSON captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.functions import rigid

# World Y-up to canonical Z-up, row-major.
Y_UP_TO_Z_UP = (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)

ODOMETRY = ["frame", "x", "y", "z", "qx", "qy", "qz", "qw"]
METADATA = "w int, h int, dw int, dh int, K array<double>, poses array<array<double>>, fps double"


def read_odometry(spark: SparkSession, path: str) -> DataFrame:
    """Camera rows per frame: blanks stripped, unusable frame ids skipped, a later repeat wins.

    A file belongs to the capture that its folder names, unless a column ``capture_id`` names one in each row; so files
    need not be as many as captures. The rows of a capture lie in one file. Column names are stripped too. ``_metadata`` row order inside a file is the block offset
    plus the position in it, so the last repeat is well defined.
    """
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    raw = raw.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)) \
        .withColumn("_at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    named = raw.select([F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    owner = F.trim("capture_id") if "capture_id" in named.columns else F.col("_folder")
    extra = [c for c in ("fx", "fy", "cx", "cy") if c in named.columns]
    typed = named.withColumn("frame", F.trim("frame").try_cast("int")).filter("frame IS NOT NULL")
    last = typed.groupBy(owner.alias("capture_id"), F.col("frame").alias("frame_id")).agg(
        F.max_by(F.struct(*[c for c in ODOMETRY[1:] + extra]), "_at").alias("r"))
    return last.select("capture_id", "frame_id", *[F.trim(f"r.{c}").try_cast("double").alias(c) for c in ODOMETRY[1:] + extra])


def read_camera_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Focal lengths and centre of a headerless 3x3 matrix file per capture."""
    whole = spark.read.text(path, wholetext=True)
    cells = F.filter(F.transform(F.split("value", "[,\\s]+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return whole.select(folder.alias("capture_id"), cells.alias("m")).select(
        "capture_id", F.col("m")[0].alias("fx"), F.col("m")[4].alias("fy"), F.col("m")[2].alias("cx"), F.col("m")[5].alias("cy"))


def odometry_poses(odometry: DataFrame, depth_frames: DataFrame) -> DataFrame:
    """Canonical poses of frames that have both odometry and depth."""
    both = odometry.join(depth_frames.select("capture_id", "frame_id"), ["capture_id", "frame_id"], "left_semi")
    turn = F.array(*[F.lit(v) for v in Y_UP_TO_Z_UP])
    c = F.col
    pose = rigid.quaternion_pose((c("qx"), c("qy"), c("qz"), c("qw")), (c("x"), c("y"), c("z")))
    return both.select("capture_id", "frame_id", rigid.compose(turn, pose).alias("pose"))


def rescaled_intrinsics(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Calibration at depth resolution; ``sizes`` has rgb and depth width and height."""
    sx, sy = F.col("depth_width") / F.col("rgb_width"), F.col("depth_height") / F.col("rgb_height")
    return matrix.join(sizes, "capture_id").select(
        "capture_id", F.col("depth_width").alias("width"), F.col("depth_height").alias("height"), (F.col("fx") * sx).alias("fx"),
        (F.col("fy") * sy).alias("fy"), (F.col("cx") * sx).alias("cx"), (F.col("cy") * sy).alias("cy"))


def parse_metadata(texts: DataFrame, column: str = "value") -> DataFrame:
    """Dimensions, calibration (stored column by column) and poses of metadata JSON texts."""
    parsed = texts.withColumn("_m", F.from_json(column, METADATA))
    k = F.col("_m.K")
    # The nine values are three columns: element 3 * col + row.
    return parsed.select("capture_id", F.col("_m.w").alias("width"), F.col("_m.h").alias("height"), F.col("_m.dw").alias("depth_width"),
                         F.col("_m.dh").alias("depth_height"), k[0].alias("fx"), k[4].alias("fy"), k[6].alias("cx"), k[7].alias("cy"), F.col("_m.poses").alias("poses"))


def metadata_poses(parsed: DataFrame) -> DataFrame:
    """One flipped pose per index; null where the seven values do not make one."""
    rows = parsed.select("capture_id", F.posexplode("poses").alias("frame_id", "v"))
    v = F.col("v")
    pose = rigid.quaternion_pose((v[0], v[1], v[2], v[3]), (v[4], v[5], v[6]), "flip")
    return rows.withColumn("pose", F.when((F.size("v") == 7) & F.forall("v", rigid.is_finite), pose)).drop("v")


def frames_without_pose(images: DataFrame, poses: DataFrame) -> DataFrame:
    """Image frames beyond the pose list or with an unusable pose."""
    good = poses.filter("pose IS NOT NULL").select("capture_id", "frame_id")
    return images.join(good, ["capture_id", "frame_id"], "left_anti")
