"""File listings: photo property discovery and path-level capture checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomfold.functions.text import room_label, slug

# Accepted file extensions.
PHOTO_SUFFIXES = ["jpg", "jpeg", "png", "heic"]
VIDEO_SUFFIXES = ["mp4", "mov"]


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths below ``root`` with size and lower-case suffix; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    # Reader paths carry a scheme; what follows the root is the relative path.
    return files.select("path", F.col("length").alias("bytes")).withColumn(
        "relative", F.substring_index(F.col("path"), base, -1)).withColumn(
        "suffix", F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1)))


def photo_rooms(files: DataFrame, keys: list[str], path: str = "relative") -> DataFrame:
    """Photos with their room: direct images make one room of a property, otherwise each visible folder is one.

    ``keys`` identify the property; its name labels the single room of a flat property.
    """
    photos = files.filter(F.col("suffix").isin(PHOTO_SUFFIXES))
    top = F.split_part(F.col(path), F.lit("/"), F.lit(1))
    seen = photos.withColumn("_depth", F.size(F.split(path, "/"))).withColumn("_top", F.when(F.col("_depth") == 2, top)).filter(
        (F.col("_depth") == 1) | ((F.col("_depth") == 2) & ~F.col("_top").startswith(".")))
    flat = seen.groupBy(*keys).agg(F.bool_or(F.col("_depth") == 1).alias("_flat"))
    kept = seen.join(flat, keys).filter(~F.col("_flat") | (F.col("_depth") == 1))
    name = F.coalesce("_top", F.col(keys[-1]).cast("string"))
    return kept.select(*keys, name.alias("folder"), slug(name).alias("room_id"), room_label(name).alias("label"), path)


def repeated_rooms(rooms: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Folders whose names collapse to one room id."""
    return rooms.groupBy(*keys, "room_id").agg(F.count_distinct("folder").alias("folders")).filter("folders > 1")


def capture_issues(files: DataFrame, captures: DataFrame) -> DataFrame:
    """Path-level problems of declared captures.

    ``captures``: capture_id, tier; ``files``: capture_id, relative, suffix, bytes.
    """
    top = F.size(F.split("relative", "/")) == 1
    visible = ~F.regexp_like(F.col("relative"), F.lit(r"(^|/)\."))
    facts = files.groupBy("capture_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("suffix").isin(PHOTO_SUFFIXES) & top).alias("photos"),
        F.count_if(F.col("suffix").isin(PHOTO_SUFFIXES) & ~top).alias("room_photos"),
        F.count_if(F.col("suffix").isin(VIDEO_SUFFIXES)).alias("videos"), F.count_if(visible & (F.col("bytes") > 0)).alias("visible"))
    joined = captures.join(facts, "capture_id", "left").fillna(0, ["files", "photos", "room_photos", "videos", "visible"])
    tier = F.col("tier")
    # Rooms in folders are counted room by room later; only flat photo sets are limited here.
    code = (F.when(F.col("files") == 0, "CAPTURE_NOT_FOUND")
            .when((tier == "photo") & (F.col("room_photos") == 0) & ~F.col("photos").between(2, 8), "PHOTO_COUNT_2_8")
            .when((tier == "video") & ((F.col("videos") != 1) | (F.col("files") != 1)), "VIDEO_NOT_MP4_MOV")
            .when((tier == "lidar") & (F.col("visible") == 0), "LIDAR_EMPTY"))
    return joined.withColumn("code", code).filter("code IS NOT NULL").select("capture_id", "tier", "code")
