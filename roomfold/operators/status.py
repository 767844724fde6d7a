"""Coded status and warning rows from counts and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Room failure codes by the stage that was reached.
STAGE_CODES = ["IMAGE_VALIDATION_FAILED", "INSUFFICIENT_PHOTO_OVERLAP", "DEPTH_ESTIMATION_FAILED", "METRIC_SCALE_UNRESOLVED",
               "POINT_CLOUD_FUSION_FAILED", "ORIENTATION_UNRESOLVED", "GEOMETRY_EXTRACTION_FAILED", "FLOORPLAN_RENDERING_FAILED"]


def rules() -> dict[str, tuple[list[str], Column]]:
    """Warning code -> (columns it needs, predicate)."""
    c = F.col
    return {
        "LOW_PHOTO_COUNT": (["selected"], c("selected") == 2),
        "EXCESSIVE_BLUR": (["blur_rejected"], c("blur_rejected") > 0),
        "LOW_LIGHT": (["dark_rejected"], c("dark_rejected") > 0),
        "REDUNDANT_PHOTOS": (["near_duplicates"], c("near_duplicates") > 0),
        "LOW_VIEW_COUNT": (["registered", "tier"], (c("tier") == "photo") & (c("registered") == 2)),
        "LOW_IMAGE_OVERLAP": (["registered", "selected", "tier"], (c("tier") == "photo") & (c("registered") < c("selected"))),
        "PARTIAL_SFM": (["registered", "selected", "tier"], (c("tier") == "video") & (c("registered") < c("selected"))),
        "LEARNED_METRIC_SCALE": (["scale_resolved", "tier"], c("tier").isin("photo", "video") & c("scale_resolved")),
        "NO_LOOP_CLOSURE": (["loops_accepted", "drift_correction"], c("drift_correction") & (c("loops_accepted") == 0)),
        "REJECTED_NEIGHBOR_ICP": (["neighbors_rejected", "drift_correction"], c("drift_correction") & (c("neighbors_rejected") > 0)),
        "CEILING_UNAVAILABLE": (["ceiling_height", "has_geometry"], c("has_geometry") & c("ceiling_height").isNull()),
        "POLYGON_UNAVAILABLE": (["floor_area", "has_geometry"], c("has_geometry") & c("floor_area").isNull()),
        "NO_CROSS_ROOM_MATCHES": (["rooms", "related_pairs"], (c("rooms") > 1) & (c("related_pairs") == 0)),
        "ROOM_SCALE_INCONSISTENCY": (["weak_rooms"], c("weak_rooms") > 0),
    }


def warnings(facts: DataFrame, keys: list[str]) -> DataFrame:
    """All codes whose columns the fact table has, in one pass."""
    usable = {code: test for code, (needs, test) in rules().items() if set(needs) <= set(facts.columns)}
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in usable.items()]))
    return facts.select(*keys, F.explode(codes).alias("code"))


def failure_code(stage: Column) -> Column:
    """Code of a failed room: the stage reached, or a general failure."""
    return F.when(stage.isin(STAGE_CODES), stage).otherwise("ROOM_RECONSTRUCTION_FAILED")


def room_totals(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Discovered, successful and failed rooms with the area of the successful ones (null when none has any)."""
    ok = F.col("error_code").isNull()
    return rooms.groupBy(*keys).agg(F.count("*").alias("rooms_discovered"), F.count_if(ok).alias("rooms_successful"),
                                    F.count_if(~ok).alias("rooms_failed"), F.sum(F.when(ok, F.col("area"))).alias("total_area"))


def by_tier(df: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """Stage list of every capture by its tier; captures of all tiers share the later stages."""
    lists = F.create_map(*[part for tier, names in stages.items() for part in (F.lit(tier), F.array(*[F.lit(n) for n in names]))])
    return df.withColumn("stages", F.try_element_at(lists, F.col("tier")))


# Stages per tier; openings, damage and confidence are common to all.
COMMON = ["openings", "damage", "confidence", "measurements"]
STAGES = {
    "lidar": ["keyframes", "fusion", "registration", "geometry", *COMMON],
    "photo": ["selection", "sparse", "depth", "scale", "fusion", "orientation", "geometry", "stitching", *COMMON],
    "video": ["keyframes", "sparse", "depth", "scale", "fusion", "registration", "orientation", "geometry", *COMMON],
}
