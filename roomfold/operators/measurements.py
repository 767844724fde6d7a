"""Measurement rows, calibration profiles and uncertainty intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roomfold.config import ConfidenceConfig
from roomfold.functions.scores import lower_bound
from roomfold.operators.quantiles import weighted_quantiles

# Interval multipliers (normal 95 % quantile and the MAD consistency factor).
NORMAL_95 = 1.96
MAD_TO_SIGMA = 1.4826


#: Dispersions and residuals that metadata may hold as text.
SPREADS = ("area_mad_m2", "width_mad_m", "height_mad_m", "residual_m", "surface_residual_m")


#: Per family of owners: measurement type and, if the id is not the owner's own, its suffix, in the order of the parts.
FAMILIES = {
    "property": [("total_floor_area", "total_floor_area"), *[(f"property_{side}", f"property_{side}") for side in ("length", "width", "height")]],
    "wall": [(f"wall_{part}", f"wall_{part}") for part in ("length", "height", "thickness", "orientation")],
    "floor": [("floor_area", None)],
    "ceiling": [("ceiling_height", "height"), ("ceiling_area", "area")],
    "opening": [(kind, kind) for kind in ("opening_width", "opening_height", "sill_height", "opening_position")],
    "damage": [(kind, kind) for kind in ("damage_area", "damage_length")],
    "scope": [("scope_quantity", "quantity")],
}
MEASURED = ("value", "unit", "lower_bound", "upper_bound", "confidence_level", "confidence_method")


def _owner(family: str, identifier: Column, room: Column, surface: Column, metadata: Column, *parts: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), identifier.alias("owner"), room.cast("string").alias("room_id"),
                    surface.cast("string").alias("surface_id"), metadata.alias("metadata"), F.array(*parts).alias("parts"))


def unpivot_results(documents: DataFrame) -> DataFrame:
    """One row per known measurement of every document.

    Owners of measurements are gathered in one array per document and exploded, then their
    values, so each document is read a single time and nothing is shuffled.
    """
    none = F.lit(None).cast("string")
    prop = F.col("property")
    own = F.array(_owner("property", F.lit("property"), none, none, prop["metadata"], prop["total_floor_area"],
                         *[prop["bounding_dimensions"][side] for side in ("length", "width", "height")]))

    def walls(room: Column) -> Column:
        return F.transform(room["walls"], lambda w: _owner(
            "wall", w["wall_id"], room["room_id"], w["wall_id"], w["metadata"], w["length"], w["height"], w["thickness"], w["orientation"]))

    def surfaces(room: Column) -> Column:
        floor, ceiling = room["floor"], room["ceiling"]
        return F.array(
            _owner("floor", floor["surface_id"], room["room_id"], floor["surface_id"], floor["metadata"], floor["area"]),
            _owner("ceiling", ceiling["surface_id"], room["room_id"], ceiling["surface_id"], ceiling["metadata"], ceiling["height"], ceiling["area"]))

    opening = lambda o: _owner("opening", o["opening_id"], F.get(o["room_ids"], F.lit(0)), o["wall_id"], o["metadata"],
                               o["width"], o["height"], o["sill_height"], o["position_along_wall"])
    damage = lambda d: _owner("damage", d["damage_id"], d["room_id"], d["surface_id"], d["metadata"], d["metric_area"], d["metric_length"])
    scope = lambda s: _owner("scope", s["line_item_id"], s["room_id"], s["surface_id"], s["metadata"], s["quantity"])
    empty = F.slice(own, 1, 0)
    owners = F.concat(
        own,
        F.coalesce(F.flatten(F.transform(prop["rooms"], lambda r: F.coalesce(walls(r), empty))), empty),
        F.coalesce(F.flatten(F.transform(prop["rooms"], surfaces)), empty),
        F.coalesce(F.transform(prop["openings"], opening), empty),
        F.coalesce(F.transform(F.col("damages"), damage), empty),
        F.coalesce(F.transform(F.col("scope_line_items"), scope), empty))
    held = documents.select(F.col("capture.capture_id").alias("capture_id"), F.col("capture.tier").alias("tier"), F.inline(owners))
    parts = held.select("*", F.posexplode("parts").alias("_at", "_part")).filter("_part.value IS NOT NULL")

    def named(index: int) -> Column:
        out = F.lit(None).cast("string")
        for family, kinds in FAMILIES.items():
            out = F.when(F.col("family") == family, F.get(F.array(*[F.lit(k[index]).cast("string") for k in kinds]), F.col("_at"))).otherwise(out)
        return out

    suffix = named(1)
    return parts.select(
        "capture_id", "tier", F.when(suffix.isNull(), F.col("owner")).otherwise(F.concat("owner", F.lit(":"), suffix)).alias("measurement_id"),
        "room_id", "surface_id", named(0).alias("measurement_type"), *[F.col("_part")[c].alias(c) for c in MEASURED],
        *[F.try_element_at("metadata", F.lit(key)).try_cast("double").alias(key) for key in SPREADS])


def calibration_profiles(truth: DataFrame, cfg: ConfidenceConfig = ConfidenceConfig(), tier: str = "tier",
                         kind: str = "measurement_type", width: float = 1.0) -> DataFrame:
    """Absolute-error quantile and row count per tier and measurement type.

    One (tier, type) pair may hold most rows, so the quantile uses counted values and
    value buckets instead of one buffer per pair.
    """
    errors = truth.withColumn("_error", F.abs(F.col("measured_value") - F.col("ground_truth_value")))
    out = weighted_quantiles(errors, [tier, kind], "_error", {"absolute_error": cfg.level}, width)
    return out.select(tier, kind, F.lit(cfg.level).alias("profile_level"), "absolute_error",
                      F.col("n").alias("benchmark_rows"))


def apply_confidence(measures: DataFrame, profiles: DataFrame | None,
                     cfg: ConfidenceConfig = ConfidenceConfig()) -> DataFrame:
    """Interval by precedence: profile, dispersion, residual, tier prior, unavailable.

    A row without any evidence keeps the bounds it came with. Angles stay at or below 360.
    """
    if profiles is None:
        joined = measures.withColumn("absolute_error", F.lit(None).cast("double")) \
            .withColumn("profile_level", F.lit(None).cast("double"))
    else:
        wanted = profiles.select("tier", "measurement_type", "absolute_error", "profile_level")
        # As large as the closed lists of tiers and types; merged, all rows of a type would meet in one task.
        joined = measures.join(F.broadcast(wanted), ["tier", "measurement_type"], "left")
    kind = F.col("measurement_type")
    mad = (F.when(kind.contains("area"), F.col("area_mad_m2"))
           .when(kind == "opening_width", F.col("width_mad_m")).otherwise(F.col("height_mad_m")))
    residual = F.coalesce(F.nullif(F.col("residual_m"), F.lit(0.0)), F.col("surface_residual_m"))
    prior = (F.when(F.col("tier") == "photo", cfg.photo_error).when(F.col("tier") == "video", cfg.video_error)
             .when(F.col("tier") == "lidar", cfg.lidar_error)) if cfg.allow_tier_prior else F.lit(None).cast("double")
    source = (F.when(F.col("absolute_error").isNotNull(), "benchmark_calibrated")
              .when(mad > 0, "multi_view_dispersion").when(residual > 0, "geometry_residual")
              .when(prior.isNotNull(), "tier_prior_uncalibrated").otherwise("unavailable"))
    half = (F.when(source == "benchmark_calibrated", F.col("absolute_error"))
            .when(source == "multi_view_dispersion", NORMAL_95 * MAD_TO_SIGMA * mad)
            .when(source == "geometry_residual", NORMAL_95 * residual)
            .when(source == "tier_prior_uncalibrated", F.col("value") * prior))
    level = F.when(source == "benchmark_calibrated", F.col("profile_level")).otherwise(F.lit(cfg.level))
    upper = F.col("value") + F.col("_half")
    upper = F.when(F.col("unit") == "degree", F.least(upper, F.lit(360.0))).otherwise(upper)
    known = F.col("_half").isNotNull()
    return (joined.withColumn("_source", source).withColumn("_half", half).withColumn("_level", level)
            .withColumn("lower_bound", F.when(known, lower_bound(F.col("value"), F.col("_half")))
                        .otherwise(F.col("lower_bound")))
            .withColumn("upper_bound", F.when(known, upper).otherwise(F.col("upper_bound")))
            .withColumn("confidence_level", F.when(known, F.col("_level")).otherwise(F.col("confidence_level")))
            .withColumn("confidence_method", F.col("_source"))
            .drop("_source", "_half", "_level", "absolute_error", "profile_level"))


def finalisation_warnings(measures: DataFrame, warnings: DataFrame) -> DataFrame:
    """One uncalibrated-interval warning per capture that has none yet."""
    code = "UNCALIBRATED_CONFIDENCE_INTERVALS"
    needed = (measures.filter("confidence_method = 'tier_prior_uncalibrated'").select("capture_id").distinct()
              .join(warnings.filter(F.col("code") == code).select("capture_id"), "capture_id", "left_anti"))
    return needed.select("capture_id", F.lit(code).alias("code"),
                         F.lit("Some intervals use tier priors because calibration or dispersion evidence is missing.")
                         .alias("message"))


def confidence_summary(measures: DataFrame) -> DataFrame:
    """Sorted set of methods used and whether estimation ran, per capture."""
    return measures.groupBy("capture_id").agg(
        F.array_sort(F.collect_set("confidence_method")).alias("methods"),
        F.bool_or(F.col("confidence_method") == "benchmark_calibrated").alias("profile_used"))


def add_module(modules: Column, name: str) -> Column:
    return F.array_distinct(F.concat(F.coalesce(modules, F.array().cast("array<string>")), F.array(F.lit(name))))


def result_summary(documents: DataFrame) -> DataFrame:
    """Headline counts of every document."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return documents.select(
        F.col("capture.capture_id").alias("capture_id"), size(F.col("property.rooms")).alias("rooms"),
        F.col("property.total_floor_area.value").alias("total_floor_area"),
        size(F.col("property.openings")).alias("openings"), size(F.col("damages")).alias("damages"),
        size(F.col("warnings")).alias("warnings"))


def room_summary(documents: DataFrame) -> DataFrame:
    """Counts of walls, openings and damage per room."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (documents.select(F.col("capture.capture_id").alias("capture_id"), F.explode("property.rooms").alias("r"))
            .select("capture_id", F.col("r.room_id").alias("room_id"), size(F.col("r.walls")).alias("walls"),
                    size(F.col("r.opening_ids")).alias("openings"), size(F.col("r.damage_ids")).alias("damages")))
