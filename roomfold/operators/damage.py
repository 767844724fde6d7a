"""Visible damage: association with surfaces, fusion across views, repair scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import DamageConfig
from roomfold.functions.camera import wall_local
from roomfold.functions.scores import damage_quality
from roomfold.operators.clouds import convex_hulls
from roomfold.operators.folds import leader_members
from roomfold.operators.ordering import best_per_group

# Repair actions per damage type, in order.
ACTIONS = {
    "crack": [("inspect_crack", "Inspect crack and substrate"), ("repair_crack", "Fill and finish the affected section"),
              ("repaint", "Prepare and repaint affected surface")],
    "water_damage": [("inspect_moisture_source", "Inspect and correct the moisture source"),
                     ("repair_finish", "Remove damaged finish where required and repair surface"),
                     ("refinish", "Repaint or refinish affected surface")],
    "moisture_stain": [("inspect_moisture_source", "Inspect possible moisture source"),
                       ("prepare_surface", "Clean and prepare stained finish"), ("repaint", "Repaint affected surface")],
    "mold": [("inspect_moisture_source", "Inspect underlying moisture source"), ("remediate", "Treat and clean affected finish")],
    "hole": [("patch", "Patch damaged surface"), ("finish", "Finish and repaint patch")],
    "peeling_paint": [("remove_loose_coating", "Remove loose coating"), ("prepare_surface", "Prepare affected surface"),
                      ("repaint", "Repaint affected area")],
    "surface_damage": [("inspect", "Inspect affected surface"), ("repair_finish", "Repair and refinish affected surface")],
    "unknown": [("inspect", "Inspect unclassified visible surface condition")],
}

# Concealed-risk rules (flag suffix, rule id, description).
WATER_RULE = ("moisture", "RULE_WATER_STAIN_CONCEALED_MOISTURE",
              "Visible water or moisture staining may indicate concealed moisture behind the finish.")
MOLD_RULE = ("source", "RULE_MOLD_MOISTURE_SOURCE", "Visible mold may indicate an underlying moisture source.")
RULES = {"water_damage": WATER_RULE, "moisture_stain": WATER_RULE, "mold": MOLD_RULE}


def gate(candidates: DataFrame, samples: DataFrame, cfg: DamageConfig = DamageConfig()) -> tuple[DataFrame, DataFrame]:
    """Candidates with enough score, pixels and 3-D points; missing depth is warned about."""
    strong = candidates.filter((F.col("score") >= cfg.min_score) & (F.col("pixels") >= cfg.min_pixel_area))
    counts = samples.groupBy("candidate_id").agg(F.count("*").alias("_n"))
    sized = strong.join(counts, "candidate_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    kept = sized.filter(F.col("_n") >= cfg.min_points).drop("_n")
    return kept, warn(sized.filter(F.col("_n") < cfg.min_points), "DAMAGE_DEPTH_UNAVAILABLE")


def warn(candidates: DataFrame, code: str) -> DataFrame:
    return candidates.select("candidate_id", F.lit(code).alias("code"))


def associate_surfaces(points: DataFrame, surfaces: DataFrame, room_keys: list[str],
                       cfg: DamageConfig = DamageConfig()) -> DataFrame:
    """Surface coordinates of the points of every candidate on its nearest surface.

    Surfaces are walls (kind ``wall`` with both ends), floors and ceilings (with height) of
    the candidate's room. The surface with the least median distance wins, and only within
    the limit; a wall's median uses the points inside its span.
    """
    joined = points.join(surfaces, room_keys)
    u, d, length = wall_local(F.col("wx"), F.col("wy"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    wall = F.col("kind") == "wall"
    limit = cfg.surface_distance
    dist = F.when(wall, d).when(F.col("kind") == "floor", F.abs("wz")).otherwise(F.abs(F.col("wz") - F.col("height")))
    spot = joined.select(
        "candidate_id", "surface_id", "surface_order", dist.alias("distance"), F.when(wall, u).otherwise(F.col("wx")).alias("su"),
        F.when(wall, F.col("wz")).otherwise(F.col("wy")).alias("sv"),
        (~wall | ((length >= 1e-8) & (u >= -limit) & (u <= length + limit))).alias("_in")).filter("_in")
    medians = spot.groupBy("candidate_id", "surface_id", "surface_order").agg(F.median("distance").alias("residual"))
    best = best_per_group(medians, ["candidate_id"], [F.col("residual"), F.col("surface_order")]).filter(F.col("residual") <= limit)
    return spot.drop("_in", "surface_order", "distance").join(best.drop("surface_order"), ["candidate_id", "surface_id"])


def _limits(spots: DataFrame, cfg: DamageConfig) -> DataFrame:
    """Quantile limits and median centre; a candidate is one mask in one image, so groups are bounded."""
    ends = F.array(F.lit(cfg.low), F.lit(cfg.high))
    return spots.groupBy("candidate_id").agg(
        F.percentile("su", ends).alias("_us"), F.percentile("sv", ends).alias("_vs"),
        F.median("su").alias("center_u"), F.median("sv").alias("center_v"), F.count("*").alias("points"))


def candidate_lengths(spots: DataFrame, cfg: DamageConfig = DamageConfig()) -> DataFrame:
    """Median centre and length along the principal direction about it."""
    held = spots.join(_limits(spots, cfg), "candidate_id")
    du, dv = F.col("su") - F.col("center_u"), F.col("sv") - F.col("center_v")
    axis = held.groupBy("candidate_id").agg(
        (0.5 * F.atan2(2 * F.sum(du * dv), F.sum(du * du) - F.sum(dv * dv))).alias("_angle"))
    along = held.join(axis, "candidate_id").withColumn("_t", du * F.cos("_angle") + dv * F.sin("_angle"))
    return along.groupBy("candidate_id").agg(
        F.first("center_u").alias("center_u"), F.first("center_v").alias("center_v"), F.first("points").alias("points"),
        F.when(F.count("*") >= 2, F.max("_t") - F.min("_t")).alias("length"))


def candidate_hulls(spots: DataFrame, cfg: DamageConfig = DamageConfig()) -> DataFrame:
    """Hull of the points inside the quantile limits; slivers have none."""
    held = spots.join(_limits(spots, cfg), "candidate_id")
    clipped = held.filter(F.col("su").between(F.col("_us")[0], F.col("_us")[1]) & F.col("sv").between(F.col("_vs")[0], F.col("_vs")[1]))
    return convex_hulls(clipped.select("candidate_id", "su", "sv"), ["candidate_id"], "su", "sv").filter("hull_area > 1e-6")


def candidate_extents(spots: DataFrame, cfg: DamageConfig = DamageConfig()) -> DataFrame:
    """Centre, length, hull area and ring of every candidate."""
    return candidate_lengths(spots, cfg).join(candidate_hulls(spots, cfg), "candidate_id", "left")


def cluster(candidates: DataFrame, keys: list[str], cfg: DamageConfig = DamageConfig(), block_rows: int = 50_000) -> DataFrame:
    """First-fit groups per (surface, type): distance to the first member's centre, in candidate order."""
    group_keys = [*keys, "surface_id", "damage_type"]
    slotted = candidates.withColumn("_slot", F.floor(F.col("ordinal") / 4096))
    return leader_members(slotted, group_keys, ["center_u", "center_v"], ["ordinal"], cfg.merge_distance, "_slot", block_rows).drop("_slot")


def fuse(members: DataFrame, keys: list[str], cfg: DamageConfig = DamageConfig()) -> DataFrame:
    """Damage regions seen from enough frames, with median measures and dispersion."""
    group = [*keys, "surface_id", "damage_type", "group_no"]
    base = members.groupBy(*group).agg(
        F.median("hull_area").alias("area"), F.median("length").alias("_length"), F.median("score").alias("semantic"),
        F.median("residual").alias("residual"), F.min("ordinal").alias("_first"))
    views = members.select(*group, "frame_id").distinct().groupBy(*group).agg(F.count("*").alias("views"))
    area_mad = members.join(base.select(*group, "area"), group).groupBy(*group).agg(
        F.median(F.abs(F.col("hull_area") - F.col("area"))).alias("area_mad"))
    order = Window.partitionBy(*keys).orderBy("_first")
    ranked = base.withColumn("_index", F.row_number().over(order))
    out = ranked.join(views, group).join(area_mad, group).filter(F.col("views") >= cfg.min_views)
    quality = damage_quality(F.col("semantic"), F.col("residual"), F.col("views"), cfg.surface_distance)
    return (out.withColumn("damage_id", F.format_string("damage_%03d", F.col("_index"))).withColumn("quality", quality)
            .withColumn("length", F.when(F.col("damage_type") == "crack", F.col("_length"))).drop("_first", "_length", "_index"))


def first_outline(members: DataFrame, keys: list[str]) -> DataFrame:
    """Ring of the earliest member of a group that has a valid hull."""
    group = [*keys, "surface_id", "damage_type", "group_no"]
    return best_per_group(members.filter("hull_area IS NOT NULL"), group, [F.col("ordinal")]).select(*group, "ring")


def _lookup(table: dict[str, Column]) -> Column:
    return F.create_map(*[part for name, value in table.items() for part in (F.lit(name), value)])


def scope_items(regions: DataFrame) -> DataFrame:
    """Numbered repair actions per region; quantity is area when known, else length.

    The action list is a literal map, so there is no join.
    """
    actions = {name: F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("description")) for a, d in rows])
               for name, rows in ACTIONS.items()}
    listed = F.try_element_at(_lookup(actions), F.coalesce(F.col("damage_type"), F.lit("unknown")))
    rows = regions.select("*", F.posexplode(listed).alias("_n", "_a"))
    return rows.select(
        *[c for c in regions.columns if c not in ("area", "length")],
        F.concat_ws(":", F.lit("scope"), F.col("damage_id"), (F.col("_n") + 1).cast("string")).alias("line_item_id"),
        F.col("_a.action").alias("action"), F.col("_a.description").alias("description"),
        F.coalesce("area", "length").alias("quantity"),
        F.when(F.col("area").isNotNull(), "m2").when(F.col("length").isNotNull(), "m").alias("unit"))


def concealed_flags(regions: DataFrame) -> DataFrame:
    """Concealed-moisture suspicions from the water and mold rules."""
    rules = _lookup({name: F.struct(F.lit(s).alias("suffix"), F.lit(r).alias("rule_id"), F.lit(d).alias("rule_description"))
                     for name, (s, r, d) in RULES.items()})
    hit = regions.withColumn("_r", F.try_element_at(rules, F.col("damage_type"))).filter("_r IS NOT NULL")
    return hit.select(
        *[c for c in regions.columns if c not in ("area", "length", "damage_type")],
        F.concat_ws(":", F.lit("flag"), "damage_id", "_r.suffix").alias("flag_id"),
        F.lit("water_damage").alias("suspected_damage_type"), "_r.rule_id", "_r.rule_description",
        F.array("damage_id").alias("evidence"))
