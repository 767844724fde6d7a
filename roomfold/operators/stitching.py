"""Property layouts: placement, overlaps, totals, verdicts and fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roomfold.config import StitchConfig
from roomfold.functions import rigid
from roomfold.operators import footprint, graph, polygons
from roomfold.session import grown

KEY = graph.KEY


def place_rooms(rooms: DataFrame, transforms: DataFrame, ring: str = "ring") -> DataFrame:
    """Rooms moved into the property frame; measurements are left as they are."""
    joined = rooms.join(transforms.select(KEY, "room_id", "pose").hint("merge"), [KEY, "room_id"])
    return joined.withColumn(ring, polygons.move_ring(F.col("pose"), F.col(ring)))


def place_walls(walls: DataFrame, transforms: DataFrame) -> DataFrame:
    """Wall ends moved and orientation turned by the room's yaw, modulo 360."""
    joined = walls.join(transforms.select(KEY, "room_id", "pose"), [KEY, "room_id"])
    yaw = F.degrees(rigid.se2_components(F.col("pose"))[2])
    x0, y0 = rigid.move_xy(F.col("pose"), F.col("x0"), F.col("y0"))
    x1, y1 = rigid.move_xy(F.col("pose"), F.col("x1"), F.col("y1"))
    turned = F.pmod(F.col("orientation") + yaw, F.lit(360.0))
    rest = [c for c in walls.columns if c not in ("x0", "y0", "x1", "y1", "orientation")]
    return joined.select(*rest, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), turned.alias("orientation"))


def overlaps(placed: DataFrame, cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Overlap of placed rooms that meet; material only when area *and* ratio exceed limits."""
    pairs = polygons.near_pairs(placed, [KEY], "room_id", "ring")
    measured = pairs.withColumn("_m", polygons.pair_measures("ring", "b_ring"))
    ratio = F.col("_m.overlap_area") / F.least(polygons.area(F.col("ring")), polygons.area(F.col("b_ring")))
    return measured.select(
        KEY, "room_id", "b_room_id", F.col("_m.overlap_area").alias("overlap_area"), ratio.alias("overlap_ratio"),
        F.col("_m.shared_length").alias("shared_length"),
        ((F.col("_m.overlap_area") > cfg.max_overlap_area) & (ratio > cfg.max_overlap_ratio)).alias("material"))


def footprint_parts(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of separate footprint parts: rooms are joined by shared area or shared boundary."""
    touching = pairs.filter("overlap_area > 1e-9 OR shared_length > 1e-9").select(
        KEY, F.col("room_id").alias("room_a"), F.col("b_room_id").alias("room_b"))
    parts = graph.components(placed, touching)
    return parts.groupBy(KEY).agg(F.count_distinct("component").alias("footprint_parts"))


def boundary_distances(retained: DataFrame, placed: DataFrame) -> DataFrame:
    """Distance between the boundaries of the two rooms of every retained edge."""
    ring = lambda side, name: placed.select(KEY, F.col("room_id").alias(side), F.col("ring").alias(name)).hint("merge")
    both = retained.join(ring("room_a", "ring_a"), [KEY, "room_a"]).join(ring("room_b", "ring_b"), [KEY, "room_b"])
    return both.select(KEY, "connection_id", polygons.pair_gap("ring_a", "ring_b").alias("boundary_distance"))


def room_quality(rooms: DataFrame, retained: DataFrame) -> DataFrame:
    """Mean score of the retained edges of a placed room, one when it has none."""
    ends = retained.select(KEY, F.explode(F.array("room_a", "room_b")).alias("room_id"), "score")
    mean = ends.groupBy(KEY, "room_id").agg(F.avg("score").alias("quality"))
    return rooms.select(KEY, "room_id").join(mean, [KEY, "room_id"], "left").fillna({"quality": 1.0})


def property_totals(rooms: DataFrame, placed: DataFrame) -> DataFrame:
    """Sum of room areas (never the union), extents and placed / unplaced counts."""
    box = polygons.bounds(F.col("ring"))
    inside = placed.select(KEY, "area", *[v.alias(k) for k, v in box.items()]).groupBy(KEY).agg(
        F.count("*").alias("placed"), F.sum("area").alias("total_area"),
        (F.max("max_x") - F.min("min_x")).alias("length"), (F.max("max_y") - F.min("min_y")).alias("width"))
    return rooms.groupBy(KEY).agg(F.count("*").alias("rooms")).join(inside.hint("merge"), KEY, "left") \
        .withColumn("unplaced", F.col("rooms") - F.coalesce("placed", F.lit(0)))


def verdicts(facts: DataFrame, cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Layout validity and warning codes from one row of facts per property."""
    tests = {
        "WEAK_ROOM_CONNECTION": F.col("max_boundary_distance") > cfg.boundary_distance,
        "DISCONNECTED_ROOM_GRAPH": F.col("unplaced") > 0,
        "AMBIGUOUS_ROOM_CONNECTION": F.col("cycle_rejected") > 0,
        "EXCESSIVE_ROOM_OVERLAP": F.col("material_overlaps") > 0,
        "PROPERTY_LAYOUT_CONFLICT": F.col("material_overlaps") > 0,
        "PROPERTY_FOOTPRINT_DISCONNECTED": F.col("footprint_parts") > 1,
        "HIGH_CYCLE_CLOSURE_ERROR": F.col("cycle_error") > cfg.cycle_error,
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    valid = (F.col("unplaced") == 0) & (F.col("material_overlaps") == 0)
    return facts.withColumn("valid_layout", valid).withColumn("codes", codes)


def adopt_layout(verdict: DataFrame, local_area: DataFrame) -> DataFrame:
    """Stitched result where the layout is valid, else unstitched rooms and their area sum."""
    return verdict.join(local_area, KEY).select(
        KEY, F.when(F.col("valid_layout"), F.col("total_area")).otherwise(F.col("local_area")).alias("total_floor_area"),
        F.when(F.col("valid_layout"), "property_shared").otherwise("room_local_unstitched").alias("coordinate_scope"),
        "valid_layout")


def stitch(rooms: DataFrame, evidence: DataFrame, cfg: StitchConfig = StitchConfig(), outlined: bool = True) -> dict[str, DataFrame]:
    """Every table of a property layout, for all properties together; the verdict needs no outlines."""
    judged = grown(graph.screen_evidence(evidence, rooms, cfg))
    accepted = judged.filter("accepted")
    roots = grown(graph.choose_root(rooms, accepted))
    tree = grown(graph.spanning_edges(accepted))
    initial = grown(graph.layout(roots, tree))
    reach = lambda side: initial.select(KEY, F.col("room_id").alias(side))
    inside = accepted.join(reach("room_a"), [KEY, "room_a"], "left_semi").join(reach("room_b"), [KEY, "room_b"], "left_semi")
    checked = grown(graph.check_cycles(inside, tree, initial, cfg.cycle_error))
    retained = checked.filter("retained")
    poses = grown(graph.refine_layout(initial, retained, roots, cfg))
    placed = grown(place_rooms(rooms, poses))
    pairs = grown(overlaps(placed, cfg))
    totals = property_totals(rooms, placed)
    gaps = boundary_distances(retained, placed).groupBy(KEY).agg(F.max("boundary_distance").alias("max_boundary_distance"))
    cycles = checked.filter("NOT in_tree").groupBy(KEY).agg(
        F.count_if(~F.col("retained")).alias("cycle_rejected"), F.max("residual").alias("cycle_error"))
    material = pairs.groupBy(KEY).agg(
        F.count_if("material").alias("material_overlaps"), F.sum("overlap_area").alias("overlap_total"),
        F.max("overlap_area").alias("max_overlap"))
    residual = poses.groupBy(KEY).agg(F.max("rms").alias("layout_residual"))
    stacks = grown(footprint.slabs(placed, [KEY]))
    union = footprint.union_areas(placed, [KEY], stacks)
    facts = totals
    for part in (gaps, cycles, material, residual, union, footprint_parts(placed, pairs)):
        facts = facts.join(part.hint("merge"), KEY, "left")
    facts = facts.fillna({"cycle_rejected": 0, "cycle_error": 0.0, "material_overlaps": 0, "overlap_total": 0.0,
                          "max_overlap": 0.0, "footprint_parts": 0})
    rejected = judged.filter("NOT accepted").select(KEY, "connection_id", "rejection_reason").unionByName(
        checked.filter("NOT retained").select(KEY, "connection_id", F.lit("cycle_inconsistent").alias("rejection_reason")))
    tables = {"evidence": judged, "roots": roots, "tree": tree, "initial": initial, "checked": checked,
              "retained": retained, "rejected": rejected, "transforms": poses, "placed": placed, "overlaps": pairs,
              "verdict": verdicts(facts, cfg), "quality": room_quality(placed, retained)}
    return tables | {"footprints": footprint.footprints(placed, [KEY], stacks)} if outlined else tables
