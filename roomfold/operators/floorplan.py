"""Data of a floor plan: positioned openings, gaps, solid runs, labels, validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import PlanConfig
from roomfold.functions.camera import segment_distance
from roomfold.functions.text import measurement_label
from roomfold.operators import polygons

NOT_POSITIONED = "OPENING_NOT_POSITIONED"


def _length() -> Column:
    return F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def locate_openings(openings: DataFrame, walls: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positioned openings, warnings for those that cannot be placed, errors for those past their wall."""
    hosts = walls.select(*keys, "wall_id", "x0", "y0", "x1", "y1")
    joined = openings.join(hosts, [*keys, "wall_id"], "left").withColumn("_len", _length())
    unknown = F.col("wall_id").isNull() | F.col("width").isNull() | F.col("position").isNull() | F.col("_len").isNull()
    beyond = ~unknown & ((F.col("width") <= 0) | (F.col("position") + F.col("width") > F.col("_len") + 1e-8))
    warnings = joined.filter(unknown).select(*keys, "opening_id", F.lit(NOT_POSITIONED).alias("code"))
    errors = joined.filter(beyond).select(*keys, "opening_id", F.lit("OPENING_BEYOND_WALL").alias("code"))
    ux, uy = (F.col("x1") - F.col("x0")) / F.col("_len"), (F.col("y1") - F.col("y0")) / F.col("_len")
    end = F.col("position") + F.col("width")
    placed = joined.filter(~unknown & ~beyond).select(
        *openings.columns, (F.col("x0") + ux * F.col("position")).alias("ax"), (F.col("y0") + uy * F.col("position")).alias("ay"),
        (F.col("x0") + ux * end).alias("bx"), (F.col("y0") + uy * end).alias("by"))
    return placed, warnings, errors


def wall_gaps(placed: DataFrame, opening_rooms: DataFrame, links: DataFrame, walls: DataFrame, keys: list[str],
              cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Gap of every opening on its host wall, on walls that list it, and on coincident shared-room walls.

    The either-or condition is three equality joins over opening and wall ids, deduplicated
    before any geometry is evaluated.
    """
    own = placed.select(*keys, "opening_id", "wall_id")
    linked = links.select(*keys, "opening_id", "wall_id")
    shared = opening_rooms.select(*keys, "opening_id", "room_id").distinct().join(
        walls.select(*keys, "room_id", "wall_id"), [*keys, "room_id"]).select(*keys, "opening_id", "wall_id")
    pairs = reduce(DataFrame.unionByName, [own, linked, shared]).distinct()
    segment = walls.select(*keys, "wall_id", "x0", "y0", "x1", "y1")
    spot = placed.select(*keys, "opening_id", "ax", "ay", "bx", "by")
    both = pairs.join(spot, [*keys, "opening_id"]).join(segment, [*keys, "wall_id"]).withColumn("_len", _length())
    ux, uy = (F.col("x1") - F.col("x0")) / F.col("_len"), (F.col("y1") - F.col("y0")) / F.col("_len")
    along = lambda x, y: (F.col(x) - F.col("x0")) * ux + (F.col(y) - F.col("y0")) * uy
    off = lambda x, y: F.abs((F.col(y) - F.col("y0")) * ux - (F.col(x) - F.col("x0")) * uy)
    near = both.filter(F.greatest(off("ax", "ay"), off("bx", "by")) <= cfg.tolerance)
    spans = near.withColumn("_a", along("ax", "ay")).withColumn("_b", along("bx", "by")) \
        .withColumn("lo", F.least("_a", "_b")).withColumn("hi", F.greatest("_a", "_b"))
    inside = spans.filter((F.col("lo") >= -cfg.tolerance) & (F.col("hi") <= F.col("_len") + cfg.tolerance))
    return inside.select(*keys, "wall_id", "opening_id", F.greatest(F.lit(0.0), "lo").alias("lo"),
                         F.least("_len", "hi").alias("hi"), F.col("_len").alias("length"))


def gap_overlaps(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps that start before an earlier one on the same wall ends."""
    order = Window.partitionBy(*keys, "wall_id").orderBy("lo", "hi")
    before = gaps.withColumn("previous_hi", F.lag("hi").over(order))
    return before.filter(F.col("lo") < F.col("previous_hi") - 1e-8)


def solid_runs(walls: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Wall pieces between gaps: each gap closes the run since the previous gap, the wall end closes the last."""
    ends = walls.select(*keys, "wall_id", _length().alias("lo"), _length().alias("hi"))
    stops = gaps.select(*keys, "wall_id", "lo", "hi").distinct().unionByName(ends)
    order = Window.partitionBy(*keys, "wall_id").orderBy("lo", "hi")
    runs = stops.withColumn("start", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    return runs.filter(F.col("lo") > F.col("start")).select(*keys, "wall_id", "start", F.col("lo").alias("end"))


def unique_dimensions(walls: DataFrame, keys: list[str]) -> DataFrame:
    """One dimension per distinct wall segment, whichever way it runs."""
    point = lambda x, y: F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    segment = F.array_sort(F.array(point("x0", "y0"), point("x1", "y1")))
    return walls.withColumn("segment", segment).groupBy(*keys, "segment").agg(F.min("wall_id").alias("wall_id"))


def scene_extent(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Origin, size and scale bar of every plan; the bar is a round length up to a third of the width."""
    box = polygons.bounds(F.col("ring"))
    size = rooms.select(*keys, *[v.alias(k) for k, v in box.items()]).groupBy(*keys).agg(
        F.min("min_x").alias("origin_x"), F.min("min_y").alias("origin_y"),
        (F.max("max_x") - F.min("min_x")).alias("width"), (F.max("max_y") - F.min("min_y")).alias("height"))
    return size.withColumn("scale_bar", scale_bar(F.col("width")))


def scale_bar(width: Column) -> Column:
    target = width / 3
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    steps = F.array(*[F.lit(v) for v in (0.1, 0.2, 0.5, 1.0, 2.0, 5.0)])
    return F.array_max(F.filter(F.transform(steps, lambda s: s * power), lambda v: v <= target))


def room_labels(rooms: DataFrame, keys: list[str], cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Name, area and ceiling lines at the room centroid."""
    cx, cy = polygons.centroid(F.col("ring"))
    none = F.lit(None).cast("double")
    area = measurement_label(F.col("area"), none, none, none, cfg.precision, "m²", cfg.show_confidence)
    height = F.concat(F.lit("Ceiling: "), measurement_label(F.col("ceiling"), none, none, none, cfg.precision, "m"))
    ceiling = F.when(F.col("ceiling").isNotNull(), height).otherwise("Ceiling: unavailable")
    name = F.coalesce("name", F.concat(F.lit("Room "), F.col("room_no").cast("string")))
    return rooms.select(*keys, "room_id", cx.alias("x"), cy.alias("y"),
                        F.concat_ws("\n", name, F.when(F.col("area").isNotNull(), area), ceiling).alias("text"))


def damage_markers(damages: DataFrame, walls: DataFrame, scene: DataFrame, keys: list[str]) -> DataFrame:
    """Marker position: along the host wall for wall damage, else the box centre in scene coordinates."""
    hosts = walls.select(*keys, F.col("wall_id").alias("surface_id"), "x0", "y0", "x1", "y1")
    joined = damages.join(scene.select(*keys, "origin_x", "origin_y"), keys).join(hosts, [*keys, "surface_id"], "left")
    u = (F.col("min_x") + F.col("max_x")) / 2
    v = (F.col("min_y") + F.col("max_y")) / 2
    length = _length()
    on_wall = F.col("x0").isNotNull()
    x = F.when(on_wall, F.col("x0") + (F.col("x1") - F.col("x0")) / length * u).otherwise(u) - F.col("origin_x")
    y = F.when(on_wall, F.col("y0") + (F.col("y1") - F.col("y0")) / length * u).otherwise(v) - F.col("origin_y")
    return joined.select(*keys, "damage_id", x.alias("x"), y.alias("y"))


def plan_primitives(walls: DataFrame, rooms: DataFrame, gaps: DataFrame, scene: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, gaps, dimensions, room labels and the scale bar as one table of typed rows."""
    def rows(df: DataFrame, kind: str, entity: str, a: Column, b: Column, text: Column | None = None) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), F.col(entity).cast("string").alias("entity_id"), a.alias("a"), b.alias("b"),
                         (text if text is not None else F.lit(None).cast("string")).alias("text"))
    runs = solid_runs(walls, gaps, keys)
    sized = unique_dimensions(walls, keys).join(walls.select(*keys, "wall_id", "x0", "y0", "x1", "y1"), [*keys, "wall_id"])
    none = F.lit(None).cast("double")
    return reduce(DataFrame.unionByName, [
        rows(runs, "wall", "wall_id", F.col("start"), F.col("end")),
        rows(gaps, "gap", "opening_id", F.col("lo"), F.col("hi")),
        rows(sized, "dimension", "wall_id", F.lit(0.0), _length(), measurement_label(_length(), none, none, none)),
        rows(room_labels(rooms, keys), "label", "room_id", F.col("x"), F.col("y"), F.col("text")),
        rows(scene.withColumn("_e", F.lit("scale")), "scale_bar", "_e", F.lit(0.0), F.col("scale_bar"))])


def plan_faults(rooms: DataFrame, walls: DataFrame, keys: list[str], cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Why a plan cannot be drawn: missing polygon or walls, degenerate walls, walls off the
    polygon, or boundary left uncovered.

    Walls meet the polygon edges of their own room; what they cover of an edge is merged
    as intervals.
    """
    room = [*keys, "room_id"]
    tol = cfg.tolerance
    no_ring = rooms.filter(F.col("ring").isNull() | (F.size("ring") < 3)).select(*room, F.lit("room_without_polygon").alias("fault"))
    no_walls = rooms.join(walls, room, "left_anti").select(*room, F.lit("room_without_walls").alias("fault"))
    short = walls.filter(_length() <= 1e-9).select(*room, F.lit("coincident_endpoints").alias("fault"))
    edges = polygons.edges(rooms.filter("ring IS NOT NULL"), room, "ring").select(
        *room, "edge_no", *[F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = walls.filter(_length() > 1e-9).join(edges, room)
    wall_length = _length()
    edge_length = F.hypot(F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0"))
    ex, ey = (F.col("ex1") - F.col("ex0")) / edge_length, (F.col("ey1") - F.col("ey0")) / edge_length
    wx, wy = (F.col("x1") - F.col("x0")) / wall_length, (F.col("y1") - F.col("y0")) / wall_length
    off = lambda x, y: F.abs((F.col(x) - F.col("ex0")) * ey - (F.col(y) - F.col("ey0")) * ex)
    along_edge = lambda x, y: (F.col(x) - F.col("ex0")) * ex + (F.col(y) - F.col("ey0")) * ey
    along_wall = lambda x, y: (F.col(x) - F.col("x0")) * wx + (F.col(y) - F.col("y0")) * wy
    aligned = pairs.filter(F.greatest(off("x0", "y0"), off("x1", "y1")) <= tol)
    shadow = aligned.select(*room, "wall_id", "edge_no", wall_length.alias("wall_length"), edge_length.alias("edge_length"),
                            F.least(along_edge("x0", "y0"), along_edge("x1", "y1")).alias("e_lo"),
                            F.greatest(along_edge("x0", "y0"), along_edge("x1", "y1")).alias("e_hi"),
                            F.least(along_wall("ex0", "ey0"), along_wall("ex1", "ey1")).alias("w_lo"),
                            F.greatest(along_wall("ex0", "ey0"), along_wall("ex1", "ey1")).alias("w_hi"))
    on_edge = uncovered(shadow, [*room, "wall_id"], "w_lo", "w_hi", "wall_length", tol)
    off_walls = walls.filter(_length() > 1e-9).join(
        shadow.select(*room, "wall_id").distinct().join(on_edge, [*room, "wall_id"], "left_anti"), [*room, "wall_id"], "left_anti")
    follows = off_walls.select(*room, F.lit("wall_off_polygon").alias("fault"))
    bare = uncovered(shadow, [*room, "edge_no"], "e_lo", "e_hi", "edge_length", tol)
    covered = shadow.select(*room, "edge_no").distinct().join(bare, [*room, "edge_no"], "left_anti")
    open_edges = edges.filter(edge_length > 2 * tol).join(covered, [*room, "edge_no"], "left_anti")
    has_walls = open_edges.join(walls.select(*room), room, "left_semi")
    gaps = has_walls.select(*room, F.lit("boundary_uncovered").alias("fault"))
    return reduce(DataFrame.unionByName, [no_ring, no_walls, short, follows, gaps]).distinct()


def uncovered(spans: DataFrame, keys: list[str], lo: str, hi: str, length: str, tolerance: float) -> DataFrame:
    """Keys whose intervals leave more than the tolerance of [0, length] open."""
    order = Window.partitionBy(*keys).orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("_before", F.greatest(F.lit(0.0), F.coalesce(F.max(hi).over(order), F.lit(0.0))))
    holes = reach.groupBy(*keys).agg(F.max(F.col(lo) - F.col("_before")).alias("_gap"), F.max(hi).alias("_end"),
                                     F.first(length).alias("_len"))
    return holes.filter((F.col("_gap") > 2 * tolerance) | (F.col("_end") < F.col("_len") - 2 * tolerance)).select(*keys)
