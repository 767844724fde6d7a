"""Doors, windows and passages: association with walls, clustering, fusion, linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roomfold.config import OpeningConfig
from roomfold.functions.camera import segment_distance, wall_local
from roomfold.functions.scores import opening_geometry_score, opening_quality
from roomfold.operators import masks
from roomfold.operators.folds import MARGIN, leader_groups, leader_spots
from roomfold.operators.ordering import best_per_group
from roomfold.session import cut

PHANTOM, UNRESOLVED = "POSSIBLE_PHANTOM_OPENING", "OPENING_DIMENSIONS_UNRESOLVED"


def associate_walls(points: DataFrame, walls: DataFrame, room_keys: list[str], cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Best wall per candidate by count / (1 + d / max), with robust extents on it.

    Points meet the walls of their own room only (at most the plane budget); the usable
    ones are counted per (candidate, wall). ``wall_order`` breaks ties.
    """
    joined = points.join(walls, room_keys)
    u, d, length = wall_local(F.col("wx"), F.col("wy"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    local = joined.withColumn("_u", u).withColumn("_d", d).withColumn("_len", length)
    usable = local.filter((F.col("_len") > 1e-6) & (F.col("_u") >= -cfg.endpoint_tolerance)
                          & (F.col("_u") <= F.col("_len") + cfg.endpoint_tolerance) & (F.col("_d") <= cfg.wall_distance))
    per = usable.groupBy("candidate_id", "wall_id", "wall_order").agg(
        F.count("*").alias("sample_count"), F.median("_d").alias("wall_distance"), F.first("_len").alias("wall_length"),
        F.percentile("_u", F.array(F.lit(cfg.low), F.lit(cfg.high))).alias("_us"),
        F.percentile("wz", F.array(F.lit(cfg.low), F.lit(cfg.high))).alias("_vs"))
    scored = per.filter(F.col("sample_count") >= cfg.min_points).withColumn(
        "_score", F.col("sample_count") / (1 + F.col("wall_distance") / cfg.wall_distance))
    best = best_per_group(scored, ["candidate_id"], [F.col("_score").desc(), F.col("wall_order")])
    zero = F.lit(0.0)
    return best.select(
        "candidate_id", "wall_id", "sample_count", "wall_distance", "wall_length",
        F.greatest(zero, F.col("_us")[0]).alias("u_min"), F.least(F.col("wall_length"), F.col("_us")[1]).alias("u_max"),
        F.greatest(zero, F.col("_vs")[0]).alias("v_min"), F.col("_vs")[1].alias("v_max"))


def judge_candidates(candidates: DataFrame, cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Scores and the first failing size test of candidates that have a wall."""
    c = F.col
    width, height, kind = c("u_max") - c("u_min"), c("v_max") - c("v_min"), c("kind")
    geometry = opening_geometry_score(c("wall_distance"), c("sample_count"), cfg)
    quality = opening_quality(kind, c("semantic_score"), geometry, c("v_min"), cfg)
    reason = (F.when((width <= 0) | (c("u_max") > c("wall_length") + 1e-8), "OPENING_EXCEEDS_WALL_BOUNDS")
              .when(height < cfg.min_height, UNRESOLVED)
              .when((kind == "door") & ~width.between(cfg.door_min_width, cfg.door_max_width), PHANTOM)
              .when((kind == "window") & ~width.between(cfg.window_min_width, cfg.window_max_width), PHANTOM)
              .when((kind == "window") & (c("v_min") <= cfg.floor_contact) & (quality < cfg.single_view_quality), PHANTOM))
    return (candidates.withColumn("geometry_score", geometry).withColumn("quality", quality)
            .withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull()))


def without_depth(all_candidates: DataFrame, samples: DataFrame, associated: DataFrame,
                  cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Candidates that never reached a wall, with the reason."""
    counts = samples.groupBy("candidate_id").agg(F.count("*").alias("_n"))
    lost = all_candidates.join(associated.select("candidate_id"), "candidate_id", "left_anti").join(counts, "candidate_id", "left")
    n = F.coalesce("_n", F.lit(0))
    return lost.select("candidate_id", n.alias("sample_count"), F.when(
        n < cfg.min_points, "OPENING_DEPTH_UNAVAILABLE").otherwise("OPENING_WALL_ASSOCIATION_FAILED").alias("rejection_reason"))


def cluster(candidates: DataFrame, keys: list[str], cfg: OpeningConfig = OpeningConfig(), block_rows: int = 50_000) -> DataFrame:
    """Candidates with group_no inside their wall; groups are met in (u_min, ordinal) order."""
    centred = candidates.withColumn("center", (F.col("u_min") + F.col("u_max")) / 2) \
        .withColumn("_slot", F.floor(F.col("u_min") / cfg.merge_distance))
    groups = leader_groups(centred, keys, ["center"], ["u_min", "ordinal"], cfg.merge_distance, "_slot", block_rows)
    return centred.join(groups.select(*keys, "center", "group_no"), [*keys, "center"]).drop("_slot")


def vote(members: DataFrame, group: list[str]) -> DataFrame:
    """Type with the highest summed score, first seen on ties; unknown below a 15 % margin."""
    sums = members.groupBy(*group, "kind").agg(F.sum("semantic_score").alias("_s"), F.min("ordinal").alias("_o"))
    ranked = sums.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), F.col("_o").alias("o"), "kind"))).alias("_r"),
        F.sum("_s").alias("_total"))  # at most four types per group
    first, second = F.col("_r")[0], F.get(F.col("_r"), F.lit(1))
    ambiguous = second.isNotNull() & ((second["s"] - first["s"]) < 0.15 * F.col("_total"))
    return ranked.select(*group, ambiguous.alias("ambiguous"), F.when(ambiguous, "unknown").otherwise(first["kind"]).alias("type"))


def fuse(members: DataFrame, group: list[str], cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Median extents, dispersion, supporting views and verdict per group.

    Two passes over the members: medians, then deviations from them. Groups without any
    image frame come from wall occupancy and are always accepted.
    """
    sized = members.withColumn("_w", F.col("u_max") - F.col("u_min")).withColumn("_h", F.col("v_max") - F.col("v_min"))
    medians = sized.groupBy(*group).agg(
        F.median("u_min").alias("position"), F.median("_w").alias("width"), F.median("v_min").alias("bottom"),
        F.median("_h").alias("height"), F.median("quality").alias("quality"), F.count("*").alias("members"))
    views = members.filter("frame_id IS NOT NULL").select(*group, "frame_id").distinct().groupBy(*group).agg(
        F.count("*").alias("views"))
    spread = sized.join(medians.select(*group, "width", "height"), group).groupBy(*group).agg(
        F.median(F.abs(F.col("_w") - F.col("width"))).alias("width_mad"),
        F.median(F.abs(F.col("_h") - F.col("height"))).alias("height_mad"))
    out = medians.join(spread, group).join(views, group, "left").join(vote(members, group), group).fillna({"views": 0})
    n = F.col("views")
    supported = (n >= cfg.min_views) | ((n == 1) & (F.col("quality") >= cfg.single_view_quality)) | (n == 0)
    loose = F.col("width_mad") > cfg.max_dispersion
    tall = F.col("height_mad") <= cfg.max_dispersion
    reason = (F.when(loose, "OPENING_MULTI_VIEW_INCONSISTENT").when(~supported, "OPENING_LOW_SUPPORT")
              .when(~tall, UNRESOLVED))
    return (out.withColumn("accepted", supported & ~loose).withColumn("reason", reason)
            .withColumn("reliable_height", F.when(tall & (F.col("height") >= cfg.min_height), F.col("height")))
            .withColumn("sill_height", F.when(F.col("type") == "window", F.col("bottom"))).drop("bottom"))


def number_openings(fused: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Stable opening ids numbered per property in (wall, position of first member) order."""
    firsts = members.groupBy(*keys, "wall_id", "group_no").agg(F.min(F.struct("u_min", "ordinal")).alias("_first"))
    numbered = firsts.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("wall_id", "_first")))
    label = F.format_string("detected:%s:%02d", F.col("wall_id").cast("string"), F.col("index"))
    return fused.join(numbered, [*keys, "wall_id", "group_no"]).withColumn("opening_id", label).drop("_first")


def keep_new_holes(holes: DataFrame, accepted: DataFrame, keys: list[str], cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Occupancy holes that no accepted candidate, nor an earlier kept hole, already covers.

    Range anti join on grid cells of the merge distance, then first-fit over the rest. Only distinct centres meet; of holes
    with one centre the earliest is kept.
    """
    cell = cfg.merge_distance
    wide = cell * MARGIN
    centre = lambda df: df.withColumn("center", (F.col("u_min") + F.col("u_max")) / 2)
    near = centre(accepted).select(*keys, F.col("center").alias("_c")).distinct().select(
        *keys, "_c", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_d")).withColumn("_cell", F.floor(F.col("_c") / wide) + F.col("_d")).drop("_d")
    left = centre(holes).groupBy(*keys, "center").agg(F.min("ordinal").alias("ordinal")).withColumn("_cell", F.floor(F.col("center") / wide))
    right = near.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_cell").alias("_rc"), "_c")
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    clash = (F.col("_cell") == F.col("_rc")) & (F.abs(F.col("center") - F.col("_c")) <= cell)
    for test in same:
        clash = clash & test
    fresh = left.join(right, clash, "left_anti").drop("_cell").withColumn("_slot", F.floor(F.col("ordinal") / 1024))
    opened = leader_spots(fresh, keys, ["center"], ["ordinal"], cell, "_slot").filter("opens").select(*keys, "center", F.col("_first.ordinal").alias("ordinal"))
    return centre(holes).join(opened, [*keys, "center", "ordinal"], "left_semi").drop("center")


def occupancy(points: DataFrame, walls: DataFrame, room_keys: list[str], cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Point counts per wall cell (wall, i, j), counted with partial aggregation."""
    joined = points.join(walls, room_keys)
    u, d, length = wall_local(F.col("wx"), F.col("wy"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    local = joined.select("wall_id", "ceiling", u.alias("_u"), d.alias("_d"), length.alias("wall_length"), F.col("wz").alias("_v"))
    keep = local.filter((F.col("wall_length") >= cfg.door_min_width * 2) & F.col("_u").between(0, F.col("wall_length"))
                        & F.col("_v").between(0, F.col("ceiling")) & (F.col("_d") <= cfg.wall_distance))
    return keep.groupBy("wall_id", "wall_length", "ceiling", F.floor(F.col("_u") / cfg.cell).cast("int").alias("i"),
                        F.floor(F.col("_v") / cfg.cell).cast("int").alias("j")).agg(F.count("*").alias("points"))


def occupancy_holes(cells: DataFrame, cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Bounded low-occupancy holes of every wall with enough points, labelled in raster order along the wall.

    A closed grid of occupied cells is turned into runs of empty ones, whose connected regions are the holes. Holes open to
    a border other than the floor are none. What surrounds a region that is whole can only be occupied, so its support
    is 1.
    """
    keys, one = ["wall_id"], cfg.cell
    count = lambda extent: (F.ceil((F.col(extent) + one) / one) - 1).cast("int")
    walls = cut(cells.groupBy("wall_id", "wall_length", "ceiling").agg(F.sum("points").alias("sample_count")).filter(
        F.col("sample_count") >= cfg.min_wall_points).withColumns({"height": count("wall_length"), "width": count("ceiling")}))
    sizes = walls.select("wall_id", "height", "width")
    at = lambda c, n: F.least(F.col(c), F.col(n) - 1)
    occupied = cells.join(sizes, keys).groupBy("wall_id", at("i", "height").alias("row"), at("j", "width").alias("col")).agg(
        F.sum("points").alias("_n")).filter(F.col("_n") >= cfg.min_cell_points).select("wall_id", "row", "col")
    full = masks.erode(masks.dilate(occupied, sizes, keys, 3, border=True), sizes, keys, 3)
    found = masks.regions(masks.gaps(masks.runs(full, keys), sizes, keys), keys, diagonal=False)
    boxes = found.groupBy("wall_id", "component").agg(
        F.min("row").alias("u0"), (F.max("row") + 1).alias("u1"), F.min("start").alias("v0"), F.max("stop").alias("v1")).join(walls, keys)
    width, height = (F.col("u1") - F.col("u0")) * one, (F.col("v1") - F.col("v0")) * one
    kept = boxes.filter((F.col("u0") > 0) & (F.col("u1") < F.col("height")) & (F.col("v1") < F.col("width"))
                        & (width >= cfg.door_min_width) & (height >= cfg.min_height) & F.lit(cfg.min_boundary_support <= 1))
    passage = (F.col("v0") * one <= cfg.floor_contact) & (height >= cfg.passage_height)
    return kept.select(
        "wall_id", F.col("component").cast("int").alias("label"), (F.col("u0") * one).alias("u_min"), F.least("wall_length", F.col("u1") * one).alias("u_max"),
        (F.col("v0") * one).alias("v_min"), F.least("ceiling", F.col("v1") * one).alias("v_max"), F.when(passage, "open_passage").otherwise("unknown").alias("kind"),
        F.lit(1.0).alias("support"), F.lit(0.55 + 0.35).alias("quality"), "sample_count")


def link_openings(openings: DataFrame, connections: DataFrame, edges: DataFrame, property_key: str = "property_id",
                  cfg: OpeningConfig = OpeningConfig()) -> DataFrame:
    """Connected room behind each opening: nearest boundary within tolerance, each connection used once.

    ``openings`` has room_id, mx, my (midpoint) and ordinal; ``edges`` are polygon edges per
    room. Distances are found by joins. In opening order, each takes the nearest connection within tolerance that is
    left; an opening without any keeps its row, unlinked.
    """
    p = property_key
    free = connections.filter("opening_id IS NULL")
    sides = free.select(p, "connection_id", "connection_order", F.col("room_a").alias("room_id"), F.col("room_b").alias("other")) \
        .unionByName(free.select(p, "connection_id", "connection_order", F.col("room_b").alias("room_id"), F.col("room_a").alias("other")))
    pairs = openings.join(sides, [p, "room_id"])
    other = edges.select(p, F.col("room_id").alias("other"), "x0", "y0", "x1", "y1")
    reach = pairs.join(other, [p, "other"]).withColumn("_d", segment_distance(
        F.col("mx"), F.col("my"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    gaps = reach.groupBy(p, "opening_id", "ordinal", "connection_id", "connection_order", "other").agg(F.min("_d").alias("_d"))
    near = gaps.filter(F.col("_d") <= cfg.boundary_tolerance).select(
        p, "opening_id", "ordinal", F.col("connection_id").cast("string").alias("connection_id"), F.col("other").cast("string").alias("linked_room"),
        F.col("_d").alias("distance"), F.col("connection_order").cast("double").alias("_o"))
    linked = exclusive_choices(near, [p], "opening_id", "connection_id", ["ordinal", "opening_id"], ["distance", "_o", "connection_id"])
    return openings.select(p, "opening_id").join(linked.drop("ordinal", "_o"), [p, "opening_id"], "left")


def exclusive_choices(options: DataFrame, keys: list[str], chooser: str, chosen: str, turn: list[str], taste: list[str], max_rounds: int = 1000) -> DataFrame:
    """The option rows that are taken if choosers, in the order ``turn``, each take the first option by ``taste`` whose ``chosen`` is left.

    Settled side by side in rounds: a chooser takes its first option as soon as no earlier open chooser has that one among its
    own options. What is taken leaves all other lists. At least the first open chooser of every group is settled in a round.
    """
    open_, taken = cut(options), []
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        rank = F.struct(*turn)
        first = open_.groupBy(*keys, chosen).agg(F.min(rank).alias("_first"))
        best = best_per_group(open_, [*keys, chooser], [F.col(c) for c in taste])
        won = cut(best.join(first, [*keys, chosen]).filter(rank == F.col("_first")).drop("_first").select(*options.columns))
        taken.append(won)
        open_ = cut(open_.join(won.select(*keys, chooser), [*keys, chooser], "left_anti").join(won.select(*keys, chosen), [*keys, chosen], "left_anti"))
    else:
        raise ValueError("choices did not settle; raise max_rounds")
    out = options.limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def typed_connections(connections: DataFrame, links: DataFrame, openings: DataFrame, property_key: str = "property_id") -> DataFrame:
    """Connections that carry a linked opening take its type when it is a door or passage."""
    named = links.filter("connection_id IS NOT NULL").join(openings.select(property_key, "opening_id", "type"), [property_key, "opening_id"]) \
        .select(property_key, "connection_id", F.col("opening_id").alias("_o"), F.col("type").alias("_t"))
    out = connections.withColumn("connection_id", F.col("connection_id").cast("string")).join(named, [property_key, "connection_id"], "left")
    return (out.withColumn("opening_id", F.coalesce("opening_id", F.col("_o").cast("string")))
            .withColumn("connection_type", F.when(F.col("_t").isin("door", "open_passage"), F.col("_t")).otherwise(F.col("connection_type")))
            .drop("_o", "_t"))


def drop_previous(openings: DataFrame, connections: DataFrame, keys: list[str], detector: str = "shared_opening_detector") -> tuple[DataFrame, DataFrame]:
    """Remove an earlier detection before a rerun; its connections fall back to inferred."""
    old = openings.filter(F.col("detector") == detector).select(*keys, "opening_id")
    kept = openings.join(old, [*keys, "opening_id"], "left_anti")
    mark = old.withColumn("_old", F.lit(True))
    freed = connections.join(mark, [*keys, "opening_id"], "left")
    was = F.coalesce("_old", F.lit(False))
    return kept, (freed.withColumn("connection_type", F.when(was & F.col("connection_type").isin("door", "open_passage"), "inferred")
                                   .otherwise(F.col("connection_type")))
                  .withColumn("opening_id", F.when(~was, F.col("opening_id"))).drop("_old"))


def ids_by_owner(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Sorted id list of every owner, one row per owner whatever its length."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
