"""Structural planes: extraction, fits, floor and ceiling choice, levelling, walls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import GeometryConfig
from roomfold.functions.scores import plane_quality
from roomfold.operators.clouds import convex_hulls, covariance, least_axis, moment_sums
from roomfold.operators.groups import map_groups
from roomfold.operators.ordering import best_per_group
from roomfold.operators.quantiles import weighted_quantiles
from roomfold.operators.rings import first_fit_spots, numbered, trace_rings
from roomfold.session import cut, fresh


def up_prior(poses: DataFrame, keys: list[str], minimum: float, pose: str = "pose") -> DataFrame:
    """Mean camera-up direction per capture and whether cameras agree on it."""
    mean = poses.groupBy(*keys).agg(*[F.avg(-F.col(pose)[4 * r + 1]).alias(f"u{c}") for r, c in enumerate("xyz")])
    return (mean.withColumn("coherence", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")
                                                + F.col("uz") * F.col("uz")))
            .withColumn("resolved", F.col("coherence") >= minimum))


def up_rotation(prior: DataFrame) -> DataFrame:
    """Rotation that sends the agreed up direction to +Z, with x along the least aligned axis."""
    norm = F.col("coherence")
    up = [F.col(f"u{c}") / norm for c in "xyz"]
    sizes = [F.abs(u) for u in up]
    least = F.least(*sizes)
    pick = [(sizes[0] == least), (sizes[0] != least) & (sizes[1] == least)]
    axis = [F.when(pick[0], 1.0).otherwise(0.0), F.when(pick[1], 1.0).otherwise(0.0),
            F.when(~pick[0] & ~pick[1], 1.0).otherwise(0.0)]
    staged = prior.select("*", *[u.alias(f"_u{i}") for i, u in enumerate(up)], *[a.alias(f"_r{i}") for i, a in enumerate(axis)])
    dot = sum((F.col(f"_r{i}") * F.col(f"_u{i}") for i in (1, 2)), F.col("_r0") * F.col("_u0"))
    staged = staged.select("*", *[(F.col(f"_r{i}") - F.col(f"_u{i}") * dot).alias(f"_q{i}") for i in range(3)])
    size = F.sqrt(sum((F.col(f"_q{i}") * F.col(f"_q{i}") for i in (1, 2)), F.col("_q0") * F.col("_q0")))
    staged = staged.select("*", *[(F.col(f"_q{i}") / size).alias(f"_x{i}") for i in range(3)])
    u, x = ([F.col(f"_{n}{i}") for i in range(3)] for n in "ux")
    y = [u[1] * x[2] - u[2] * x[1], u[2] * x[0] - u[0] * x[2], u[0] * x[1] - u[1] * x[0]]
    zero, one = F.lit(0.0), F.lit(1.0)
    rotation = F.array(*x, zero, *y, zero, *u, zero, zero, zero, zero, one)
    return staged.withColumn("leveling", rotation).drop(*[f"_{n}{i}" for n in "urqx" for i in range(3)])


def fit_moments(sums: DataFrame) -> DataFrame:
    """Plane per row of moment sums: centroid, unit normal with its largest component positive, offset, RMSE."""
    axis = sums.withColumn("_a", least_axis(covariance()))
    n = [F.col(f"_a.n{c}") for c in "xyz"]
    size = [F.abs(v) for v in n]
    top = F.greatest(*size)
    lead = F.when(size[0] == top, n[0]).when(size[1] == top, n[1]).otherwise(n[2])
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    centre = {f"c{c}": F.col(f"s{c}") / F.col("n") for c in "xyz"}
    out = axis.select(*sums.columns, *[(v * sign).alias(f"n{c}") for v, c in zip(n, "xyz")],
                      *[v.alias(k) for k, v in centre.items()], F.col("_a.residual").alias("rmse"))
    return out.withColumn("offset", -(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz")))


def fit_planes(members: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares plane per group from moments that add up across partitions."""
    return fit_moments(members.groupBy(*keys).agg(*moment_sums()))


def plane_areas(members: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Hull area of the members projected on their plane."""
    flat = F.abs(F.col("nz")) > 0.9
    ax, ay, az = F.when(flat, 1.0).otherwise(0.0), F.lit(0.0), F.when(flat, 0.0).otherwise(1.0)
    dot = ax * F.col("nx") + ay * F.col("ny") + az * F.col("nz")
    basis = planes.select(*keys, "nx", "ny", "nz", (ax - F.col("nx") * dot).alias("_ux"), (ay - F.col("ny") * dot).alias("_uy"), (az - F.col("nz") * dot).alias("_uz"))
    size = F.sqrt(F.col("_ux") * F.col("_ux") + F.col("_uy") * F.col("_uy") + F.col("_uz") * F.col("_uz"))
    basis = basis.select(*keys, "nx", "ny", "nz", *[(F.col(f"_u{c}") / size).alias(f"_u{c}") for c in "xyz"])
    basis = basis.select(*keys, "_ux", "_uy", "_uz", (F.col("ny") * F.col("_uz") - F.col("nz") * F.col("_uy")).alias("_vx"),
                         (F.col("nz") * F.col("_ux") - F.col("nx") * F.col("_uz")).alias("_vy"), (F.col("nx") * F.col("_uy") - F.col("ny") * F.col("_ux")).alias("_vz"))
    project = lambda v: F.col("x") * F.col(f"_{v}x") + F.col("y") * F.col(f"_{v}y") + F.col("z") * F.col(f"_{v}z")
    spots = members.join(basis, keys).select(*keys, project("u").alias("pu"), project("v").alias("pv"))
    return convex_hulls(spots, keys, "pu", "pv").select(*keys, F.col("hull_area").alias("area"))


def _hypotheses(remaining: DataFrame, keys: list[str], iterations: int, seed: int, round_no: int) -> DataFrame:
    """Planes through seeded triples of points.

    Every draw names a random rank; ranks come from a hash order kept to the wanted
    prefix, found by a hash threshold first so only a small sample is ever ordered. A cloud
    of fewer points than the draws need is drawn from again, each time in another order.
    """
    want = 3 * iterations
    counts = remaining.groupBy(*keys).agg(F.greatest(F.count("*"), F.lit(3)).alias("_count"))
    again = F.sequence(F.lit(0), F.least(F.ceil(F.lit(1.5 * want) / F.col("_count")), F.lit(want)).cast("int") - 1)
    remaining = remaining.join(counts, keys).select(*remaining.columns, F.explode(
        F.when(F.col("_count") < want, again).otherwise(F.array(F.lit(0)))).alias("_draw"))
    sizes = remaining.groupBy(*keys).agg(F.count("*").alias("_size"))
    draw = F.pmod(F.xxhash64(F.col("point_id"), F.lit(seed), F.lit(round_no), F.col("_draw")), F.lit(1 << 40)) / float(1 << 40)
    sampled = remaining.join(sizes, keys).withColumn("_h", draw) \
        .filter(F.col("_h") <= F.lit(want * 1.5 + 50) / F.col("_size"))
    order = Window.partitionBy(*keys).orderBy("_draw", "_h", "point_id")
    ranked = sampled.withColumn("_r", F.row_number().over(order) - 1).filter(F.col("_r") < want)
    triples = ranked.groupBy(*keys, F.floor(F.col("_r") / 3).cast("int").alias("hypothesis")).agg(
        F.array_sort(F.collect_list(F.struct("_r", "x", "y", "z"))).alias("_t")).filter(F.size("_t") == 3)
    p = lambda i, c: F.col("_t")[i][c]
    a = [p(1, c) - p(0, c) for c in "xyz"]
    b = [p(2, c) - p(0, c) for c in "xyz"]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    raw = triples.select(*keys, "hypothesis", *[v.alias(f"_c{i}") for i, v in enumerate(cross)], *[p(0, c).alias(f"_p{c}") for c in "xyz"])
    size = F.sqrt(F.col("_c0") * F.col("_c0") + F.col("_c1") * F.col("_c1") + F.col("_c2") * F.col("_c2"))
    unit = raw.withColumn("_s", size).filter(F.col("_s") > 1e-9).select(
        *keys, "hypothesis", *[(F.col(f"_c{i}") / F.col("_s")).alias(f"h{c}") for i, c in enumerate("xyz")], "_px", "_py", "_pz")
    return unit.select(*keys, "hypothesis", "hx", "hy", "hz",
                       (-(F.col("hx") * F.col("_px") + F.col("hy") * F.col("_py") + F.col("hz") * F.col("_pz"))).alias("hd"))


def _score(remaining: DataFrame, hypotheses: DataFrame, keys: list[str], distance: float, block: int = 50_000) -> DataFrame:
    """Inlier count of every hypothesis, over blocks of points of a room side by side."""
    names = [f.name for f in remaining.schema.fields if f.name in keys]
    types = dict(remaining.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", hypothesis int, hits long"
    parts = remaining.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    salted = remaining.join(parts, keys).withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.col("_parts")).cast("int")).drop("_parts")
    copies = hypotheses.join(parts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def count(points: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        if points.empty or planes.empty:
            return pd.DataFrame(columns=[*names, "hypothesis", "hits"])
        model = planes[["hx", "hy", "hz", "hd"]].to_numpy()
        hits = _hits(points[["x", "y", "z"]].to_numpy(), model[:, :3], model[:, 3], distance)
        out = pd.DataFrame({"hypothesis": planes["hypothesis"].to_numpy(), "hits": hits})
        for k in names:
            out[k] = points[k].iloc[0]
        return out[[*names, "hypothesis", "hits"]]

    partial = salted.groupBy(*keys, "_salt").cogroup(fresh(copies).groupBy(*keys, "_salt")).applyInPandas(count, schema)
    return partial.groupBy(*keys, "hypothesis").agg(F.sum("hits").alias("hits"))


def _hash_next(value: int | np.ndarray, held: np.ndarray) -> np.ndarray:
    """``held`` joined by one more int, as ``xxhash64`` of a further column joins it."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (held + p5 + np.uint64(4)) ^ (np.atleast_1d(value).astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * p1
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _room_hypotheses(held: np.ndarray, xyz: np.ndarray, iterations: int, seed: int, round_no: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and offsets that ``_hypotheses`` finds for one room; points come in the order of their ids."""
    want, n = 3 * iterations, len(xyz)
    draws = min(math.ceil(1.5 * want / max(n, 3)), want) if max(n, 3) < want else 1
    draw, point = np.repeat(np.arange(draws), n), np.tile(np.arange(n), draws)
    h = _hash_next(draw, _hash_next(round_no, _hash_next(seed, held))[point]) & np.uint64((1 << 40) - 1)
    h = h.astype(float) / float(1 << 40)
    near = np.flatnonzero(h <= (want * 1.5 + 50) / len(h))
    point = point[near[np.lexsort((point[near], h[near], draw[near]))[:want]]]
    p, q, r = (xyz[point[i:len(point) // 3 * 3:3]] for i in range(3))
    a, b = q - p, r - p
    cross = np.column_stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]])
    size = np.sqrt(cross[:, 0] * cross[:, 0] + cross[:, 1] * cross[:, 1] + cross[:, 2] * cross[:, 2])
    good = size > 1e-9
    normal, p = cross[good] / size[good, None], p[good]
    return normal, -(normal[:, 0] * p[:, 0] + normal[:, 1] * p[:, 1] + normal[:, 2] * p[:, 2])


def _hits(xyz: np.ndarray, normal: np.ndarray, offset: np.ndarray, distance: float) -> np.ndarray:
    """Points within ``distance`` of every plane."""
    hits = np.zeros(len(normal), dtype=np.int64)
    for start in range(0, len(xyz), 4096):
        hits += (np.abs(xyz[start:start + 4096] @ normal.T + offset) <= distance).sum(axis=0)
    return hits


def _small_rooms(points: DataFrame, keys: list[str], cfg: GeometryConfig) -> DataFrame:
    """Members of the planes of rooms of bounded size: the rounds of a room run where its points are, which are shuffled once."""
    rows = points.withColumn("_hash", F.xxhash64("point_id"))
    least = max(cfg.min_plane_inliers, 3)

    def search(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        held = table["_hash"].to_numpy().view(np.uint64)
        xyz = np.column_stack([table[c].to_numpy().astype(float) for c in "xyz"])
        whole = ~np.logical_or.reduce([pc.is_null(table[c]).to_numpy() for c in "xyz"])
        plane = np.zeros(len(table), np.int32)
        for low, high in zip(bounds[:-1], bounds[1:]):
            left = np.arange(low, high)
            for number in range(1, cfg.max_planes + 1):
                if len(left) < least:
                    break
                spots = xyz[left]
                normal, offset = _room_hypotheses(held[left], spots, cfg.ransac_iterations, cfg.seed, number)
                hits = _hits(spots, normal, offset, cfg.ransac_distance)
                if not len(hits) or hits.max() < cfg.min_plane_inliers:
                    break
                best = hits.argmax()
                (nx, ny, nz), d = normal[best], offset[best]
                inside = np.abs(spots[:, 0] * nx + spots[:, 1] * ny + spots[:, 2] * nz + d) <= cfg.ransac_distance
                plane[left[inside]] = number
                left = left[~inside & whole[left]]
        found = np.flatnonzero(plane)
        return table.take(pa.array(found)).append_column("plane_no", pa.array(plane[found]))

    types = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in points.columns) + ", plane_no int"
    return map_groups(rows, keys, schema, search, ["point_id"])


def extract_planes(points: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig(), small: int = 50_000) -> DataFrame:
    """Members (plane_no, point) of successive best planes of every room.

    One plane per round, its inliers leave, and a room stops below the inlier minimum; rounds are bounded by ``max_planes``.
    Rooms of at most ``small`` points are searched many in one pass; larger ones advance together, by rounds over rows. Both find the same planes.
    """
    points = cut(points.select(*keys, "point_id", "x", "y", "z"))
    large = cut(points.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select(*keys))
    if large.isEmpty():
        return _small_rooms(points, keys, cfg)
    rest = _small_rooms(points.join(large, keys, "left_anti").select(*points.columns), keys, cfg)
    return rest.unionByName(_large_rooms(points.join(large, keys, "left_semi"), keys, cfg))


def _large_rooms(remaining: DataFrame, keys: list[str], cfg: GeometryConfig) -> DataFrame:
    """The same for rooms of any size: a round scores all rooms over blocks of their points, side by side."""
    found = []
    for number in range(1, cfg.max_planes + 1):
        active = remaining.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(cfg.min_plane_inliers, 3))
        remaining = remaining.join(active.select(*keys), keys, "left_semi")
        hypotheses = cut(_hypotheses(remaining, keys, cfg.ransac_iterations, cfg.seed, number))
        scores = _score(remaining, hypotheses, keys, cfg.ransac_distance)
        best = best_per_group(scores.filter(F.col("hits") >= cfg.min_plane_inliers), keys, [F.col("hits").desc(), F.col("hypothesis")])
        chosen = hypotheses.join(best, [*keys, "hypothesis"]).select(*keys, "hx", "hy", "hz", "hd")
        gap = F.abs(F.col("x") * F.col("hx") + F.col("y") * F.col("hy") + F.col("z") * F.col("hz") + F.col("hd"))
        marked = cut(remaining.join(chosen, keys).withColumn("_in", gap <= cfg.ransac_distance).drop("hx", "hy", "hz", "hd"))
        inliers = marked.filter("_in").drop("_in").withColumn("plane_no", F.lit(number))
        if inliers.isEmpty():
            break
        found.append(inliers)
        remaining = marked.filter("NOT _in").drop("_in")
    if not found:
        return remaining.limit(0).withColumn("plane_no", F.lit(0))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def plane_budget_issues(points: DataFrame, members: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Rooms whose search ended at ``max_planes`` with enough points left for another plane."""
    found = members.groupBy(*keys).agg(F.max("plane_no").alias("_last"), F.count("*").alias("_in"))
    left = points.groupBy(*keys).agg(F.count("*").alias("_all")).join(found.filter(F.col("_last") >= cfg.max_planes), keys)
    return left.withColumn("points_left", F.col("_all") - F.col("_in")).filter(
        F.col("points_left") >= max(cfg.min_plane_inliers, 3)).select(*keys, F.lit("PLANE_BUDGET_REACHED").alias("code"), "points_left")


def horizontal(degrees: float) -> Column:
    return F.abs(F.col("nz")) >= math.cos(math.radians(degrees))


def vertical(degrees: float) -> Column:
    return F.abs(F.col("nz")) <= math.sin(math.radians(degrees))


def choose_floor(planes: DataFrame, points: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Large horizontal plane near the low end of the cloud along its own normal."""
    prints = convex_hulls(points, keys, "x", "y").select(*keys, F.col("hull_area").alias("_print"))
    flat = planes.filter(horizontal(cfg.horizontal_degrees)).join(prints, keys).filter(
        F.col("area") >= F.greatest(F.lit(cfg.min_horizontal_area), F.col("_print") * cfg.min_floor_coverage)).drop("_print")
    # Points meet the few horizontal planes of their room.
    heights = points.join(flat.select(*keys, "plane_no", "nx", "ny", "nz", "offset"), keys).withColumn(
        "_d", F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") + F.col("offset"))
    base = weighted_quantiles(heights, [*keys, "plane_no"], "_d", {"_base": cfg.quantile}, 0.05).drop("n")
    low = flat.join(base, [*keys, "plane_no"]).filter(F.abs("_base") <= cfg.floor_tolerance).drop("_base")
    return best_per_group(low, keys, [(F.col("area") * F.col("n")).desc(), F.col("cz"), F.col("plane_no")])


def choose_ceiling(planes: DataFrame, floors: DataFrame, tops: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Large plane parallel to the level floor, two to five metres up and near the cloud top."""
    floor = floors.select(*keys, F.col("plane_no").alias("_floor"), F.col("area").alias("_area"))
    near = planes.join(floor, keys).join(tops.select(*keys, "top"), keys).filter(
        (F.col("plane_no") != F.col("_floor")) & horizontal(cfg.ceiling_parallel_degrees)
        & F.col("cz").between(cfg.min_ceiling_height, cfg.max_ceiling_height)
        & (F.col("area") >= F.greatest(F.lit(cfg.min_horizontal_area), F.col("_area") * cfg.min_ceiling_coverage))
        & (F.col("cz") >= F.col("top") - cfg.ceiling_top_tolerance))
    return best_per_group(near, keys, [(F.col("area") * F.col("n")).desc(), F.col("cz").desc(), F.col("plane_no")]).drop("_floor", "_area", "top")


def floor_leveling(floors: DataFrame, keys: list[str]) -> DataFrame:
    """Transform that makes the floor normal +Z and its elevation zero."""
    sign = F.when(F.col("nz") > 0, 1.0).otherwise(-1.0)
    staged = floors.select(*keys, *[(F.col(f"n{c}") * sign).alias(f"_n{c}") for c in "xyz"], "cx", "cy", "cz")
    nx, ny, nz = (F.col(f"_n{c}") for c in "xyz")
    size = F.sqrt((1 - nx * nx) * (1 - nx * nx) + nx * ny * nx * ny + nx * nz * nx * nz)
    staged = staged.select("*", ((1 - nx * nx) / size).alias("_x0"), (-nx * ny / size).alias("_x1"), (-nx * nz / size).alias("_x2"))
    x = [F.col(f"_x{i}") for i in range(3)]
    y = [ny * x[2] - nz * x[1], nz * x[0] - nx * x[2], nx * x[1] - ny * x[0]]
    drop = -(nx * F.col("cx") + ny * F.col("cy") + nz * F.col("cz"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return staged.select(*keys, F.array(*x, zero, *y, zero, nx, ny, nz, drop, zero, zero, zero, one).alias("leveling"))


def ceiling_height(floors: DataFrame, ceilings: DataFrame, keys: list[str]) -> DataFrame:
    """Separation along the floor normal at the floor centroid; null when nearly parallel to it."""
    f = floors.select(*keys, *[F.col(f"n{c}").alias(f"f{c}") for c in "xyz"], *[F.col(f"c{c}").alias(f"g{c}") for c in "xyz"])
    joined = ceilings.select(*keys, "nx", "ny", "nz", "offset").join(f, keys)
    denominator = F.col("nx") * F.col("fx") + F.col("ny") * F.col("fy") + F.col("nz") * F.col("fz")
    top = F.col("nx") * F.col("gx") + F.col("ny") * F.col("gy") + F.col("nz") * F.col("gz") + F.col("offset")
    return joined.select(*keys, F.when(F.abs(denominator) >= 1e-6, F.abs(top / F.nullif(denominator, F.lit(0.0)))).alias("ceiling_height"))


def descriptors(members: DataFrame, planes: DataFrame, sizes: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Width, height coverage, orientation class and quality of every plane."""
    plane = [*keys, "plane_no"]
    horizontal_norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    upright = vertical(cfg.vertical_degrees)
    dx = F.when(upright, -F.col("ny") / F.nullif(horizontal_norm, F.lit(0.0))).otherwise(-F.col("ny"))
    dy = F.when(upright, F.col("nx") / F.nullif(horizontal_norm, F.lit(0.0))).otherwise(F.col("nx"))
    named = planes.withColumn("dx", dx).withColumn("dy", dy)
    joined = members.join(named.select(*plane, "dx", "dy"), plane).withColumn("t", F.col("x") * F.col("dx") + F.col("y") * F.col("dy"))
    extent = joined.groupBy(*plane).agg((F.max("x") - F.min("x")).alias("_px"), (F.max("y") - F.min("y")).alias("_py"))
    out = named.join(extent, plane).join(_ends(joined, plane, ["t", "z"], cfg.quantile), plane).join(sizes, keys)
    kind = F.when(upright, "vertical").when(horizontal(cfg.horizontal_degrees), "horizontal").otherwise("other")
    return (out.withColumn("orientation", kind)
            .withColumn("width", F.when(upright, F.col("t1") - F.col("t0")).otherwise(F.hypot("_px", "_py")))
            .withColumn("height_coverage", F.col("z1") - F.col("z0")).withColumn("inlier_ratio", F.col("n") / F.col("points"))
            .withColumn("orientation_degrees", F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0)))
            .withColumn("quality", plane_quality(F.col("rmse"), cfg.ransac_distance)).drop("_px", "_py"))


def select_walls(described: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> tuple[DataFrame, DataFrame]:
    """Eligible walls, and how many vertical planes were rejected per room."""
    upright = described.filter(F.col("orientation") == "vertical")
    bad = ((F.col("width") < cfg.min_wall_length) | (F.col("height_coverage") < cfg.min_wall_height) | (F.abs("z0") > cfg.wall_base_tolerance))
    rejected = upright.groupBy(*keys).agg(F.count_if(bad).alias("rejected_walls"))
    return upright.filter(~bad), rejected


def _ends(df: DataFrame, keys: list[str], values: list[str], q: float) -> DataFrame:
    """``<value>0`` and ``<value>1``: the trimmed ends of every value, exact for groups of any size."""
    out = None
    for v in values:
        one = weighted_quantiles(df, keys, v, {f"{v}0": q, f"{v}1": 1 - q}, 0.05).drop("n")
        out = one if out is None else out.join(one, keys)
    return out


def _mergeable(fitted: DataFrame, members: DataFrame, keys: list[str], cfg: GeometryConfig) -> DataFrame:
    """Pairs of walls of a room that are coplanar and whose trimmed extents touch along the first wall and in height."""
    plane = [*keys, "plane_no"]
    side = lambda s: fitted.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("plane_no", "nx", "ny", "nz", "cx", "cy", "cz", "offset")])
    pairs = side("a").join(side("b"), keys).filter(F.col("a_plane_no") < F.col("b_plane_no"))
    turn = F.abs(F.col("a_nx") * F.col("b_nx") + F.col("a_ny") * F.col("b_ny") + F.col("a_nz") * F.col("b_nz"))
    gap = lambda p, q: F.abs(F.col(f"{p}_nx") * F.col(f"{q}_cx") + F.col(f"{p}_ny") * F.col(f"{q}_cy") + F.col(f"{p}_nz") * F.col(f"{q}_cz") + F.col(f"{p}_offset"))
    close = pairs.filter((turn >= math.cos(math.radians(cfg.merge_degrees))) & (F.greatest(gap("a", "b"), gap("b", "a")) <= cfg.merge_distance))
    norm = F.hypot("a_nx", "a_ny")
    axis = cut(close.select(*keys, "a_plane_no", "b_plane_no", (-F.col("a_ny") / norm).alias("dx"), (F.col("a_nx") / norm).alias("dy")))
    if axis.isEmpty():
        return axis.select(*keys, "a_plane_no", "b_plane_no")
    both = axis.select("*", F.explode(F.array("a_plane_no", "b_plane_no")).alias("plane_no")).join(members, plane).withColumn(
        "t", F.col("x") * F.col("dx") + F.col("y") * F.col("dy"))
    spans = _ends(both, [*keys, "a_plane_no", "b_plane_no", "plane_no"], ["t", "z"], cfg.quantile)
    return spans.groupBy(*keys, "a_plane_no", "b_plane_no").agg(
        (F.max("t0") - F.min("t1")).alias("_tg"), (F.max("z0") - F.min("z1")).alias("_hg")).filter(
        F.greatest("_tg", "_hg") <= cfg.merge_gap).select(*keys, "a_plane_no", "b_plane_no")


def disjoint_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A maximal set of pairs of every room without a plane in common, taken in order.

    The planes of a room are bounded by the plane budget, and so is the list that is folded.
    """
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("a_plane_no").cast("int").alias("a"), F.col("b_plane_no").cast("int").alias("b")))).alias("_p"))
    empty = F.lit(None).cast("array<struct<a:int,b:int>>")
    taken = F.aggregate("_p", F.coalesce(empty, F.array().cast("array<struct<a:int,b:int>>")), lambda acc, p: F.when(
        F.exists(acc, lambda q: (q["a"] == p["a"]) | (q["a"] == p["b"]) | (q["b"] == p["a"]) | (q["b"] == p["b"])), acc).otherwise(
        F.concat(acc, F.array(p))))
    return listed.select(*keys, F.explode(taken).alias("_q")).select(*keys, F.col("_q.a").alias("a_plane_no"), F.col("_q.b").alias("b_plane_no"))


def merge_walls(walls: DataFrame, members: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig(),
                max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """Merge coplanar, touching walls until none is left.

    Returns merged planes and members renumbered to the surviving plane, each point once. A merge forest grows by rounds: every room takes a
    maximal set of disjoint pairs, the later plane of a pair goes into the earlier one, and what two planes share counts
    once in the refit. Each round at least halves the walls that still find a partner.
    """
    plane = [*keys, "plane_no"]
    sets = cut(members.join(walls.select(*plane), plane, "left_semi").select(*plane, "point_id", "x", "y", "z").dropDuplicates([*plane, "point_id"]))
    fitted = cut(fit_planes(sets, plane))
    for _ in range(max_rounds):
        chosen = cut(disjoint_pairs(_mergeable(fitted, sets, keys, cfg), keys))
        if chosen.isEmpty():
            return fitted, sets
        step = chosen.select(*keys, F.col("b_plane_no").alias("plane_no"), F.col("a_plane_no").alias("_to"))
        touched = step.select(*plane).unionByName(step.select(*keys, F.col("_to").alias("plane_no")))
        moved = sets.join(touched, plane, "left_semi").join(step, plane, "left").withColumn("plane_no", F.coalesce("_to", "plane_no")).drop("_to")
        joined = cut(moved.dropDuplicates([*plane, "point_id"]).select(*sets.columns))
        sets = cut(sets.join(touched, plane, "left_anti").unionByName(joined))
        fitted = cut(fitted.join(touched, plane, "left_anti").unionByName(fit_planes(joined, plane)))
    raise ValueError("walls did not settle; raise max_rounds")


def wall_segments(described: DataFrame, keys: list[str]) -> DataFrame:
    """Wall ends on the floor and stable names in centroid order."""
    norm = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")
    ox, oy = -F.col("offset") * F.col("nx") / norm, -F.col("offset") * F.col("ny") / norm
    order = Window.partitionBy(*keys).orderBy("cx", "cy", "cz")
    named = described.withColumn("wall_no", F.row_number().over(order)).withColumn("wall_id", F.format_string("wall_%02d", F.col("wall_no")))
    at = lambda t: (ox + F.col(t) * F.col("dx"), oy + F.col(t) * F.col("dy"))
    (x0, y0), (x1, y1) = at("t0"), at("t1")
    return named.withColumn("x0", x0).withColumn("y0", y0).withColumn("x1", x1).withColumn("y1", y1) \
        .withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def wall_crossings(segments: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Bounded intersections of the wall lines of a room, near an end of both walls."""
    side = lambda s: segments.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("wall_no", "wall_id", "x0", "y0", "x1", "y1", "length", "quality")])
    pairs = side("a").join(side("b"), keys).filter(F.col("a_wall_no") < F.col("b_wall_no"))
    ux, uy = ((F.col(f"a_{c}1") - F.col(f"a_{c}0")) / F.col("a_length") for c in "xy")
    vx, vy = ((F.col(f"b_{c}1") - F.col(f"b_{c}0")) / F.col("b_length") for c in "xy")
    cross = ux * vy - uy * vx
    pairs = pairs.withColumn("_d", cross).filter(F.abs("_d") >= math.sin(math.radians(cfg.min_intersection_degrees)))
    wx, wy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    pairs = pairs.withColumn("_t", (wx * vy - wy * vx) / F.col("_d")).withColumn("_s", (wx * uy - wy * ux) / F.col("_d"))
    # A crossing right at the reach counts, whatever the last digits of the fitted walls.
    ext = cfg.extension + 1e-9
    near = lambda t, n: F.col(t).between(-ext, F.col(n) + ext) & (F.least(F.abs(t), F.abs(F.col(t) - F.col(n))) <= ext)
    return pairs.filter(near("_t", "a_length") & near("_s", "b_length")).select(
        *keys, "a_wall_no", "b_wall_no", "a_wall_id", "b_wall_id", (F.col("a_x0") + F.col("_t") * ux).alias("x"),
        (F.col("a_y0") + F.col("_t") * uy).alias("y"), F.least("a_quality", "b_quality").alias("quality"))


def _corners(crossings: DataFrame, keys: list[str], cfg: GeometryConfig) -> tuple[DataFrame, DataFrame]:
    """Corners (``corner``, ``x``, ``y``) and which walls meet in each (``corner``, ``wall_no``)."""
    hits = cut(numbered(crossings, keys, ["a_wall_no", "b_wall_no"]))
    homes = first_fit_spots(hits, keys, cfg.corner_merge)
    corners = hits.join(homes.filter("spot = n").select(*keys, "n"), [*keys, "n"]).select(*keys, F.col("n").alias("corner"), "x", "y")
    meets = hits.join(homes, [*keys, "n"]).select(*keys, F.col("spot").alias("corner"), F.explode(F.array("a_wall_no", "b_wall_no")).alias("wall_no")).distinct()
    return cut(corners), cut(meets)


def half_edges(meets: DataFrame, walls: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of every wall of the regular rooms: ``edge``, ``next``, ``wall_no`` and the corners ``at`` and ``to``.

    A room is regular if it has three corners or more, two walls meet in each and each wall has two of them.
    """
    by_corner = meets.groupBy(*keys, "corner").agg(F.count("*").alias("_n"), F.min("wall_no").alias("_w0"), F.max("wall_no").alias("_w1"))
    by_wall = walls.select(*keys, "wall_no").join(meets, [*keys, "wall_no"], "left").groupBy(*keys, "wall_no").agg(
        F.count("corner").alias("_n"), F.min("corner").alias("_c0"), F.max("corner").alias("_c1"))
    whole = by_corner.groupBy(*keys).agg(F.count("*").alias("_corners"), F.max(F.abs(F.col("_n") - 2)).alias("_off"))
    ends = by_wall.groupBy(*keys).agg(F.max(F.abs(F.col("_n") - 2)).alias("_ends_off"))
    regular = whole.join(ends, keys).filter("_corners >= 3 AND _off = 0 AND _ends_off = 0").select(*keys)
    sides = by_wall.join(regular, keys, "left_semi")
    both = sides.select(*keys, (2 * F.col("wall_no")).alias("edge"), "wall_no", F.col("_c0").alias("at"), F.col("_c1").alias("to")).unionByName(
        sides.select(*keys, (2 * F.col("wall_no") + 1).alias("edge"), "wall_no", F.col("_c1").alias("at"), F.col("_c0").alias("to")))
    onward = by_corner.select(*keys, F.col("corner").alias("to"), "_w0", "_w1")
    turned = both.join(onward, [*keys, "to"]).withColumn("_other", F.when(F.col("wall_no") == F.col("_w0"), F.col("_w1")).otherwise(F.col("_w0")))
    first = by_wall.select(*keys, F.col("wall_no").alias("_other"), "_c0")
    return turned.join(first, [*keys, "_other"]).select(
        *keys, "edge", (2 * F.col("_other") + F.when(F.col("_c0") == F.col("to"), 0).otherwise(1)).alias("next"), "wall_no", "at", "to")


def _crossing_rooms(ring: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms with two sides that are no neighbours and meet; a room has no more sides than the plane budget."""
    one = ring.select(*keys, "size", "position", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    two = ring.select(*keys, F.col("position").alias("_p"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    apart = (F.col("_p") > F.col("position") + 1) & ~((F.col("position") == 0) & (F.col("_p") == F.col("size") - 1))
    turn = lambda s, t, e: ((F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{t}_y{e}") - F.col(f"{s}_y0"))
                            - (F.col(f"{s}_y1") - F.col(f"{s}_y0")) * (F.col(f"{t}_x{e}") - F.col(f"{s}_x0")))
    meet = (turn("a", "b", 0) * turn("a", "b", 1) <= 0) & (turn("b", "a", 0) * turn("b", "a", 1) <= 0)
    return one.join(two, keys).filter(apart & meet).select(*keys).distinct()


def close_polygons(segments: DataFrame, crossings: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Room polygon when corners and walls alternate in one simple ring; otherwise null.

    Walls are walked as half-edges in both directions; a room closes if each direction is one ring over all its
    walls. The counter-clockwise one is the polygon, from the end of the lowest wall on.
    """
    walls = cut(segments.select(*keys, "wall_no", "x0", "y0", "x1", "y1"))
    corners, meets = _corners(crossings, keys, cfg)
    edges = cut(half_edges(meets, walls, keys))
    spot = lambda name, s: corners.select(*keys, F.col("corner").alias(name), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    placed = edges.join(trace_rings(edges, keys), [*keys, "edge"]).join(spot("at", 0), [*keys, "at"]).join(spot("to", 1), [*keys, "to"])
    placed = cut(placed.select(*keys, "edge", "wall_no", "ring", "size", "position", "x0", "y0", "x1", "y1"))
    numbers = walls.groupBy(*keys).agg(F.count("*").alias("_walls"))
    measured = placed.groupBy(*keys, "ring").agg(
        F.first("size").alias("_size"), F.min(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("_side"),
        (F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"),
        F.array_sort(F.collect_list(F.struct("position", F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("_ring"))
    good = cut(measured.join(numbers, keys).filter((F.col("_size") == F.col("_walls")) & (F.col("_side") > cfg.corner_merge) & (F.col("area") >= cfg.min_polygon_area)))
    crossed = _crossing_rooms(placed.join(good.select(*keys, "ring"), [*keys, "ring"], "left_semi"), keys)
    seen = walls.select(*keys, "wall_no", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    miss = F.least(F.hypot(F.col("x0") - F.col("_x0"), F.col("y0") - F.col("_y0")), F.hypot(F.col("x0") - F.col("_x1"), F.col("y0") - F.col("_y1")))
    errors = placed.join(seen, [*keys, "wall_no"]).groupBy(*keys).agg(F.max(miss).alias("closure_error"))
    rings = good.join(crossed, keys, "left_anti").join(errors, keys).select(
        *keys, F.transform("_ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), "area", "closure_error")
    counts = corners.groupBy(*keys).agg(F.count("*").cast("int").alias("corners"))
    return numbers.select(*keys).join(counts, keys, "left").fillna({"corners": 0}).join(rings, keys, "left")


def room_geometry(points: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> dict[str, DataFrame]:
    """Floor, ceiling, walls, polygon and diagnostics of every room cloud."""
    from roomfold.operators.frames import transform_points
    plane = [*keys, "plane_no"]
    members = cut(extract_planes(points, keys, cfg))
    # Per-plane tables are tiny; materialising them keeps later plans small.
    planes = cut(fit_planes(members, plane))
    planes = cut(planes.join(plane_areas(members, planes, plane), plane))
    source_floor = cut(choose_floor(planes, points, keys, cfg))
    leveling = cut(floor_leveling(source_floor, keys))
    level_points = cut(transform_points(points, leveling, keys, "leveling"))
    level_members = cut(transform_points(members, leveling, keys, "leveling"))
    refit = cut(cut(fit_planes(level_members, plane)).join(planes.select(*plane, "area"), plane))
    floors = refit.join(source_floor.select(*plane), plane, "left_semi")
    tops = cut(weighted_quantiles(level_points, keys, "z", {"top": 1 - cfg.quantile}, 0.05).withColumnRenamed("n", "points"))
    sizes = tops.select(*keys, "points")
    ceilings = cut(choose_ceiling(refit, floors, tops, keys, cfg))
    taken = floors.select(*plane).unionByName(ceilings.select(*plane))
    others = refit.join(taken, plane, "left_anti")
    walls, rejected = select_walls(cut(descriptors(level_members, others, sizes, keys, cfg)), keys, cfg)
    merged, wall_members = merge_walls(walls, level_members, keys, cfg)
    wall_members = cut(wall_members)
    segments = cut(wall_segments(cut(descriptors(wall_members, merged, sizes, keys, cfg)), keys))
    rings = cut(close_polygons(segments, cut(wall_crossings(segments, keys, cfg)), keys, cfg))
    heights = cut(ceiling_height(floors, ceilings, keys))
    structural = level_members.join(taken, plane, "left_semi").select(*keys, "point_id").unionByName(
        wall_members.select(*keys, "point_id")).distinct().groupBy(*keys).agg(F.count("*").alias("explained"))
    counts = walls.groupBy(*keys).agg(F.count("*").alias("_eligible"))
    rooms = (floors.select(*keys, F.col("rmse").alias("floor_rmse")).join(sizes, keys).join(heights, keys, "left").join(rings, keys, "left")
             .join(structural, keys, "left").join(rejected, keys, "left").join(counts, keys, "left")
             .join(segments.groupBy(*keys).agg(F.count("*").alias("walls")), keys, "left")
             .withColumn("explained_ratio", F.col("explained") / F.col("points"))
             .withColumn("merged_walls", F.col("_eligible") - F.col("walls")).drop("_eligible"))
    issues = cut(plane_budget_issues(points, members, keys, cfg))
    codes = F.array_compact(F.array(F.when(F.col("ceiling_height").isNull(), F.lit("CEILING_UNAVAILABLE")),
                                    F.when(F.col("ring").isNull(), F.lit("POLYGON_UNAVAILABLE")), F.col("_budget")))
    rooms = rooms.join(issues.select(*keys, F.col("code").alias("_budget")), keys, "left")
    return {"rooms": rooms.withColumn("codes", codes).drop("_budget"), "issues": issues, "planes": refit, "floors": floors, "ceilings": ceilings,
            "segments": segments, "leveling": leveling, "members": level_members}
