"""Point clouds: voxel grids, budgets, neighbour joins, outliers, normals, hulls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from roomfold.config import FrameConfig, GeometryConfig
from roomfold.functions.rigid import is_finite
from roomfold.operators.groups import ROWS, begins, map_groups
from roomfold.session import cut

XYZ = ["x", "y", "z"]


def voxel_cell(size: float | int, coords: list[str] = XYZ) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"v{c[0]}") for c in coords]


def voxel_downsample(points: DataFrame, keys: list[str], size: float, extra: list[str] = ()) -> DataFrame:
    """One row per occupied cell with mean position, mean attributes and point count.

    Grouping is by (group, cell) with partial aggregation, so a dominant capture is
    spread over its cells.
    """
    means = [F.avg(c).alias(c) for c in [*XYZ, *extra]]
    return points.groupBy(*keys, *voxel_cell(size)).agg(F.count("*").alias("n"), *means)


def voxel_sums(points: DataFrame, keys: list[str], size: int, coords: list[str]) -> DataFrame:
    """Integer sums and counts per cell, for coordinates kept as whole millimetres."""
    cells = [F.floor(F.col(c) / size).alias(f"v{c[0]}") for c in coords]
    return points.groupBy(*keys, *cells).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in coords])


def fuse_frames(points: DataFrame, keys: list[str], cfg: FrameConfig = FrameConfig()) -> tuple[DataFrame, DataFrame]:
    """All posed frames in one voxel grid, and an issue row for every capture over the point budget.

    Nothing is left out: what to do with such a capture is up to the caller.
    """
    fused = voxel_downsample(points, keys, cfg.fusion_voxel)
    return fused, over_budget(fused, keys, cfg.max_fused_points, "FUSION_POINT_BUDGET_EXCEEDED")[1]


def over_budget(points: DataFrame, keys: list[str], limit: int, code: str) -> tuple[DataFrame, DataFrame]:
    sizes = points.groupBy(*keys).agg(F.count("*").alias("points"))
    issues = sizes.filter(F.col("points") > limit).select(*keys, F.lit(code).alias("code"), "points")
    return points.join(issues.select(*keys), keys, "left_anti"), issues


def cloud_checks(points: DataFrame, keys: list[str], cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Verdict per cloud: non-finite coordinates or too few points reject it."""
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    per = points.groupBy(*keys).agg(F.count("*").alias("points"),
                                    F.count_if(~F.coalesce(finite, F.lit(False))).alias("non_finite"))
    return per.withColumn("status", F.when(F.col("non_finite") > 0, "non_finite")
                          .when(F.col("points") < cfg.min_points, "insufficient").otherwise("ok"))


def block_cells(coords: list[Column], radius: float, names: list[str], span: int) -> tuple[list[Column], list[Column]]:
    """Cells of ``span`` radii: the one a point lies in, and lists of those that its ball of ``radius`` may touch.

    Copying points to the cells they touch takes (1 + 2 / span) ** 3 rows a point on average, not 27.
    """
    size, margin = span * radius, radius * (1 + 1e-6)
    home = [F.floor(c / size).alias(name) for c, name in zip(coords, names)]
    touched = [F.sequence(F.floor((c - margin) / size), F.floor((c + margin) / size)).alias(name) for c, name in zip(coords, names)]
    return home, touched


#: Number of the asking point of every neighbour, how many ask, coordinates and squared distances of the neighbours -> columns per asking point.
Fold = Callable[[np.ndarray, int, list[np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _nearest(xyz: list[np.ndarray], need: np.ndarray, radius: float, limit: int | None, chunk: int = 4_000_000) -> list[np.ndarray]:
    """Asking points of one cell, which comes in the order of ids, with their neighbours and squared distances.

    A point that has fewer neighbours than it needs comes once, with -1. Without ``limit`` all neighbours come, in the order of ids.
    """
    asking = np.flatnonzero(need >= 0)
    parts = []
    step = max(1, chunk // len(need))
    for start in range(0, len(asking), step):
        ask = asking[start:start + step]
        dx, dy, dz = (c[ask, None] - c[None, :] for c in xyz)
        d2 = dx * dx + dy * dy + dz * dz
        q, p = np.nonzero(d2 <= radius * radius)
        d = d2[q, p]
        found = np.bincount(q, minlength=len(ask))
        keep = (found >= need[ask])[q]
        if limit is not None:
            order = np.lexsort((d, q))  # stable: equal distances stay in the order of ids
            q, p, d = q[order], p[order], d[order]
            first = np.cumsum(found) - found
            keep &= np.arange(len(q)) - first[q] < limit
        short = ask[found < need[ask]]
        parts.append((np.append(ask[q[keep]], short), np.append(p[keep], np.full(len(short), -1)), np.append(d[keep], np.full(len(short), np.nan))))
    return parts[0] if len(parts) == 1 else [np.concatenate(v) for v in zip(*parts)]


def _neighbour_rows(table: pa.Table, names: list[str], point_id: str, row: np.ndarray, mate: np.ndarray, gap: np.ndarray, fold: Fold | None) -> pa.Table:
    """One row per neighbour, or with ``fold`` one per asking point of what it makes of its neighbours."""
    if fold:
        asked, owner = np.unique(row, return_inverse=True)
        own = {c: table[c].take(pa.array(asked)) for c in (*names, point_id)}
        return pa.table(own | {c: pa.array(v) for c, v in fold(owner, len(asked), [table[c].to_numpy()[mate] for c in XYZ], gap).items()})
    at = pa.array(mate, mask=mate < 0)
    out = [table[c].take(pa.array(row)) for c in (*names, point_id, *XYZ, "_need")]
    out += [table[c].take(at) for c in (point_id, *XYZ)]
    return pa.table([*out, pa.array(gap)], names=[*names, point_id, *XYZ, "_need", "b_id", *[f"b_{c}" for c in XYZ], "d2"])


def _near(points: DataFrame, keys: list[str], point_id: str, radius: float, limit: int | None, span: int = 6,
          fold: Fold | None = None, folded: str = "") -> DataFrame:
    """The ``limit`` nearest points, or all, inside ``radius`` of every row whose ``_need`` is not negative, the point itself included.

    A row that finds fewer than ``_need`` comes back once with a null ``b_id``. Points are copied to the cells of ``span`` radii that
    they touch; a task reads its cells one after another, so only the results leave it. Inputs must be voxel down-sampled: that
    bounds how many points a cell can hold.
    """
    cells = ["_bx", "_by", "_bz"]
    home, touched = block_cells([F.col(c) for c in XYZ], radius, cells, span)
    known = points.dropna(subset=[*keys, *XYZ]).select(*keys, point_id, *XYZ, "_need", *[h.alias(f"_h{c}") for h, c in zip(home, cells)], *touched)
    for c in cells:
        known = known.withColumn(c, F.explode(c))
    own = F.lit(True)
    for c in cells:
        own = own & (F.col(c) == F.col(f"_h{c}"))
    copies = known.select(*keys, point_id, *XYZ, *cells, F.when(own, F.col("_need")).otherwise(-1).cast("long").alias("_need"))
    group = [*keys, *cells]
    sorted_cells = copies.repartition(*group).sortWithinPartitions(*group, point_id)
    types = dict(copies.dtypes)
    columns = [*keys, point_id, *XYZ, "_need"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", b_id {types[point_id]}, b_x double, b_y double, b_z double, d2 double"
    if fold:
        schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, point_id)) + f", {folded}"

    def search(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            change = np.zeros(len(held) - 1, dtype=bool)
            for c in group:
                change |= pc.not_equal(held[c].slice(1), held[c].slice(0, len(held) - 1)).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(change) + 1
            if len(ends):
                yield from answers(held.slice(0, ends[-1]), ends)
                held = held.slice(ends[-1])
        if held is not None and len(held):
            yield from answers(held, [len(held)])

    def answers(table, ends):
        xyz, need = [table[c].to_numpy() for c in XYZ], table["_need"].to_numpy()
        parts, size = [], 0
        asks = np.append(0, np.cumsum(need >= 0))
        for low, high in zip([0, *ends[:-1]], ends):
            if asks[high] > asks[low]:
                row, mate, gap = _nearest([c[low:high] for c in xyz], need[low:high], radius, limit)
                parts.append((row + low, np.where(mate < 0, -1, mate + low), gap))
                size += len(row)
            if size > 50_000:
                yield from _neighbour_rows(table, keys, point_id, *map(np.concatenate, zip(*parts)), fold).combine_chunks().to_batches(max_chunksize=50_000)
                parts, size = [], 0
        if parts:
            yield from _neighbour_rows(table, keys, point_id, *map(np.concatenate, zip(*parts)), fold).combine_chunks().to_batches(max_chunksize=50_000)

    return sorted_cells.mapInArrow(search, schema)


def nearest_in_radius(points: DataFrame, keys: list[str], point_id: str, radius: float, limit: int) -> DataFrame:
    """Up to ``limit`` nearest neighbours of every point inside a radius (self included)."""
    return _near(points.withColumn("_need", F.lit(0)), keys, point_id, radius, limit).drop("_need")


def fold_in_radius(points: DataFrame, keys: list[str], point_id: str, radius: float, limit: int | None, fold: Fold, folded: str) -> DataFrame:
    """One row per point: the columns ``folded`` that ``fold`` makes of its neighbours inside a radius, where they are found.

    With ``limit`` only the nearest so many are folded, as in a hybrid search; without it all are.
    """
    return _near(points.withColumn("_need", F.lit(0)), keys, point_id, radius, limit, fold=fold, folded=folded)


def distances(owner: np.ndarray, count: int, xyz: list[np.ndarray], d2: np.ndarray) -> dict[str, np.ndarray]:
    """Number of neighbours and the sum of their distances."""
    return {"neighbours": np.bincount(owner, minlength=count), "distance_sum": np.bincount(owner, np.sqrt(d2), count)}


def nearest_k(points: DataFrame, keys: list[str], point_id: str, k: int, radius: float,
              max_rounds: int = 24) -> DataFrame:
    """Exact k nearest neighbours (self included) by doubling the radius.

    A point is settled once k neighbours lie inside the radius; only unsettled points,
    the isolated tail, are searched again. Groups with fewer than k points settle with
    all they have.
    """
    base = points.select(*keys, point_id, *XYZ)
    sizes = base.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias("_need"))
    base = cut(base.join(sizes.hint("merge"), keys))
    asked, settled = base, []
    for _ in range(max_rounds):
        found = cut(_near(asked, keys, point_id, radius, k))
        settled.append(found.filter("b_id IS NOT NULL").drop("_need"))
        open_ = found.filter("b_id IS NULL").select(*keys, point_id, F.lit(True).alias("_open"))
        if open_.isEmpty():
            break
        # Points of groups that are settled take no part in later rounds; settled points are only found.
        left = base.join(open_.select(*keys).distinct().hint("merge"), keys, "left_semi")
        asked = left.join(open_.hint("merge"), [*keys, point_id], "left").withColumn(
            "_need", F.when(F.col("_open"), F.col("_need")).otherwise(-1)).drop("_open")
        radius *= 2
    else:
        raise ValueError("nearest_k did not settle; raise max_rounds")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def drop_outliers(points: DataFrame, keys: list[str], point_id: str, k: int, ratio: float,
                  start_radius: float) -> DataFrame:
    """Drop points whose mean distance to k nearest (self counted) exceeds mean + ratio * std.

    Clouds with no more than k points are left alone.
    """
    near = nearest_k(points, keys, point_id, k, start_radius)
    mean = near.groupBy(*keys, point_id).agg(F.avg(F.sqrt("d2")).alias("_d"), F.count("*").alias("_n"))
    spread = mean.filter("_d > 0").groupBy(*keys).agg(
        (F.avg("_d") + ratio * F.stddev_samp("_d")).alias("_limit"))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_size"))
    # Merged: per-cloud tables grow with the clouds and would go through the driver.
    kept = mean.join(spread.hint("merge"), keys).join(sizes.hint("merge"), keys).filter(
        (F.col("_size") <= k) | ((F.col("_d") > 0) & (F.col("_d") < F.col("_limit")))).select(*keys, point_id)
    return points.join(kept.hint("merge"), [*keys, point_id], "left_semi")


AXIS = T.StructType([T.StructField(name, T.DoubleType()) for name in ("nx", "ny", "nz", "residual")])


def least_axes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least eigenvectors and square roots of the least eigenvalues of 3x3 covariances given as xx, yy, zz, xy, xz, yz."""
    cov = np.empty((len(m), 3, 3))
    cov[:, 0, 0], cov[:, 1, 1], cov[:, 2, 2] = m[:, 0], m[:, 1], m[:, 2]
    cov[:, 0, 1] = cov[:, 1, 0] = m[:, 3]
    cov[:, 0, 2] = cov[:, 2, 0] = m[:, 4]
    cov[:, 1, 2] = cov[:, 2, 1] = m[:, 5]
    ok = np.isfinite(cov).all(axis=(1, 2))
    cov[~ok] = np.eye(3)
    values, vectors = np.linalg.eigh(cov)
    normal = vectors[:, :, 0].copy()
    normal[~ok] = np.nan
    return normal, np.sqrt(np.maximum(values[:, 0], 0.0))


@F.pandas_udf(AXIS)
def least_axis(moments: pd.DataFrame) -> pd.DataFrame:
    """``least_axes`` of a column of moments."""
    normal, residual = least_axes(moments.to_numpy(dtype=float))
    return pd.DataFrame({"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "residual": residual})


def moment_sums(prefix: str = "") -> list[Column]:
    """Sums that add: count, first and second moments."""
    x, y, z = (F.col(prefix + c) for c in XYZ)
    pairs = {"sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "szz": z * z, "sxy": x * y, "sxz": x * z,
             "syz": y * z}
    return [F.count(x).alias("n"), *[F.sum(v).alias(name) for name, v in pairs.items()]]


def covariance() -> Column:
    n = F.col("n")
    second = lambda s, a, b: F.col(s) / n - (F.col(a) / n) * (F.col(b) / n)
    return F.struct(second("sxx", "sx", "sx").alias("xx"), second("syy", "sy", "sy").alias("yy"),
                    second("szz", "sz", "sz").alias("zz"), second("sxy", "sx", "sy").alias("xy"),
                    second("sxz", "sx", "sz").alias("xz"), second("syz", "sy", "sz").alias("yz"))


def point_normals(points: DataFrame, keys: list[str], point_id: str, radius: float, limit: int) -> DataFrame:
    """Unit normal per point from its neighbours, flipped towards +Z."""
    def normals(owner: np.ndarray, count: int, xyz: list[np.ndarray], d2: np.ndarray) -> dict[str, np.ndarray]:
        n = np.bincount(owner, minlength=count)
        mean = lambda v: np.bincount(owner, v, count) / n
        x, y, z = xyz
        mx, my, mz = mean(x), mean(y), mean(z)
        axis, _ = least_axes(np.stack([mean(x * x) - mx * mx, mean(y * y) - my * my, mean(z * z) - mz * mz,
                                       mean(x * y) - mx * my, mean(x * z) - mx * mz, mean(y * z) - my * mz], axis=1))
        axis *= np.where(axis[:, 2] < 0, -1.0, 1.0)[:, None]
        axis[n < 3] = 0.0, 0.0, 1.0
        return {"nx": axis[:, 0].copy(), "ny": axis[:, 1].copy(), "nz": axis[:, 2].copy(), "neighbours": n}

    return fold_in_radius(points, keys, point_id, radius, limit, normals, "nx double, ny double, nz double, neighbours long")


def _ring(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise convex hull of distinct points in order."""
    if len(pts) < 3:
        return pts
    ring: list[tuple[float, float]] = []
    for ordered in (pts, pts[::-1]):
        chain: list[tuple[float, float]] = []
        for x, y in ordered:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                chain.pop()
            chain.append((x, y))
        ring += chain[:-1]
    return ring


def hull_vertices(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull of planar points."""
    return np.array(_ring(sorted(set(map(tuple, xy.tolist())))), dtype=float).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)


def _outer(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points that can be corners, each once, by group, x and y, and the bounds of the groups: of one x only the lowest and the highest."""
    x, y = (table[c].to_numpy() for c in ("hx", "hy"))
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((y, x, group))
    x, y, group = x[order], y[order], group[order]
    first = np.append(True, (x[1:] != x[:-1]) | (group[1:] != group[:-1]))
    last = np.append(first[1:], True)
    low = y[np.flatnonzero(first)]
    keep = first | (last & (y != np.repeat(low, np.diff(np.append(np.flatnonzero(first), len(y))))))
    return x[keep], y[keep], np.searchsorted(group[keep], np.arange(len(bounds)))


def hull_reduce(df: DataFrame, keys: list[str], x: str, y: str, few: int = 32) -> DataFrame:
    """Candidate hull vertices of every group, as its rows lie in the tasks.

    The hull of a union is the hull of the hulls, so pieces are reduced before they are shuffled and only the corners of a dominant
    group meet. Pieces of no more than ``few`` points are left to the last step.
    """
    names = [f.name for f in df.schema.fields if f.name in keys]
    flat = df.select(*names, F.col(x).cast("double").alias("hx"), F.col(y).cast("double").alias("hy")) \
        .filter(F.col("hx").isNotNull() & F.col("hy").isNotNull())

    def pieces(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                yield from corners(held)
                held, count = [], 0
        if count:
            yield from corners(held)

    def corners(held):
        table = pa.Table.from_batches(held).sort_by([(name, "ascending") for name in names]).combine_chunks()
        starts = begins(table, names)
        px, py, bounds = _outer(table, np.append(starts, len(table)))
        sizes, out = np.diff(bounds), []
        for g in np.flatnonzero(sizes > few).tolist():
            ring = _ring(list(zip(px[bounds[g]:bounds[g + 1]].tolist(), py[bounds[g]:bounds[g + 1]].tolist())))
            out.append((np.full(len(ring), g), np.array(ring)))
        rest = np.repeat(sizes <= few, sizes)
        group = np.concatenate([np.repeat(np.arange(len(sizes)), sizes)[rest], *[g for g, _ in out]])
        spots = np.concatenate([np.column_stack([px[rest], py[rest]]), *[p for _, p in out]])
        rows = pa.array(starts[group])
        yield from pa.table([*[table[name].take(rows) for name in names], pa.array(spots[:, 0].copy()), pa.array(spots[:, 1].copy())],
                            names=[*names, "hx", "hy"]).combine_chunks().to_batches()

    return flat.mapInArrow(pieces, flat.schema)


def convex_hulls(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area, bounds and ring of the convex hull of every group."""
    reduced = hull_reduce(df, keys, x, y)
    names = [f.name for f in reduced.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reduced.schema.fields if f.name in keys) + (
        ", hull_area double, min_x double, min_y double, max_x double, max_y double, ring array<array<double>>")

    def final(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        px, py, at = _outer(table, bounds)
        rings = [_ring(list(zip(px[a:b].tolist(), py[a:b].tolist()))) for a, b in zip(at[:-1], at[1:])]
        out = {name: table[name].take(pa.array(bounds[:-1])) for name in names}
        out["hull_area"] = pa.array([ring_area(np.array(ring)) for ring in rings], pa.float64())
        for name, edge, values in (("min_x", np.minimum, px), ("min_y", np.minimum, py), ("max_x", np.maximum, px), ("max_y", np.maximum, py)):
            out[name] = edge.reduceat(values, at[:-1])
        return pa.table(out | {"ring": pa.array([[list(p) for p in ring] for ring in rings], pa.list_(pa.list_(pa.float64())))})

    return map_groups(reduced, names, schema, final)
