"""Cross-frame matching: descriptors, two-view checks, planar fits, cloud registration, drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import FrameConfig, StitchConfig
from roomfold.functions import rigid
from roomfold.functions.scores import connection_score, visual_score
from roomfold.operators.clouds import block_cells
from roomfold.operators.groups import map_frames, map_groups
from roomfold.operators.ordering import top_per_group
from roomfold.session import fresh


def descriptor_matches(first: DataFrame, second: DataFrame, pair: list[str], cfg: StitchConfig = StitchConfig(),
                       block: int = 2048) -> DataFrame:
    """Nearest neighbour of every descriptor that passes the ratio test against the second nearest.

    Exact search over bounded blocks: either side of a pair is cut into blocks of at most
    about ``block`` rows, every block pair yields its two nearest, and those are merged.
    The rows of one block pair are all a task ever holds.
    """
    types = dict(first.dtypes)
    names = [f.name for f in first.schema.fields if f.name in pair]
    schema = ", ".join(f"{k} {types[k]}" for k in names) + f", a_id {types['a_id']}, b_id {dict(second.dtypes)['b_id']}, d2 double"
    columns = [*names, "a_id", "b_id", "d2"]

    def blocked(df: DataFrame, key: str, own: str) -> DataFrame:
        sizes = df.groupBy(*pair).agg(F.ceil(F.count("*") / block).cast("int").alias(f"_n{own}"))
        return df.join(sizes, pair).withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.col(f"_n{own}")).cast("int")), sizes

    left, left_sizes = blocked(first, "a_id", "i")
    right, right_sizes = blocked(second, "b_id", "j")
    spread = lambda df, other, sizes, size: df.join(sizes, pair).withColumn(
        f"_{other}", F.explode(F.sequence(F.lit(0), F.col(size) - 1))).drop("_ni", "_nj")
    left = spread(left.drop("_ni"), "j", right_sizes, "_nj").select(*pair, "_i", "_j", "a_id", "descriptor")
    right = spread(right.drop("_nj"), "i", left_sizes, "_ni").select(*pair, "_i", "_j", "b_id", "descriptor")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        b = b.sort_values("b_id")
        x, y = np.vstack(a["descriptor"]).astype(float), np.vstack(b["descriptor"]).astype(float)
        d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)
        k = min(2, len(b))
        order = np.argsort(d2, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), k)
        picked = order.ravel()
        exact = ((x[rows] - y[picked]) ** 2).sum(axis=1)
        out = pd.DataFrame({"a_id": a["a_id"].to_numpy()[rows], "b_id": b["b_id"].to_numpy()[picked], "d2": exact})
        for name in names:
            out[name] = a[name].iloc[0]
        return out[columns]

    group = [*pair, "_i", "_j"]
    near = left.groupBy(*group).cogroup(fresh(right).groupBy(*group)).applyInPandas(nearest, schema)
    two = top_per_group(near, [*pair, "a_id"], [F.col("d2"), F.col("b_id")], 2, "_rank")
    pairs = two.groupBy(*pair, "a_id").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("b_id"))).alias("b_id"), F.max(F.when(F.col("_rank") == 1, F.sqrt("d2"))).alias("distance"),
        F.max(F.when(F.col("_rank") == 2, F.sqrt("d2"))).alias("second_distance"))
    return pairs.filter(F.col("distance") < cfg.ratio_test * F.col("second_distance"))


def _epipolar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fundamental matrix of normalised point pairs (eight or more)."""
    def scaled(p):
        centre = p.mean(axis=0)
        s = math.sqrt(2) / max(np.linalg.norm(p - centre, axis=1).mean(), 1e-12)
        t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
        return np.column_stack([p, np.ones(len(p))]) @ t.T, t
    ha, ta = scaled(a)
    hb, tb = scaled(b)
    rows = (hb[:, :, None] * ha[:, None, :]).reshape(len(a), 9)
    f = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, s, vt = np.linalg.svd(f)
    return tb.T @ (u @ np.diag([s[0], s[1], 0.0]) @ vt) @ ta


def _epipolar_error(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ha, hb = (np.column_stack([p, np.ones(len(p))]) for p in (a, b))
    la, lb = ha @ f.T, hb @ f
    off = np.abs((hb * la).sum(axis=1))
    return np.maximum(off / np.maximum(np.hypot(la[:, 0], la[:, 1]), 1e-12), off / np.maximum(np.hypot(lb[:, 0], lb[:, 1]), 1e-12))


def _homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(a, b):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    return np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)


def _homography_error(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.column_stack([a, np.ones(len(a))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        q = p[:, :2] / p[:, 2:]
    return np.nan_to_num(np.linalg.norm(q - b, axis=1), nan=np.inf)


def _consensus(a, b, size, fit, error, limit, rng, rounds=2000, confidence=0.995):
    """Largest inlier set over seeded minimal samples, stopping at the wanted confidence."""
    best = np.zeros(len(a), bool)
    need, tried = rounds, 0
    while tried < need and len(a) >= size:
        pick = rng.choice(len(a), size, replace=False)
        tried += 1
        try:
            inside = error(fit(a[pick], b[pick]), a, b) <= limit
        except np.linalg.LinAlgError:
            continue
        if inside.sum() > best.sum():
            best = inside
            share = min(best.mean() ** size, 1 - 1e-12)
            if share > 0:
                need = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(1 - share))) + 1)
    return best


def verify_pairs(matches: DataFrame, pair: list[str], cfg: StitchConfig = StitchConfig(), seed: int = 0) -> DataFrame:
    """Geometric inliers per frame pair: epipolar, or planar when too few agree.

    A group is the matches of one frame pair, bounded by the feature budget of an image.
    Columns: match_id, ax, ay, bx, by.
    """
    types = dict(matches.dtypes)
    names = [f.name for f in matches.schema.fields if f.name in pair]
    schema = ", ".join(f"{k} {types[k]}" for k in names) + f", match_id {types['match_id']}, inlier boolean"

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("match_id")
        a, b = pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by"]].to_numpy(float)
        inside = np.zeros(len(pdf), bool)
        if len(pdf) >= 8:
            rng = np.random.default_rng(seed)
            inside = _consensus(a, b, 8, _epipolar, _epipolar_error, 1.5, rng)
            if inside.sum() < cfg.min_inliers:
                inside = _consensus(a, b, 4, _homography, _homography_error, 2.0, rng)
        out = pdf[[*names, "match_id"]].copy()
        out["inlier"] = inside
        return out

    return map_frames(matches.select(*names, "match_id", "ax", "ay", "bx", "by"), pair, schema, check)


PLANAR = ["_sn", "_sbx", "_sby", "_sax", "_say", "_cc", "_cs"]


def planar_sums() -> list[Column]:
    bx, by, ax, ay = (F.col(c) for c in ("bx", "by", "ax", "ay"))
    return [F.count("*").alias("_sn"), F.sum(bx).alias("_sbx"), F.sum(by).alias("_sby"), F.sum(ax).alias("_sax"), F.sum(ay).alias("_say"),
            F.sum(bx * ax + by * ay).alias("_cc"), F.sum(bx * ay - by * ax).alias("_cs")]


def planar_fit(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Fixed-scale planar transform (b to a) in closed form from sums that add."""
    n = F.col("_sn")
    mbx, mby, max_, may = (F.col(c) / n for c in ("_sbx", "_sby", "_sax", "_say"))
    cos_part = F.col("_cc") - n * (mbx * max_ + mby * may)
    sin_part = F.col("_cs") - n * (mbx * may - mby * max_)
    staged = sums.select(*keys, n.alias("support"), F.atan2(sin_part, cos_part).alias("yaw"), mbx.alias("_bx"), mby.alias("_by"),
                         max_.alias("_ax"), may.alias("_ay"))
    c, s = F.cos("yaw"), F.sin("yaw")
    return staged.select(*keys, "support", "yaw", (F.col("_ax") - (c * F.col("_bx") - s * F.col("_by"))).alias("tx"),
                         (F.col("_ay") - (s * F.col("_bx") + c * F.col("_by"))).alias("ty"))


def fit_se2(points: DataFrame, keys: list[str]) -> DataFrame:
    return planar_fit(points.groupBy(*keys).agg(*planar_sums()), keys)


def _residual() -> Column:
    c, s = F.cos("yaw"), F.sin("yaw")
    return F.hypot(c * F.col("bx") - s * F.col("by") + F.col("tx") - F.col("ax"), s * F.col("bx") + c * F.col("by") + F.col("ty") - F.col("ay"))


def robust_se2(points: DataFrame, keys: list[str], cfg: StitchConfig = StitchConfig(), seed: int = 0,
               block: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Consensus planar transform per pair, refitted on its inliers, and the inlier rows.

    Two-point hypotheses come from a hash order; their support is counted over salted
    blocks of points, so one huge pair is scored side by side. Columns: i, bx, by, ax, ay.
    """
    want = 2 * cfg.ransac_iterations
    types = dict(points.dtypes)
    names = [f.name for f in points.schema.fields if f.name in keys]
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_size"), F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    # Small pairs are drawn several times over, each time in another hash order.
    repeats = F.least(F.lit(cfg.ransac_iterations), F.ceil(F.lit(want) / F.col("_size"))).cast("int")
    drawn = points.join(sizes, keys).withColumn("_round", F.explode(F.sequence(F.lit(1), repeats)))
    draw = F.pmod(F.xxhash64(F.col("i"), F.col("_round"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    kept = drawn.withColumn("_h", draw).filter(F.col("_h") <= F.lit(want * 1.5 + 50) / F.col("_size"))
    order = Window.partitionBy(*keys).orderBy("_round", "_h", "i")
    ranked = kept.withColumn("_r", F.row_number().over(order) - 1).filter(F.col("_r") < want)
    pairs = ranked.withColumn("hypothesis", F.floor(F.col("_r") / 2).cast("int"))
    group = [*keys, "hypothesis"]
    sums = pairs.groupBy(*group).agg(*planar_sums(), F.min("bx").alias("_x0"), F.max("bx").alias("_x1"), F.min("by").alias("_y0"), F.max("by").alias("_y1"))
    wide = sums.filter((F.col("_sn") == 2) & (F.hypot(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) >= 0.05))
    models = planar_fit(wide, group).drop("support")
    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", hypothesis int, hits long"
    side = ["_a", "_b", "_c", "_d"]
    laid = lambda df, hypothesis, *values: df.select(*keys, "_salt", hypothesis.alias("hypothesis"), *[v.cast("double").alias(c) for c, v in zip(side, values)])
    salted = points.join(sizes, keys).withColumn("_salt", F.pmod(F.xxhash64("i"), F.col("_parts")).cast("int"))
    copies = models.join(sizes, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # Points have no hypothesis; models bring yaw and shift.
    both = laid(salted, F.lit(None).cast("int"), *[F.col(c) for c in ("bx", "by", "ax", "ay")]).unionByName(
        laid(copies, F.col("hypothesis"), F.col("yaw"), F.col("tx"), F.col("ty"), F.lit(0.0)))

    def count(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        values, point = np.stack([table[c].to_numpy() for c in side]), table["hypothesis"].is_null().to_numpy()
        rows, hits = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            trial = low + np.flatnonzero(~point[low:high])
            spots = values[:, low:high][:, point[low:high]]
            if not len(trial) or not spots.shape[1]:
                continue
            (yaw, tx, ty), total = values[:3, trial], np.zeros(len(trial), np.int64)
            c, s = np.cos(yaw), np.sin(yaw)
            for start in range(0, spots.shape[1], 2000):  # bounds the products of points and models
                bx, by, ax, ay = spots[:, start:start + 2000, None]
                total += (np.hypot(bx * c - by * s + tx - ax, bx * s + by * c + ty - ay) <= cfg.ransac_distance).sum(axis=0)
            rows.append(trial)
            hits.append(total)
        at = pa.array(np.concatenate(rows))
        return pa.table({k: table[k].take(at) for k in (*names, "hypothesis")} | {"hits": pa.array(np.concatenate(hits))})

    hits = map_groups(both, [*keys, "_salt"], schema, count).groupBy(*group).agg(F.sum("hits").alias("hits"))
    best = top_per_group(hits.filter(F.col("hits") >= cfg.min_inliers), keys, [F.col("hits").desc(), F.col("hypothesis")], 1)
    chosen = models.join(best, group).drop("hypothesis", "hits")
    first = points.join(chosen, keys).filter(_residual() <= cfg.ransac_distance).drop("yaw", "tx", "ty")
    refit = fit_se2(first, keys)
    inliers = points.join(refit.drop("support"), keys).filter(_residual() <= cfg.ransac_distance).drop("yaw", "tx", "ty")
    return refit, inliers


def vertical_agreement(inliers: DataFrame, keys: list[str], cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Metric inliers that also agree in height, and whether enough are left."""
    agree = F.abs(F.col("az") - F.col("bz")) <= cfg.ransac_distance * 2
    return inliers.groupBy(*keys).agg(F.count_if(agree).alias("metric_inliers")).withColumn(
        "supported", F.col("metric_inliers") >= cfg.min_inliers)


def score_pairs(pairs: DataFrame, cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Scores and acceptance of frame-pair evidence from match and inlier counts."""
    raw, inl, metric = F.col("raw_matches"), F.col("inliers"), F.col("metric_inliers")
    ratio = inl / F.greatest(raw, F.lit(1))
    visual = visual_score(inl, raw, cfg.min_inliers)
    geometry = metric / F.greatest(inl, F.lit(1))
    score = connection_score(visual, geometry)
    known = F.col("has_transform")
    return (pairs.withColumn("visual", visual).withColumn("geometry", geometry).withColumn("score", score)
            .withColumn("accepted", known & (raw >= cfg.min_matches) & (ratio >= cfg.min_inlier_ratio) & (F.col("score") >= cfg.acceptance))
            .withColumn("rejection_reason", F.when(~known, "metric_3d_correspondences_unavailable")))


def loop_candidates(frames: DataFrame, keys: list[str], cfg: FrameConfig = FrameConfig(), seq: str = "seq", pose: str = "pose") -> DataFrame:
    """Earlier frames close in space and direction, at least the separation back, nearest few per frame.

    Camera centres are copied to the cells of four search radii that they touch. A task reads its cells one after another, a frame
    is compared with all frames of its own cell in blocks, and only what it keeps leaves the task.
    """
    r, limit, cells = cfg.loop_radius, cfg.max_loops_per_frame, ["_x", "_y", "_z"]
    centre, turn = [f"_p{c}" for c in "xyz"], [f"_r{i}" for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]
    base = frames.select(*keys, seq, *[F.col(pose)[i].alias(c) for c, i in zip(centre, (3, 7, 11))], *[F.col(pose)[int(c[2:])].alias(c) for c in turn])
    home, touched = block_cells([F.col(c) for c in centre], r, cells, 4)
    known = base.select("*", *[h.alias(f"_h{c}") for h, c in zip(home, cells)], *touched)
    own = F.lit(True)
    for c in cells:
        known, own = known.withColumn(c, F.explode(c)), own & (F.col(c) == F.col(f"_h{c}"))
    copies = known.select(*keys, *cells, seq, *centre, *turn, own.alias("_asks"))
    types = dict(copies.dtypes)
    names = [f.name for f in copies.schema.fields if f.name in keys]

    def nearest(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        x, y, z = (table[c].to_numpy() for c in centre)
        turns, place = np.column_stack([table[c].to_numpy() for c in turn]), table[seq].to_numpy()
        asks = table["_asks"].to_numpy(zero_copy_only=False)
        target, source, gap = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            asking, step = low + np.flatnonzero(asks[low:high]), max(1, 1_000_000 // (high - low))
            for start in range(0, len(asking), step):
                ask = asking[start:start + step]
                dx, dy, dz = (v[ask, None] - v[None, low:high] for v in (x, y, z))
                distance = np.sqrt(dx * dx + dy * dy + dz * dz)
                angle = np.degrees(np.arccos(np.clip((turns[ask] @ turns[low:high].T - 1.0) / 2.0, -1.0, 1.0)))
                back = place[ask, None] - place[None, low:high]
                distance[~((distance <= r) & (angle <= cfg.loop_max_rotation) & (back >= cfg.loop_min_separation))] = np.inf
                row = np.arange(len(ask))
                for _ in range(min(limit, high - low)):
                    best = distance.argmin(axis=1)  # rows come by position: of equal distances the earliest frame
                    found = distance[row, best]
                    hit = np.isfinite(found)
                    if not hit.any():
                        break
                    target.append(ask[hit])
                    source.append(low + best[hit])
                    gap.append(found[hit])
                    distance[row, best] = np.inf
        at, of = (pa.array(np.concatenate(v)) for v in (target, source))
        out = {k: table[k].take(at) for k in names} | {"source": table[seq].take(of), "target": table[seq].take(at)}
        return pa.table(out | {"distance": pa.array(np.concatenate(gap))})

    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + f", source {types[seq]}, target {types[seq]}, distance double"
    return map_groups(copies, [*keys, *cells], schema, nearest, [seq])


def judge_registrations(records: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Acceptance of pair registrations with every failing reason, joined by semicolons."""
    loop = F.col("kind") == "loop"
    low = F.col("fitness") < F.when(loop, cfg.loop_min_fitness).otherwise(cfg.neighbor_min_fitness)
    rough = (F.col("fitness") == 0) | (F.col("rmse") > F.when(loop, cfg.loop_max_rmse).otherwise(cfg.neighbor_max_rmse))
    thin = loop & (F.least("fitness", "reverse_fitness") < cfg.loop_min_overlap)
    far = (F.col("translation_change") > cfg.max_translation_change) | (F.col("rotation_change") > cfg.max_rotation_change)
    reasons = F.array_compact(F.array(
        F.when(low, F.lit("low fitness")), F.when(rough, F.lit("insufficient correspondences or high RMSE")),
        F.when(thin, F.lit("low bidirectional overlap")), F.when(far, F.lit("excessive transform deviation"))))
    return records.withColumn("rejection_reason", F.nullif(F.concat_ws("; ", reasons), F.lit(""))).withColumn(
        "accepted", F.col("rejection_reason").isNull())


def _nearest(source: np.ndarray, target: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest target within radius (-1 if none), through a voxel hash of the target."""
    cell = np.floor(target / radius).astype(np.int64)
    low = cell.min(axis=0) - 2
    span = cell.max(axis=0) - low + 3
    code = lambda c: ((c[:, 0] - low[0]) * span[1] + (c[:, 1] - low[1])) * span[2] + (c[:, 2] - low[2])
    keys = code(cell)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    best, index = np.full(len(source), np.inf), np.full(len(source), -1)
    own = np.floor(source / radius).astype(np.int64)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dz in (-1, 0, 1):
                near = own + [dx, dy, dz]
                ok = ((near >= low) & (near < low + span)).all(axis=1)
                wanted = code(near[ok])
                start, stop = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
                rows = np.flatnonzero(ok)
                width = stop - start
                rep = np.repeat(np.arange(len(rows)), width)
                if not len(rep):
                    continue
                offset = np.arange(len(rep)) - np.repeat(np.cumsum(width) - width, width)
                cand = order[start[rep] + offset]
                d = ((source[rows[rep]] - target[cand]) ** 2).sum(axis=1)
                sort = np.lexsort((cand, d, rows[rep]))
                who, first = np.unique(rows[rep][sort], return_index=True)
                dist, pick = d[sort][first], cand[sort][first]
                better = dist < best[who]
                best[who[better]], index[who[better]] = dist[better], pick[better]
    gap = np.sqrt(best)
    index[gap > radius] = -1
    return index, gap


def _evaluate(source, target, matrix, radius):
    moved = source @ matrix[:3, :3].T + matrix[:3, 3]
    index, gap = _nearest(moved, target, radius)
    hit = index >= 0
    rmse = float(np.sqrt(np.mean(gap[hit] ** 2))) if hit.any() else 0.0
    return float(hit.mean()), rmse, index, moved


def _point_to_plane(source, target, normals, matrix, radius, iterations):
    """Iterative closest point against target normals."""
    previous = (-1.0, -1.0)
    for _ in range(iterations):
        fitness, rmse, index, moved = _evaluate(source, target, matrix, radius)
        hit = index >= 0
        if hit.sum() < 6 or (abs(fitness - previous[0]) < 1e-6 and abs(rmse - previous[1]) < 1e-6):
            break
        previous = (fitness, rmse)
        p, q, n = moved[hit], target[index[hit]], normals[index[hit]]
        jac = np.column_stack([np.cross(p, n), n])
        gap = ((p - q) * n).sum(axis=1)
        step = np.linalg.lstsq(jac.T @ jac, -jac.T @ gap, rcond=None)[0]
        matrix = _twist(step) @ matrix
    return matrix


def _twist(step: np.ndarray) -> np.ndarray:
    w, t = step[:3], step[3:]
    angle = np.linalg.norm(w)
    out = np.eye(4)
    if angle > 1e-12:
        k = w / angle
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        out[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
    out[:3, 3] = t
    return out


def register_clouds(pairs: DataFrame, clouds: DataFrame, keys: list[str], cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Coarse and fine registration of frame pairs, evaluated both ways.

    ``pairs``: keys, source, target, kind, initial (16 values). ``clouds``: keys, frame_id, x, y, z,
    nx, ny, nz. One group is two keyframe clouds, each bounded by the per-frame point budget.
    """
    pair = [*keys, "source", "target"]
    types = dict(pairs.dtypes)
    names = [f.name for f in pairs.schema.fields if f.name in pair]
    schema = ", ".join(f"{k} {types[k]}" for k in names) + (
        ", kind string, initial array<double>, optimized array<double>, fitness_before double, rmse_before double, fitness double, rmse double, "
        "reverse_fitness double, information array<double>, translation_change double, rotation_change double")
    columns = [part.split()[0] for part in schema.split(", ")]
    side = lambda name, flag: pairs.join(clouds.withColumnRenamed("frame_id", name), [*keys, name]).select(*pair, F.lit(flag).alias("is_source"), "x", "y", "z", "nx", "ny", "nz")
    both = side("source", True).unionByName(side("target", False))

    def run(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or points.empty:
            return pd.DataFrame(columns=columns)
        row = rows.iloc[0]
        xyz, nrm = points[["x", "y", "z"]].to_numpy(float), points[["nx", "ny", "nz"]].to_numpy(float)
        mask = points["is_source"].to_numpy(bool)
        source, target, normals = xyz[mask], xyz[~mask], nrm[~mask]
        if not len(source) or not len(target):
            return pd.DataFrame(columns=columns)
        initial = np.array(row["initial"], float).reshape(4, 4)
        fit0, rmse0, _, _ = _evaluate(source, target, initial, cfg.icp_fine)
        matrix = _point_to_plane(source, target, normals, initial, cfg.icp_coarse, cfg.icp_iterations)
        matrix = _point_to_plane(source, target, normals, matrix, cfg.icp_fine, cfg.icp_iterations)
        fit1, rmse1, index, _ = _evaluate(source, target, matrix, cfg.icp_fine)
        back, _, _, _ = _evaluate(target, source, np.linalg.inv(matrix), cfg.icp_fine)
        spots = target[index[index >= 0]]
        info = np.zeros((6, 6))
        for x, y, z in spots:
            g = np.array([[0, z, -y, 1, 0, 0], [-z, 0, x, 0, 1, 0], [y, -x, 0, 0, 0, 1]])
            info += g.T @ g
        delta = np.linalg.inv(initial) @ matrix
        turn = float(np.degrees(np.arccos(np.clip((np.trace(delta[:3, :3]) - 1) / 2, -1, 1))))
        out = {k: row[k] for k in names}
        out.update(kind=row["kind"], initial=list(initial.ravel()), optimized=list(matrix.ravel()), fitness_before=fit0, rmse_before=rmse0 if fit0 else None, fitness=fit1,
                   rmse=rmse1 if fit1 else None, reverse_fitness=back, information=list(info.ravel()),
                   translation_change=float(np.linalg.norm(delta[:3, 3])), rotation_change=turn)
        return pd.DataFrame([out], columns=columns)

    return pairs.groupBy(*pair).cogroup(fresh(both).groupBy(*pair)).applyInPandas(run, schema)


def planar_refinement(refined: DataFrame, cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Take only x, y and yaw of a registration, and only when it is good enough."""
    good = (F.col("fitness") >= cfg.registration_min_fitness) & (F.col("rmse") <= cfg.registration_max_rmse)
    m = F.col("optimized")
    return refined.withColumn("relative_transform", F.when(good, rigid.se2(m[3], m[7], F.atan2(m[4], m[0]))).otherwise(F.col("planar_initial")))


def _log_rotations(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of a stack of rotations."""
    angle = np.arccos(np.clip((np.trace(r, axis1=-2, axis2=-1) - 1) / 2, -1, 1))
    skew = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], -1)
    small = angle < 1e-8
    return skew * np.where(small, 0.5, angle / np.where(small, 1.0, 2 * np.sin(angle)))[..., None]


def _anchored(count: int, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether the given edges join every node to the first one."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return not label.any()
        label = after


def _settle(poses: np.ndarray, i: np.ndarray, j: np.ndarray, transform: np.ndarray, information: np.ndarray, uncertain: np.ndarray, iterations: int) -> np.ndarray:
    """Damped Gauss-Newton over all edges of a capture at once, the first pose fixed.

    Normal equations are solved directly where edges of full rank and weight tie every pose to the first; otherwise
    some direction is free and the shortest step is taken.
    """
    count, size = len(poses), 6 * len(poses)
    back = np.linalg.inv(transform)
    nudges = np.array([_twist(v) for v in 1e-6 * np.eye(6)])
    unnudge = np.linalg.inv(nudges)
    values = np.linalg.eigvalsh((information + information.transpose(0, 2, 1)) / 2)
    sound = ~uncertain & (values[:, 0] > 1e-9 * values[:, -1])
    direct = _anchored(count, i[sound], j[sound])
    scale = np.trace(information, axis1=1, axis2=2) / 6

    def vector(d):
        return np.concatenate([_log_rotations(d[..., :3, :3]), d[..., :3, 3]], -1)

    def gaps(p):
        between = np.linalg.inv(p[j]) @ p[i]
        return between, vector(back @ between)

    def costs(e):
        return np.einsum("ea,eab,eb->e", e, information, e)

    weights, damping = np.ones(len(i)), 1e-6
    for _ in range(iterations):
        between, e = gaps(poses)
        cost = costs(e)
        # loops that keep disagreeing lose their weight
        weights[uncertain] = (scale[uncertain] / (scale[uncertain] + cost[uncertain])) ** 2
        ends = [(i, (vector((back @ between)[:, None] @ nudges) - e[:, None]).transpose(0, 2, 1) / 1e-6),
                (j, (vector(back[:, None] @ unnudge @ between[:, None]) - e[:, None]).transpose(0, 2, 1) / 1e-6)]
        h, g = np.zeros((count, count, 6, 6)), np.zeros((count, 6))
        for a, ja in ends:
            pull = weights[:, None, None] * ja.transpose(0, 2, 1) @ information
            np.add.at(g, a, np.einsum("eab,eb->ea", pull, e))
            for b, jb in ends:
                np.add.at(h, (a, b), pull @ jb)
        matrix = h.transpose(0, 2, 1, 3).reshape(size, size)[6:, 6:] + damping * np.eye(size - 6)
        right = -g.reshape(-1)[6:]
        step = np.zeros(0) if count < 2 else np.linalg.solve(matrix, right) if direct else np.linalg.lstsq(matrix, right, rcond=None)[0]
        trial = poses.copy()
        for k in range(1, count):
            trial[k] = poses[k] @ _twist(step[6 * k - 6:6 * k])
        if (weights * costs(gaps(trial)[1])).sum() <= (weights * cost).sum():
            poses, damping = trial, max(damping / 10, 1e-12)
            if np.abs(step).max(initial=0) < 1e-8:
                break
        else:
            damping *= 100
            if damping > 1e8:
                break
    return poses


def correct_drift(frames: DataFrame, edges: DataFrame, keys: list[str], iterations: int = 50) -> DataFrame:
    """Pose graph with the first frame fixed: neighbour and accepted loop edges, weak priors for rejected neighbours.

    ``frames``: keys, seq, pose; ``edges``: keys, source, target, transform, information, uncertain.
    A group is one capture's keyframes, at most the keyframe budget.
    """
    names = [f.name for f in frames.schema.fields if f.name in keys]
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", seq long, pose array<double>"
    columns = [*names, "seq", "pose"]

    def solve(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=columns)
        nodes = nodes.sort_values("seq")
        poses = np.array(nodes["pose"].tolist(), float).reshape(-1, 4, 4)
        seqs = nodes["seq"].to_numpy()
        used = links[links["source"].isin(seqs) & links["target"].isin(seqs)]
        if len(used):
            poses = _settle(poses, np.searchsorted(seqs, used["source"].to_numpy()), np.searchsorted(seqs, used["target"].to_numpy()),
                            np.array(used["transform"].tolist(), float).reshape(-1, 4, 4), np.array(used["information"].tolist(), float).reshape(-1, 6, 6),
                            used["uncertain"].to_numpy(bool), iterations)
        out = pd.DataFrame({"seq": seqs, "pose": list(poses.reshape(-1, 16))})
        for k in names:
            out[k] = nodes[k].iloc[0]
        return out[columns]

    return frames.select(*names, "seq", "pose").groupBy(*keys).cogroup(fresh(edges).groupBy(*keys)).applyInPandas(solve, schema)


def graph_edges(records: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Edges of the pose graph: accepted fits, and device poses with weak information for rejected neighbours."""
    weak = F.array(*[F.lit(cfg.weak_prior_information if r == c else 0.0) for r in range(6) for c in range(6)])
    used = records.filter(F.col("accepted") | (F.col("kind") == "neighbor"))
    return used.withColumn("transform", F.when(F.col("accepted"), F.col("optimized")).otherwise(F.col("initial"))) \
        .withColumn("information", F.when(F.col("accepted"), F.col("information")).otherwise(weak)) \
        .withColumn("uncertain", F.col("kind") == "loop")


def drift_comparison(records: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Constraint residuals of every edge before and after correction."""
    side = lambda name, alias: poses.select(*keys, F.col("seq").alias(name), F.col("pose").alias(alias))
    both = records.join(side("source", "_pi"), [*keys, "source"]).join(side("target", "_pj"), [*keys, "target"])
    both = both.withColumn("_rel", rigid.compose(rigid.invert(F.col("_pj")), F.col("_pi")))
    both = both.withColumn("_before", rigid.compose(rigid.invert(F.col("optimized")), F.col("initial"))) \
        .withColumn("_after", rigid.compose(rigid.invert(F.col("optimized")), F.col("_rel")))
    return both.select(*keys, "source", "target", "kind", "accepted",
                       *[f(F.col(f"_{when}")).alias(f"{name}_{when}") for when in ("before", "after")
                         for name, f in (("translation", rigid.translation_norm), ("rotation", rigid.rotation_degrees))])


def pose_corrections(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    joined = before.select(*keys, "seq", F.col("pose").alias("_a")).join(after.select(*keys, "seq", F.col("pose").alias("_b")), [*keys, "seq"])
    shift = sum(((F.col("_a")[i] - F.col("_b")[i]) * (F.col("_a")[i] - F.col("_b")[i]) for i in (7, 11)), (F.col("_a")[3] - F.col("_b")[3]) * (F.col("_a")[3] - F.col("_b")[3]))
    return joined.select(*keys, "seq", F.sqrt(shift).alias("translation_m"), rigid.relative_rotation_degrees(F.col("_a"), F.col("_b")).alias("rotation_degrees"))
