"""Measures of rings: area, centroid, bounds, edges, distances, overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _next(ring: Column) -> Column:
    """Ring shifted by one vertex, closing back to the first."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _fold(ring: Column, term) -> Column:
    pairs = F.arrays_zip(ring.alias("p"), _next(ring).alias("q"))
    terms = F.transform(pairs, lambda e: term(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return _fold(ring, lambda x0, y0, x1, y1: x0 * y1 - x1 * y0) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> tuple[Column, Column]:
    scale = F.nullif(signed_area(ring), F.lit(0.0)) * 6.0
    cx = _fold(ring, lambda x0, y0, x1, y1: (x0 + x1) * (x0 * y1 - x1 * y0)) / scale
    cy = _fold(ring, lambda x0, y0, x1, y1: (y0 + y1) * (x0 * y1 - x1 * y0)) / scale
    return cx, cy


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def edges(df: DataFrame, keys: list[str], ring: str) -> DataFrame:
    """One row per polygon edge, the last one closing the ring."""
    pairs = F.arrays_zip(F.col(ring).alias("p"), _next(F.col(ring)).alias("q"))
    return df.select(*keys, F.posexplode(pairs).alias("edge_no", "_e")).select(
        *keys, "edge_no", F.col("_e.p.x").alias("x0"), F.col("_e.p.y").alias("y0"),
        F.col("_e.q.x").alias("x1"), F.col("_e.q.y").alias("y1"))


def move_ring(matrix: Column, ring: Column) -> Column:
    """Ring under a planar rigid transform."""
    return F.transform(ring, lambda p: F.struct(
        (matrix[0] * p["x"] + matrix[1] * p["y"] + matrix[2]).alias("x"),
        (matrix[3] * p["x"] + matrix[4] * p["y"] + matrix[5]).alias("y")))


def as_array(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], dtype=float)


def _crossing_xs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Abscissae where edges of two rings cross."""
    p, r = a, np.roll(a, -1, axis=0) - a
    q, s = b, np.roll(b, -1, axis=0) - b
    cross = r[:, None, 0] * s[None, :, 1] - r[:, None, 1] * s[None, :, 0]
    d = q[None] - p[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[None, :, 1] - d[..., 1] * s[None, :, 0]) / cross
        u = (d[..., 0] * r[:, None, 1] - d[..., 1] * r[:, None, 0]) / cross
        hit = np.isfinite(t) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (p[:, None, 0] + t * r[:, None, 0])[hit]


def _segments(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ring, np.roll(ring, -1, axis=0)


def _point_segments(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    p, q = _segments(ring)
    d = q - p
    square = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((points[:, None] - p[None]) * d[None]).sum(axis=2) / square, 0.0, 1.0)
    return np.linalg.norm(points[:, None] - (p[None] + t[..., None] * d[None]), axis=2)


def boundary_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Smallest distance between two ring boundaries; zero when they cross."""
    if len(_crossing_xs(a, b)):
        return 0.0
    return float(min(_point_segments(a, b).min(), _point_segments(b, a).min()))


def shared_length(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> float:
    """Length over which two boundaries coincide."""
    (p, q), (r, s) = _segments(a), _segments(b)
    length = np.linalg.norm(q - p, axis=1)
    real = length > tolerance
    p, q, length = p[real], q[real], length[real]
    u = (q - p) / length[:, None]
    off = [np.abs((v[None, :, 0] - p[:, None, 0]) * u[:, None, 1] - (v[None, :, 1] - p[:, None, 1]) * u[:, None, 0]) for v in (r, s)]
    along = [((v[None] - p[:, None]) * u[:, None]).sum(axis=2) for v in (r, s)]
    both = np.minimum(length[:, None], np.maximum(*along)) - np.maximum(0.0, np.minimum(*along))
    return float(np.maximum(both, 0.0)[np.maximum(*off) <= tolerance].sum())


def _span_table(ring: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Ordinates where vertical lines meet a ring, paired inside-out: (line, span, 2), padded with infinities."""
    nxt = np.roll(ring, -1, axis=0)
    over = (ring[None, :, 0] <= xs[:, None]) != (nxt[None, :, 0] <= xs[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        y = ring[:, 1] + (xs[:, None] - ring[:, 0]) / (nxt[:, 0] - ring[:, 0]) * (nxt[:, 1] - ring[:, 1])
    y = np.sort(np.where(over, y, np.inf), axis=1)
    return y[:, :max(2, int(over.sum(axis=1).max(initial=0)))].reshape(len(xs), -1, 2)


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two rings share, all slabs at once."""
    xs = np.unique(np.concatenate([a[:, 0], b[:, 0], _crossing_xs(a, b)]))
    if len(xs) < 2:
        return 0.0
    middle = (xs[:-1] + xs[1:]) / 2.0
    one, two = _span_table(a, middle)[:, :, None], _span_table(b, middle)[:, None]
    with np.errstate(invalid="ignore"):
        both = np.minimum(one[..., 1], two[..., 1]) - np.maximum(one[..., 0], two[..., 0])
    return float((np.nan_to_num(np.maximum(both, 0.0)).sum(axis=(1, 2)) * np.diff(xs)).sum())


PAIR = T.StructType([T.StructField(n, T.DoubleType()) for n in ("overlap_area", "shared_length")])


def _crossings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_crossing_xs`` of stacked pairs (pair, vertex, 2): the abscissae of all edge pairs, and which edges cross."""
    r, s = np.roll(a, -1, axis=1) - a, np.roll(b, -1, axis=1) - b
    cross = r[:, :, None, 0] * s[:, None, :, 1] - r[:, :, None, 1] * s[:, None, :, 0]
    d = b[:, None] - a[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[:, None, :, 1] - d[..., 1] * s[:, None, :, 0]) / cross
        u = (d[..., 0] * r[:, :, None, 1] - d[..., 1] * r[:, :, None, 0]) / cross
        hit = np.isfinite(t) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return a[:, :, None, 0] + t * r[:, :, None, 0], hit


def _span_tables(ring: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """``_span_table`` of stacked rings: (pair, line, span, 2)."""
    nxt = np.roll(ring, -1, axis=1)
    low, high = ring[:, None], nxt[:, None]
    over = (low[..., 0] <= xs[..., None]) != (high[..., 0] <= xs[..., None])
    with np.errstate(divide="ignore", invalid="ignore"):
        y = low[..., 1] + (xs[..., None] - low[..., 0]) / (high[..., 0] - low[..., 0]) * (high[..., 1] - low[..., 1])
    y = np.where(over, y, np.inf)
    if y.shape[2] % 2:
        y = np.concatenate([y, np.full((*y.shape[:2], 1), np.inf)], axis=2)
    return np.sort(y, axis=2).reshape(*y.shape[:2], -1, 2)


def overlap_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlap_area`` of stacked pairs; where edges don't cross, a slab has no width."""
    x, hit = _crossings(a, b)
    xs = np.concatenate([a[..., 0], b[..., 0], np.where(hit, x, a[:, :1, None, 0]).reshape(len(a), -1)], axis=1)
    xs.sort(axis=1)
    middle = (xs[:, :-1] + xs[:, 1:]) / 2.0
    one, two = _span_tables(a, middle)[:, :, :, None], _span_tables(b, middle)[:, :, None]
    with np.errstate(invalid="ignore"):
        both = np.minimum(one[..., 1], two[..., 1]) - np.maximum(one[..., 0], two[..., 0])
    return (np.nan_to_num(np.maximum(both, 0.0)).sum(axis=(2, 3)) * np.diff(xs, axis=1)).sum(axis=1)


def shared_lengths(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """``shared_length`` of stacked pairs."""
    edge = np.roll(a, -1, axis=1) - a
    length = np.linalg.norm(edge, axis=2)
    real = length > tolerance
    u = (edge / np.where(real, length, 1.0)[..., None])[:, :, None]
    d = [v[:, None] - a[:, :, None] for v in (b, np.roll(b, -1, axis=1))]
    off = [np.abs(v[..., 0] * u[..., 1] - v[..., 1] * u[..., 0]) for v in d]
    along = [(v * u).sum(axis=3) for v in d]
    both = np.minimum(length[..., None], np.maximum(*along)) - np.maximum(0.0, np.minimum(*along))
    return np.where((np.maximum(*off) <= tolerance) & real[..., None], np.maximum(both, 0.0), 0.0).sum(axis=(1, 2))


def boundary_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``boundary_gap`` of stacked pairs."""
    def least(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
        d = (np.roll(ring, -1, axis=1) - ring)[:, None]
        away = points[:, :, None] - ring[:, None]
        t = np.clip((away * d).sum(axis=3) / np.maximum((d * d).sum(axis=3), 1e-300), 0.0, 1.0)
        return np.linalg.norm(away - t[..., None] * d, axis=3).min(axis=(1, 2))

    return np.where(_crossings(a, b)[1].any(axis=(1, 2)), 0.0, np.minimum(least(a, b), least(b, a)))


def _stacked(first: pd.Series, second: pd.Series, many, one, small: int = 64, work: int = 500_000) -> np.ndarray:
    """``many`` of ring pairs stacked by their numbers of vertices, ``one`` of each pair with more than ``small`` pairs of edges."""
    first, second = first.to_numpy(), second.to_numpy()
    sizes = np.array([(len(p) // 2, len(q) // 2) for p, q in zip(first, second)]).reshape(-1, 2)
    out = np.zeros(len(first))
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        step = max(1, work // (m * n + m + n) // (m * n)) if m and n and m * n <= small else 1
        for start in range(0, len(at), step):
            rows = at[start:start + step]
            a, b = (np.concatenate(v[rows]).reshape(len(rows), -1, 2).astype(float) for v in (first, second))
            out[rows] = many(a, b) if 0 < m * n <= small else one(a[0], b[0])
    return out


@F.pandas_udf(PAIR)
def _pair_measures(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"overlap_area": _stacked(first, second, overlap_areas, overlap_area), "shared_length": _stacked(first, second, shared_lengths, shared_length)})


@F.pandas_udf(T.DoubleType())
def _pair_gap(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series(_stacked(first, second, boundary_gaps, boundary_gap))


def _flat(ring: Column | str) -> Column:
    """x and y of all vertices as one list."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def pair_measures(first: Column | str, second: Column | str) -> Column:
    """Overlap area and shared boundary length of ring pairs."""
    return _pair_measures(_flat(first), _flat(second))


def pair_gap(first: Column | str, second: Column | str) -> Column:
    """Smallest distance between the boundaries of ring pairs."""
    return _pair_gap(_flat(first), _flat(second))


def near_pairs(rooms: DataFrame, keys: list[str], room: str, ring: str, cell: float = 4.0) -> DataFrame:
    """Room pairs whose bounding boxes meet, joined on shared grid cells.

    Only rooms in one cell meet, so the pairs of a large property stay local.
    """
    box = bounds(F.col(ring))
    span = lambda low, high: F.sequence(F.floor((box[low] - 1e-9) / cell), F.floor((box[high] + 1e-9) / cell))
    cells = (rooms.select(*keys, room, ring, *[v.alias(k) for k, v in box.items()],
                          F.explode(span("min_x", "max_x")).alias("_i"), span("min_y", "max_y").alias("_js"))
             .withColumn("_j", F.explode("_js")).drop("_js"))
    right = cells.select(*keys, "_i", "_j", *[F.col(c).alias(f"b_{c}") for c in (room, ring, "min_x", "min_y", "max_x", "max_y")])
    met = cells.join(right, [*keys, "_i", "_j"]).filter(
        (F.col(room) < F.col(f"b_{room}")) & (F.col("min_x") <= F.col("b_max_x")) & (F.col("b_min_x") <= F.col("max_x"))
        & (F.col("min_y") <= F.col("b_max_y")) & (F.col("b_min_y") <= F.col("max_y"))
        # Each pair is kept in the first cell both share.
        & (F.col("_i") == F.greatest(F.floor((F.col("min_x") - 1e-9) / cell), F.floor((F.col("b_min_x") - 1e-9) / cell)))
        & (F.col("_j") == F.greatest(F.floor((F.col("min_y") - 1e-9) / cell), F.floor((F.col("b_min_y") - 1e-9) / cell))))
    return met.select(*keys, room, f"b_{room}", ring, f"b_{ring}")
