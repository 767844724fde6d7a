"""Plain union of rings: slabs in one loop, outlines by chaining surviving pieces."""

from __future__ import annotations

import numpy as np

from roomfold.operators.polygons import _crossing_xs, _segments


def _spans(ring: np.ndarray, x: float) -> np.ndarray:
    """Sorted ordinates where a vertical line meets a ring, paired inside-out."""
    nxt = np.roll(ring, -1, axis=0)
    over = (ring[:, 0] <= x) != (nxt[:, 0] <= x)
    p, q = ring[over], nxt[over]
    return np.sort(p[:, 1] + (x - p[:, 0]) / (q[:, 0] - p[:, 0]) * (q[:, 1] - p[:, 1])).reshape(-1, 2)


def slab_area(rings: list[np.ndarray], minimum: int) -> float:
    """Area covered by at least ``minimum`` of the rings.

    Between consecutive vertices and crossings every boundary is a straight line, so
    width times covered length at the middle of the slab is exact.
    """
    cuts = [ring[:, 0] for ring in rings]
    for i, ring in enumerate(rings):
        cuts += [_crossing_xs(ring, other) for other in rings[i + 1:]]
    xs = np.unique(np.concatenate(cuts))
    total = 0.0
    for x0, x1 in zip(xs[:-1], xs[1:]):
        marks = []
        for ring in rings:
            for low, high in _spans(ring, (x0 + x1) / 2.0):
                marks += [(low, 1), (high, -1)]
        depth, last, covered = 0, 0.0, 0.0
        for y, change in sorted(marks):
            if depth >= minimum:
                covered += y - last
            depth, last = depth + change, y
        total += covered * (x1 - x0)
    return total


def outline_pieces(rings: list[np.ndarray], tolerance: float = 1e-7) -> list[np.ndarray]:
    """Closed outlines of a union of counter-clockwise rings, outer ones counter-clockwise.

    Edges are split where rings meet; a piece survives when it lies in no other ring and
    does not run along an opposite edge. Surviving pieces are chained end to end.
    """
    pieces: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    key = lambda v: tuple(np.round(v / tolerance / 10).astype(np.int64))
    rings = [r if _signed(r) > 0 else r[::-1] for r in rings]
    for i, ring in enumerate(rings):
        for p, q in zip(*_segments(ring)):
            length = float(np.linalg.norm(q - p))
            if length <= tolerance:
                continue
            u = (q - p) / length
            stops = [0.0, length]
            for j, other in enumerate(rings):
                if j == i:
                    continue
                for r, s in zip(*_segments(other)):
                    d = s - r
                    cross = u[0] * d[1] - u[1] * d[0]
                    if abs(cross) > 1e-12:
                        w = r - p
                        t = (w[0] * d[1] - w[1] * d[0]) / cross
                        v = (w[0] * u[1] - w[1] * u[0]) / cross
                        if -1e-9 <= v <= 1 + 1e-9:
                            stops.append(t)
                    else:
                        stops += [float((r - p) @ u), float((s - p) @ u)]
            stops = np.unique(np.clip(np.round(stops, 9), 0.0, length))
            for t0, t1 in zip(stops[:-1], stops[1:]):
                if t1 - t0 <= tolerance:
                    continue
                mid = p + u * (t0 + t1) / 2
                left, right = mid + np.array([-u[1], u[0]]) * tolerance * 4, mid - np.array([-u[1], u[0]]) * tolerance * 4
                inside = lambda v: any(_contains(o, v) for o in rings)
                if inside(left) and not inside(right):
                    a, b = p + u * t0, p + u * t1
                    pieces[(key(a), key(b))] = (a, b)
    starts: dict[tuple, list[tuple]] = {}
    for edge in pieces:
        starts.setdefault(edge[0], []).append(edge)
    loops = []
    while pieces:
        edge = next(iter(pieces))
        loop = []
        while edge in pieces:
            a, _ = pieces.pop(edge)
            loop.append(a)
            onward = [e for e in starts.get(edge[1], []) if e in pieces]
            if not onward:
                break
            edge = onward[0]
        loops.append(_simplify(np.array(loop)))
    return [loop for loop in loops if len(loop) >= 3]


def _signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2.0)


def _contains(ring: np.ndarray, v: np.ndarray) -> bool:
    nxt = np.roll(ring, -1, axis=0)
    over = (ring[:, 1] > v[1]) != (nxt[:, 1] > v[1])
    p, q = ring[over], nxt[over]
    return bool((p[:, 0] + (v[1] - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]) > v[0]).sum() % 2)


def _simplify(loop: np.ndarray) -> np.ndarray:
    """Drop vertices in the middle of a straight run."""
    if len(loop) < 3:
        return loop
    before, after = loop - np.roll(loop, 1, axis=0), np.roll(loop, -1, axis=0) - loop
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    return loop[bend > 1e-9]
