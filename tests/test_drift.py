"""Pose graphs: the batched solver against one edge at a time, and in reasonable time."""

import time

import numpy as np
import pytest

from roomfold.operators import matching


def pose(rng, scale):
    return matching._twist(rng.normal(0, scale, 6))


def log(d):
    angle = np.arccos(np.clip((np.trace(d[:3, :3]) - 1) / 2, -1, 1))
    skew = np.array([d[2, 1] - d[1, 2], d[0, 2] - d[2, 0], d[1, 0] - d[0, 1]])
    return np.concatenate([skew / 2 if angle < 1e-8 else skew * angle / (2 * np.sin(angle)), d[:3, 3]])


def plain(poses, edges, rounds=50):
    """Gauss-Newton with one dense system, edge by edge."""
    size, damping, weight = 6 * len(poses), 1e-6, [1.0] * len(edges)
    gap = lambda p, i, j, t: log(np.linalg.inv(t) @ np.linalg.inv(p[j]) @ p[i])
    total = lambda p: sum(w * gap(p, i, j, t) @ info @ gap(p, i, j, t) for (i, j, t, info, _), w in zip(edges, weight))
    for _ in range(rounds):
        h, g = np.zeros((size, size)), np.zeros(size)
        for n, (i, j, t, info, uncertain) in enumerate(edges):
            e = gap(poses, i, j, t)
            if uncertain:
                scale = np.trace(info) / 6
                weight[n] = (scale / (scale + e @ info @ e)) ** 2
            jac = np.zeros((6, size))
            for node in (i, j):
                for k in range(6):
                    moved = poses.copy()
                    moved[node] = poses[node] @ matching._twist(1e-6 * np.eye(6)[k])
                    jac[:, 6 * node + k] = (gap(moved, i, j, t) - e) / 1e-6
            g += weight[n] * jac.T @ info @ e
            h += weight[n] * jac.T @ info @ jac
        base = total(poses)
        step = np.linalg.lstsq(h[6:, 6:] + damping * np.eye(size - 6), -g[6:], rcond=None)[0]
        trial = np.array([poses[0]] + [poses[k] @ matching._twist(step[6 * k - 6:6 * k]) for k in range(1, len(poses))])
        if total(trial) <= base:
            poses, damping = trial, max(damping / 10, 1e-12)
            if np.abs(step).max() < 1e-8:
                break
        else:
            damping *= 100
            if damping > 1e8:
                break
    return poses


def scene(seed, count, loops, loose=False):
    """True poses that drift, neighbour edges, some of them weak, loops of which one is wrong; a loose scene has a gap."""
    rng = np.random.default_rng(seed)
    true = [np.eye(4)]
    for _ in range(count - 1):
        true.append(true[-1] @ pose(rng, 0.2))
    seen = np.array([true[0]] + [p @ pose(rng, 0.02) for p in true[1:]])
    links = [(i, i + 1, False) for i in range(count - 1) if not (loose and i == count // 2)] + [
        tuple(sorted(rng.choice(count, 2, replace=False).tolist())) + (True,) for _ in range(loops)]
    edges = []
    for n, (i, j, uncertain) in enumerate(links):
        step = np.linalg.inv(true[j]) @ true[i] @ pose(rng, 0.4 if uncertain and n == len(links) - 1 else 0.003)
        edges.append((i, j, step, np.eye(6) * (0.01 if n % 4 == 1 else 100.0 + n), uncertain))
    return seen, edges


def solved(spark, scenes):
    nodes = [(str(c), s, p.ravel().tolist()) for c, (seen, _) in enumerate(scenes) for s, p in enumerate(seen)]
    links = [(str(c), i, j, t.ravel().tolist(), info.ravel().tolist(), u) for c, (_, edges) in enumerate(scenes) for i, j, t, info, u in edges]
    got = matching.correct_drift(spark.createDataFrame(nodes, "capture_id string, seq long, pose array<double>"), spark.createDataFrame(
        links, "capture_id string, source long, target long, transform array<double>, information array<double>, uncertain boolean"), ["capture_id"])
    return {(int(r.capture_id), r.seq): np.array(r.pose).reshape(4, 4) for r in got.collect()}


def test_drift_equals_one_edge_at_a_time(spark):
    scenes = [scene(1, 9, 3), scene(2, 6, 0), scene(3, 8, 0, loose=True), (scene(4, 1, 0)[0], []), scene(5, 12, 5)]
    got = solved(spark, scenes)
    for c, (seen, edges) in enumerate(scenes):
        want = plain(seen, edges) if edges else seen
        for s in range(len(seen)):
            assert got[c, s] == pytest.approx(want[s], abs=1e-6)


def test_full_captures_settle_quickly(spark):
    scenes = [scene(seed, 80, 20) for seed in range(40)]
    solved(spark, [scene(0, 3, 0)])
    start = time.time()
    assert len(solved(spark, scenes)) == 40 * 80
    assert time.time() - start < 30
