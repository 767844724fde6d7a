"""Neighbour searches against all pairs, and what they may not send to the driver."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roomfold.config import FrameConfig
from roomfold.operators import clouds, matching, ordering
from roomfold.plans import clouds as cloud_plans, matching as matching_plans


def cloud(spark, seed, n=120):
    draw = random.Random(seed)
    rows = [(g, i, *(draw.choice([0.25, 1.0]) * draw.randint(-9, 9) for _ in range(3))) for g in ("a", "b") for i in range(n)] + [("c", 1, 0.0, 0.0, 0.0), ("c", 2, 90.0, 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "g string, point_id long, x double, y double, z double")


def nearest(rows, row, limit, radius=float("inf")):
    near = sorted((sum((p - q) * (p - q) for p, q in zip(row[2:], other[2:])), other[1]) for other in rows if other[0] == row[0])
    return [(d, i) for d, i in near if d <= radius * radius][:limit]


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_equal_all_pairs(spark, seed):
    rows, points = cloud(spark, seed)
    for got, limit, radius in ((clouds.nearest_in_radius(points, ["g"], "point_id", 0.6, 5), 5, 0.6), (clouds.nearest_k(points, ["g"], "point_id", 6, 0.3), 6, float("inf"))):
        want = sorted((r[0], r[1], d, i) for r in rows for d, i in nearest(rows, r, limit, radius))
        assert sorted((r.g, r.point_id, r.d2, r.b_id) for r in got.collect()) == want


def test_neighbour_search_broadcasts_no_copies(spark):
    points = cloud(spark, 7)[1]
    plan = clouds.nearest_in_radius(points, ["g"], "point_id", 0.6, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_outliers_go_and_nothing_is_broadcast(spark):
    rows = [("a", i, (i % 5) * 0.25, (i // 5 % 5) * 0.25, (i // 25) * 0.25) for i in range(100)] + [("a", 100, 9.0, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "g string, point_id long, x double, y double, z double")
    kept = clouds.drop_outliers(points, ["g"], "point_id", 8, 1.5, 0.3)
    assert sorted(r.point_id for r in kept.collect()) == list(range(100))
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_loops_equal_all_pairs_and_nothing_is_broadcast(spark):
    draw = random.Random(3)
    at = {(g, n): (0.05 * draw.randint(-9, 9), 0.05 * draw.randint(-9, 9), 1.4) for g in ("a", "b") for n in range(80)}
    rows = [(g, n, [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]) for (g, n), (x, y, z) in at.items()]
    frames = ordering.positions(spark.createDataFrame(rows, "g string, n long, pose array<double>"), ["g"], ["n"], F.floor(F.col("n") / 7))
    cfg = FrameConfig(loop_radius=0.12)
    out = matching.loop_candidates(frames, ["g"], cfg)
    want = set()
    for (g, n), p in at.items():
        near = sorted((math.dist(p, at[g, m]), m) for m in range(n - cfg.loop_min_separation + 1) if math.dist(p, at[g, m]) <= 0.12)
        want |= {(g, m, n) for _, m in near[:cfg.max_loops_per_frame]}
    assert {(r.g, r.source, r.target) for r in out.collect()} == want and want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_all_neighbours_in_the_radius_count(spark, monkeypatch):
    rows = [(1, 100 * x + 10 * y + z, 0.25 * x, 0.25 * y, 0.25 * z) for x in range(6) for y in range(6) for z in range(4)]
    points = spark.createDataFrame(rows, "capture_id long, point_id long, x double, y double, z double")
    monkeypatch.setattr(cloud_plans, "voxelised", lambda *_: points)
    want = {}
    for row in rows:
        near = [math.dist(row[2:], other[2:]) for other in rows if math.dist(row[2:], other[2:]) <= 0.6]
        want[row[1]] = (len(near), round(sum(near), 6))
    out = {r.point_id: (r.neighbours, r.distance_sum) for r in cloud_plans.radius_neighbours(spark, "").collect()}
    assert out == want and max(n for n, _ in want.values()) > 40


def test_loops_are_sought_over_the_whole_radius(spark, monkeypatch):
    places = [(0.0, 0.0), *[(5.0 + i, 9.0) for i in range(8)], (0.79, 0.5), (0.0, 0.81), (0.6, 0.0)]
    turned = [0.0] * 9 + [34.0, 0.0, 36.0]
    spin = lambda t: (math.cos(math.radians(t)), math.sin(math.radians(t)))
    rows = [(1, i, [c, -s, 0.0, x, s, c, 0.0, y - 0.5 * (i == 9), 0.0, 0.0, 1.0, 1.4, 0.0, 0.0, 0.0, 1.0]) for i, ((x, y), t) in enumerate(zip(places, turned)) for c, s in [spin(t)]]
    monkeypatch.setattr(matching_plans.FR, "posed", lambda *_: spark.createDataFrame(rows, "capture_id long, seq long, pose array<double>"))
    out = matching_plans.loop_candidates(spark, "").collect()
    assert [(r.source, r.target, r.distance) for r in out] == [(0, 9, 0.79)]
