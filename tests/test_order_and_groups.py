"""Order-dependent operators: small blocks must give what one block gives, and brute force agrees."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from roomfold.config import FrameConfig, PhotoConfig, VideoConfig
from roomfold.operators import clouds, folds, masks, quantiles
from roomfold.operators.ordering import positions
from tests import brute_grids


def poses(xs):
    return [[1.0, 0, 0, float(x), 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1] for x in xs]


def test_keyframes_compare_with_last_kept(spark):
    xs = np.cumsum(np.random.default_rng(1).uniform(0, .05, 60))
    pdf = pd.DataFrame({"g": "a", "seq": range(60), "pose": poses(xs)})
    df = spark.createDataFrame(pdf, "g string, seq long, pose array<double>")
    last, kept = None, []
    for i, x in enumerate(xs):
        if len(kept) < 10 and (last is None or x - last >= .08):
            kept.append(i)
            last = x
    cfg = FrameConfig(max_frames=10)
    for block in (7, 1000):
        out = folds.motion_keyframes(df, ["g"], cfg, block_rows=block).filter("selected")
        assert [r.seq for r in out.orderBy("seq").collect()] == kept


def test_visual_ladder_same_in_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 80), "brightness": rng.uniform(0, 60, 80), "blur": rng.uniform(10, 90, 80), "ts": np.arange(80) / 3,
                        "thumb": [[float(v)] * 4 for v in rng.integers(0, 40, 80)]})
    pdf["seq"] = pdf.groupby("g").cumcount()
    df = spark.createDataFrame(pdf)
    cfg = VideoConfig(max_keyframes=5, duplicate=3.0)
    take = lambda block: {(r.g, r.seq): r.rejection_reason for r in folds.visual_keyframes(df, ["g"], cfg, block_rows=block).collect()}
    assert take(9) == take(1000)
    assert "budget" in take(9).values()


def test_photo_selection_blocks_and_backfill(spark):
    pdf = pd.DataFrame({"g": ["a"] * 12 + ["b"] * 3, "seq": [*range(12), 0, 1, 2], "thumb": [[float(i * 10)] * 4 for i in range(12)] + [[1.0] * 4, [1.5] * 4, [1.2] * 4]})
    df = spark.createDataFrame(pdf)
    take = lambda block: {(r.g, r.seq): (r.selected, r.rejection_reason) for r in folds.select_photos(df, ["g"], PhotoConfig(), block_rows=block).collect()}
    out = take(4)
    assert out == take(100)
    assert sum(v[0] for k, v in out.items() if k[0] == "a") == 8
    assert out[("b", 1)] == (True, None) and out[("b", 2)] == (False, "near_duplicate")


def test_leader_groups_blocks_and_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"w": 1, "c": rng.uniform(0, 5, 120), "o": range(120)})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("o") / 10))
    leaders, want = [], {}
    for c in pdf["c"]:
        hit = next((i for i, l in enumerate(leaders) if abs(l - c) <= .25), None)
        if hit is None:
            leaders.append(c)
            hit = len(leaders) - 1
        want[c] = hit + 1
    for block in (13, 1000):
        out = folds.leader_groups(df, ["w"], ["c"], ["o"], .25, "b", block)
        assert {r.c: r.group_no for r in out.collect()} == want


def test_positions_and_quantiles_on_one_hot_group(spark):
    values = np.round(np.random.default_rng(4).normal(size=500), 2)
    pdf = pd.DataFrame({"g": [1] * 480 + [2] * 20, "v": values, "i": range(500)})
    df = spark.createDataFrame(pdf)
    ranked = positions(df, ["g"], ["i"], F.floor(F.col("i") / 17), "seq")
    assert ranked.filter("g = 1").agg(F.max("seq")).first()[0] == 479
    assert ranked.filter("g = 1 AND seq <> i").isEmpty()
    out = {r.g: r for r in quantiles.weighted_quantiles(df, ["g"], "v", {"a": .02, "b": .5, "c": .98}, .1).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose([out[g].a, out[g].b, out[g].c], np.quantile(part["v"], [.02, .5, .98]))


def test_hull_matches_support_function(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": rng.normal(size=3000), "y": rng.normal(size=3000)})
    out = {r.g: r for r in clouds.convex_hulls(spark.createDataFrame(pdf), ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        ring = np.array(out[g].ring)
        for angle in np.linspace(0, 6.28, 50):
            d = np.array([np.cos(angle), np.sin(angle)])
            assert np.isclose((ring @ d).max(), (part[["x", "y"]].to_numpy() @ d).max())
        assert np.isclose(out[g].hull_area, clouds.ring_area(ring))


def test_normals_of_a_plane(spark):
    g = np.stack(np.meshgrid(np.arange(12), np.arange(12)), -1).reshape(-1, 2) * .05
    pdf = pd.DataFrame({"c": 1, "point_id": range(len(g)), "x": g[:, 0], "y": g[:, 1], "z": g[:, 0] * .5})
    out = clouds.point_normals(spark.createDataFrame(pdf), ["c"], "point_id", .15, 30).toPandas()
    assert np.allclose(out[["nx", "ny", "nz"]], np.array([-.5, 0, 1]) / np.sqrt(1.25), atol=1e-6)


def grids():
    draw = np.random.default_rng(8)
    spiral = np.zeros((9, 9), bool)
    for k in range(0, 5, 2):
        spiral[k, k:9 - k] = spiral[k:9 - k, 8 - k] = spiral[8 - k, k:9 - k] = spiral[k + 2:9 - k, k] = True
        if k:
            spiral[k, k - 1] = True
    solid = np.ones((6, 6), bool)
    solid[3, 3] = False
    spur = np.zeros((6, 6), bool)
    spur[2, 2] = True
    out = {"spiral": spiral, "solid": solid, "spur": spur, "empty": np.zeros((3, 4), bool), "line": np.ones((1, 7), bool)}
    return out | {f"noise{i}": draw.random((12 + i, 15)) < 0.2 + 0.1 * i for i in range(6)}


def cell_rows(out, keys=("g",)):
    found = {}
    for r in out.collect():
        found.setdefault(r.g, set()).add((r.row, r.col))
    return found


def set_cells(mask):
    return set(zip(*(a.tolist() for a in np.nonzero(mask))))


def test_labels_and_morphology(spark):
    every = grids()
    cells = spark.createDataFrame([(name, r, c) for name, m in every.items() for r, c in set_cells(m)], "g string, row int, col int")
    sizes = spark.createDataFrame([(name, *m.shape) for name, m in every.items()], "g string, height int, width int")
    for size in (2, 3):
        for border in (False, True):
            got = cell_rows(masks.dilate(cells, sizes, ["g"], size, border))
            assert {n: got.get(n, set()) for n in every} == {n: set_cells(brute_grids.dilate(m, size, border)) for n, m in every.items()}
        got = cell_rows(masks.erode(cells, sizes, ["g"], size))
        assert {n: got.get(n, set()) for n in every} == {n: set_cells(brute_grids.erode(m, size)) for n, m in every.items()}
    for diagonal in (False, True):
        for source, unset in ((masks.runs(cells, ["g"]), False), (masks.gaps(masks.runs(cells, ["g"]), sizes, ["g"]), True)):
            want = {(n, r, c, int(k)) for n, m in every.items() for lab in [brute_grids.label(~m if unset else m, diagonal)] for (r, c), k in np.ndenumerate(lab) if k}
            got = {(x.g, x.row, c, x.component) for x in masks.regions(source, ["g"], diagonal).collect() for c in range(x.start, x.stop)}
            assert got == want


def test_many_small_islands_are_folded_in_few_tasks(spark):
    import time
    walls = spark.range(20_000).selectExpr("id AS w", "explode(array(0.0D, 0.5D, 0.6D, 3.0D)) AS c").selectExpr("w", "c", "cast(10 * c AS int) AS o", "0 AS b")
    start = time.time()
    out = folds.leader_groups(walls, ["w"], ["c"], ["o"], .25, "b").groupBy("c").agg(F.min("group_no").alias("low"), F.max("group_no").alias("high"), F.count("*").alias("n"))
    assert sorted(map(tuple, out.collect())) == [(0.0, 1, 1, 20_000), (0.5, 2, 2, 20_000), (0.6, 2, 2, 20_000), (3.0, 3, 3, 20_000)]
    assert time.time() - start < 40
