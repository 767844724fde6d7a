"""Many groups share one pass of a Python kernel; none is cut."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from roomfold.config import GeometryConfig, PhotoConfig
from roomfold.functions import images
from roomfold.operators import clouds, folds, graph, matching, planes
from roomfold.operators.groups import map_groups, runs


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_runs_keep_groups_whole():
    draw = np.random.default_rng(3)
    sizes = [1, 1, 40, 3, 900, 2, 1, 7]
    names = [None, "a", "b", "c", "d", "e", "f", "g"]
    rows = pa.table({"g": [n for n, k in zip(names, sizes) for _ in range(k)], "v": range(sum(sizes))})
    for _ in range(20):
        cuts = sorted({0, len(rows), *draw.integers(0, len(rows), 30).tolist()})
        batches = [rows.slice(a, b - a).combine_chunks().to_batches()[0] for a, b in zip(cuts, cuts[1:])]
        got = []
        for table, bounds in runs(batches, ["g"], rows=50):
            assert bounds[0] == 0 and bounds[-1] == len(table)
            got += [table.slice(a, b - a).to_pydict() for a, b in zip(bounds, bounds[1:])]
        assert [len(g["v"]) for g in got] == sizes and [set(g["g"]) for g in got] == [{n} for n in names]
        assert [v for g in got for v in g["v"]] == list(range(len(rows)))


def test_groups_share_a_pass(spark):
    rows = spark.range(20_000).select((F.col("id") % 4_000).alias("g"), F.col("id").alias("v")).repartition(3)

    def count(table, bounds):
        return pa.table({"g": table["g"].take(pa.array(bounds[:-1])), "n": np.diff(bounds), "groups": np.full(len(bounds) - 1, len(bounds) - 1)})

    out = map_groups(rows, ["g"], "g long, n long, groups long", count).toPandas()
    assert len(out) == 4_000 and (out["n"] == 5).all() and out["groups"].min() > 100


def test_forest_takes_no_pass_for_each_property(spark):
    rows = [(f"p{p}", 3 * p + i, "ab"[i > 1], "bc"[i > 0], s) for p in range(50) for i, s in enumerate((0.5, None, 0.7))]
    edges = spark.createDataFrame(rows, "property_id string, connection_id long, room_a string, room_b string, score double")
    tree = graph.spanning_edges(edges)
    assert "FlatMapGroupsInPandas" not in plan(tree)
    assert {r.connection_id for r in tree.collect()} == {3 * p + i for p in range(50) for i in (0, 2)}


def test_hulls_share_a_pass(spark):
    draw = np.random.default_rng(8)
    sizes = [1, 2, 3, 40, 5_000, 1_000, 7, 60]
    spots = [np.round(draw.normal(size=(n, 2)), 1 if i % 2 else 6) for i, n in enumerate(sizes)] + [np.repeat([[1.0, 2.0], [1.0, 4.0], [1.0, 3.0]], 9, axis=0)]
    rows = pd.DataFrame([(g if g else None, *p) for g, points in enumerate(spots) for p in points], columns=["g", "x", "y"]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows.astype({"g": "Int64"}).astype(object).where(rows.notna(), None).values.tolist(), "g long, x double, y double").repartition(3)
    out = clouds.convex_hulls(df, ["g"], "x", "y")
    assert "FlatMapGroupsInPandas" not in plan(out)
    got = {r.g or 0: r for r in out.collect()}
    assert len(got) == len(spots)
    for g, points in enumerate(spots):
        ring = clouds.hull_vertices(points)
        assert got[g].ring == ring.tolist() and got[g].hull_area == clouds.ring_area(ring)
        assert [got[g].min_x, got[g].min_y, got[g].max_x, got[g].max_y] == [*points.min(axis=0), *points.max(axis=0)]


def test_small_and_large_rooms_have_the_same_planes(spark):
    draw = np.random.default_rng(4)
    rows = []
    for room, n in (("a", 700), ("b", 260), ("c", 90), (None, 400)):
        flat = draw.uniform(0, 4, (n, 3))
        flat[:n // 2, 2], flat[n // 2:n // 4 * 3, 0] = 0.0, 2.5
        rows += [(room, i, *map(float, p)) for i, p in enumerate(flat)]
    points = spark.createDataFrame(rows, "room string, point_id long, x double, y double, z double").filter("room IS NOT NULL")
    cfg = GeometryConfig(ransac_iterations=200, min_plane_inliers=40)
    small = planes.extract_planes(points, ["room"], cfg)
    assert "FlatMapCoGroupsInPandas" not in plan(small)
    listed = lambda df: sorted((r.room, r.point_id, r.plane_no) for r in df.collect())
    found = listed(small)
    assert {(r, p) for r, _, p in found} >= {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)}
    assert listed(planes.extract_planes(points, ["room"], cfg, small=0)) == found
    assert listed(planes.extract_planes(points, ["room"], cfg, small=300)) == found


def test_image_statistics_come_in_pieces():
    draw = np.random.default_rng(2)
    grey = [draw.integers(0, 255, 12).astype(float) for _ in range(700)]
    batch = (pd.Series(grey), pd.Series([3] * 700), pd.Series([4] * 700))
    out = list(images.statistics_of(iter([batch, batch])))
    assert max(map(len, out)) <= images.PIECE and sum(map(len, out)) == 1_400
    rows = pd.concat(out, ignore_index=True)
    for i in (0, 699, 700, 1_399):
        image = grey[i % 700].reshape(3, 4)
        assert rows["brightness"][i] == image.mean() and np.array_equal(rows["thumb"][i], images.thumbnail(image).ravel())


def test_photos_and_pairs_take_no_pass_for_each_group(spark):
    rows = [(g, i, [float((7 * i + g) % 23)] * 4) for g in range(60) for i in range(20)]
    photos = spark.createDataFrame(rows, "g long, seq long, thumb array<double>")
    cfg = PhotoConfig(max_images=5)
    out = folds.select_photos(photos, ["g"], cfg)
    assert "FlatMapGroupsInPandas" not in plan(out)
    got = {(r.g, r.seq): r.rejection_reason for r in out.collect()}
    assert len(got) == len(rows)
    for g in range(60):
        chosen = []
        for _, i, thumb in (r for r in rows if r[0] == g):
            near = any(abs(thumb[0] - c) < cfg.duplicate for c in chosen)
            want = "near_duplicate" if near else "selection_budget" if len(chosen) >= 5 else None
            if want is None:
                chosen.append(thumb[0])
            if len(chosen) >= cfg.min_images:
                assert got[g, i] == want
    draw = np.random.default_rng(6)
    pairs = pd.DataFrame([(g, i, *map(float, draw.uniform(0, 100, 2))) for g in range(30) for i in range(5 + g % 9)], columns=["g", "match_id", "ax", "ay"])
    checked = matching.verify_pairs(spark.createDataFrame(pairs.assign(bx=pairs["ax"] + 3, by=pairs["ay"])), ["g"])
    assert "FlatMapGroupsInPandas" not in plan(checked)
    sizes = pairs.groupby("g").size()
    assert all(r.inliers == (r.n if sizes[r.g] >= 8 else 0) for r in checked.groupBy("g").agg(F.count("*").alias("n"), F.count_if("inlier").alias("inliers")).collect())
