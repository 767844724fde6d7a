"""Wall merging, ring closure and their helpers against plain versions."""

import math
import random

import pytest

from roomfold.config import GeometryConfig
from roomfold.operators import planes
from roomfold.operators.rings import first_fit_spots, trace_rings


def test_rings_of_any_length(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for group, lengths in enumerate(([1], [2, 3], [7, 1, 64], [1000])):
        ids = list(range(sum(lengths)))
        draw.shuffle(ids)
        for n in lengths:
            ring, ids = ids[:n], ids[n:]
            start = ring.index(min(ring))
            ring = ring[start:] + ring[:start]
            rows += [(group, e, ring[(i + 1) % n]) for i, e in enumerate(ring)]
            want.update({(group, e): (ring[0], n, i) for i, e in enumerate(ring)})
    out = trace_rings(spark.createDataFrame(rows, "g int, edge long, next long"), ["g"]).collect()
    assert {(r.g, r.edge): (r.ring, r["size"], r.position) for r in out} == want


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_spots(spark, seed):
    draw = random.Random(seed)
    rows = [(g, n, draw.random() * 3, draw.random() * 3) for g in range(3) for n in range(60)]
    out = first_fit_spots(spark.createDataFrame(rows, "g int, n int, x double, y double"), ["g"], 0.6).collect()
    kept, want = {}, {}
    for g, n, x, y in rows:
        home = next((m for m, p, q in kept.setdefault(g, []) if math.hypot(x - p, y - q) <= 0.6), n)
        want[g, n] = home
        if home == n:
            kept[g].append((n, x, y))
    assert {(r.g, r.n): r.spot for r in out} == want


def test_disjoint_pairs_are_maximal(spark):
    draw = random.Random(9)
    rows = sorted({(g, a, b) for g in range(5) for a in range(8) for b in range(a + 1, 9) if draw.random() < 0.3})
    out = {(r.g, r.a_plane_no, r.b_plane_no) for r in planes.disjoint_pairs(spark.createDataFrame(rows, "g int, a_plane_no int, b_plane_no int"), ["g"]).collect()}
    want, used = set(), set()
    for g, a, b in rows:
        if not {(g, a), (g, b)} & used:
            want.add((g, a, b))
            used |= {(g, a), (g, b)}
    assert out == want


def strip(plane, x0, x1, y, first, n=200):
    """Points of a wall along x, every one at another height."""
    return [("r", plane, first + i, x0 + (x1 - x0) * i / (n - 1), float(y), 2.5 * ((i * 7) % n) / n) for i in range(n)]


def test_chains_of_pieces_become_one_wall(spark):
    rows = strip(1, 0, 2, 0, 0) + strip(4, 1.95, 4, 0, 1000) + strip(2, 3.95, 6, 0, 2000) + strip(7, 5.95, 8, 0, 3000)
    rows += [("r", 4, *row[2:]) for row in strip(1, 0, 2, 0, 0)[150:]]  # points that two pieces share
    rows += strip(3, 0, 8, 0.3, 4000) + strip(9, 9, 11, 0, 5000)  # parallel but apart; in line but apart
    members = spark.createDataFrame(rows, "room string, plane_no int, point_id long, x double, y double, z double")
    walls = members.select("room", "plane_no").distinct()
    merged, sets = planes.merge_walls(walls, members, ["room"])
    assert {(r.plane_no, r.n) for r in merged.collect()} == {(1, 800), (3, 200), (9, 200)}
    assert sets.count() == 1200 == sets.select("point_id").distinct().count()


def room(name, corners, skip=(), shift=0.0):
    """Wall segments and the true crossings of a ring of corners."""
    out = []
    for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])):
        if i not in skip:
            out.append((name, i + 1, f"wall_{i + 1:02d}", float(a[0]) + shift, float(a[1]), float(b[0]), float(b[1]), math.dist(a, b), 0.9))
    return out


def test_rooms_that_close_and_rooms_that_do_not(spark):
    star = [(0, 0), (4, 0), (4, 3), (2, 1.5), (0, 3)]
    rows = room("square", [(0, 0), (3, 0), (3, 3), (0, 3)]) + room("bend", [(0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5)])
    rows += room("open", [(0, 0), (3, 0), (3, 3), (0, 3)], skip=[2]) + room("notch", star) + room("small", [(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)])
    many = [(10 * math.cos(t * math.pi / 12), 10 * math.sin(t * math.pi / 12)) for t in range(24)]
    rows += room("round", many[::-1])
    segments = spark.createDataFrame(rows, "room string, wall_no int, wall_id string, x0 double, y0 double, x1 double, y1 double, length double, quality double")
    crossings = planes.wall_crossings(segments, ["room"], GeometryConfig(min_intersection_degrees=5.0))
    out = {r.room: r for r in planes.close_polygons(segments, crossings, ["room"]).collect()}
    assert {k: r.area and round(r.area, 6) for k, r in out.items()} == {
        "square": 9.0, "bend": 21.0, "open": None, "notch": 9.0, "small": None, "round": round(12 * 100 * math.sin(math.pi / 12), 6)}
    for r in out.values():
        if r.ring:
            ring = [(p.x, p.y) for p in r.ring]
            assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) > 0 and r.closure_error < 1e-9
    assert len(out["round"].ring) == 24 and out["open"].corners == 2


def test_a_room_whose_walls_cross_has_no_polygon(spark):
    bow = [(0, 0), (4, 0), (0, 3), (4, 3)]
    rows = room("bow", bow)
    segments = spark.createDataFrame(rows, "room string, wall_no int, wall_id string, x0 double, y0 double, x1 double, y1 double, length double, quality double")
    corners = [("bow", i, (i % 4) + 1, float(bow[i][0]), float(bow[i][1])) for i in range(4)]
    hits = spark.createDataFrame([(r, min(a or 4, b), max(a or 4, b), x, y) for r, a, b, x, y in corners], "room string, a_wall_no int, b_wall_no int, x double, y double")
    got = planes.close_polygons(segments, hits, ["room"], GeometryConfig(min_polygon_area=0.0)).collect()[0]
    assert got.corners == 4 and got.ring is None


def test_plane_budget_leaves_an_issue(spark):
    rows = [("r", float(i % 20), float(i // 20), 0.5 * (i % 3), i) for i in range(900)] + [("s", float(i % 20), float(i // 20), 0.0, i) for i in range(200)]
    points = spark.createDataFrame(rows, "room string, x double, y double, z double, point_id long")
    cfg = GeometryConfig(max_planes=2, ransac_iterations=60)
    found = planes.extract_planes(points, ["room"], cfg)
    issues = planes.plane_budget_issues(points, found, ["room"], cfg).collect()
    assert [(r.room, r.code, r.points_left) for r in issues] == [("r", "PLANE_BUDGET_REACHED", 300)]
    assert planes.plane_budget_issues(points, planes.extract_planes(points, ["room"], GeometryConfig(ransac_iterations=60)), ["room"]).count() == 0


def test_a_crossing_right_at_the_reach_counts(spark):
    rows = [("r", 1, "wall_01", 0.0, 0.0, 1.7, 0.0, 1.7, 0.9), ("r", 2, "wall_02", 2.0, 0.0, 2.0, 3.0, 3.0, 0.9),  # 2.0 - 1.7 > 0.3 in doubles
            ("s", 1, "wall_01", 0.0, 0.0, 1.699, 0.0, 1.699, 0.9), ("s", 2, "wall_02", 2.0, 0.0, 2.0, 3.0, 3.0, 0.9)]
    segments = spark.createDataFrame(rows, "room string, wall_no int, wall_id string, x0 double, y0 double, x1 double, y1 double, length double, quality double")
    assert [(r.room, r.x, r.y) for r in planes.wall_crossings(segments, ["room"]).collect()] == [("r", 2.0, 0.0)]
