"""Union area and outlines against plain loops."""

import math
import random

import numpy as np
import pytest

from roomfold.operators import footprint
from tests import brute_rings

SCHEMA = "property_id string, room_id int, ring array<struct<x:double,y:double>>"


def turned(corners, angle, dx, dy):
    c, s = math.cos(angle), math.sin(angle)
    return [(c * x - s * y + dx, s * x + c * y + dy) for x, y in corners]


def box(w, d):
    return [(0, 0), (w, 0), (w, d), (0, d)]


def scenes():
    draw = random.Random(12)
    bend = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 5), (0, 5)]
    out = {"one": [box(3, 2)], "apart": [box(1, 1), turned(box(1, 1), 0.4, 7, 3)], "same": [box(2, 2), box(2, 2)], "nested": [box(9, 9), turned(box(2, 2), 0, 3, 3)],
           "corner": [box(1, 1), turned(box(1, 1), 0, 1, 1)], "wall": [box(3, 3), turned(box(2, 3), 0, 3, 0), turned(box(5, 2), 0, 0, 3)],
           "frame": [box(6, 1), turned(box(6, 1), 0, 0, 5), turned(box(1, 6), 0, 0, 0), turned(box(1, 6), 0, 5, 0)], "bent": [bend, turned(bend, 1.1, 1, 1)],
           "backwards": [box(3, 2)[::-1], turned(box(3, 2), 0.3, 1, 0)[::-1]]}
    for n in (4, 9, 25):
        out[f"heap{n}"] = [turned(random.Random(i).choice([bend, box(3, 2), box(1, 4)]), draw.random() * 6, draw.random() * n, draw.random() * 6) for i in range(n)]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, [(float(x), float(y)) for x, y in ring]) for name, rings in scenes().items() for i, ring in enumerate(rings)]
    rows.append(("flat", 0, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]))
    placed = spark.createDataFrame(rows, SCHEMA)
    stacks = footprint.slabs(placed, ["property_id"])
    return ({r.property_id: r.union_area for r in footprint.union_areas(placed, ["property_id"]).collect()},
            footprint.outlines(stacks, ["property_id"]).collect(), {r.property_id: r for r in footprint.footprints(placed, ["property_id"]).collect()})


@pytest.mark.parametrize("name", list(scenes()))
def test_union_area(found, name):
    assert found[0][name] == pytest.approx(brute_rings.slab_area([np.array(r, float) for r in scenes()[name]], 1), abs=1e-6)


@pytest.mark.parametrize("name", list(scenes()))
def test_outlines(found, name):
    loops = brute_rings.outline_pieces([np.array(r, float) for r in scenes()[name]])
    signed = lambda v: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, [*v[1:], v[0]])) / 2
    rings = [r for r in found[1] if r.property_id == name]
    assert sum(r.area for r in rings) == pytest.approx(found[0][name], abs=1e-5)
    assert sorted(round(r.area, 4) for r in rings) == pytest.approx(sorted(signed([tuple(p) for p in v]) for v in loops), abs=2e-4)
    for r in rings:
        assert signed([(p.x, p.y) for p in r.outline]) == pytest.approx(r.area, abs=1e-5)


def test_shapes(found):
    areas, rings, whole = found
    of = lambda name: sorted((round(r.area, 6), len(r.outline)) for r in rings if r.property_id == name)
    assert of("wall") == [(25.0, 4)] and of("corner") == [(1.0, 4), (1.0, 4)] and of("frame") == [(-16.0, 4), (36.0, 4)]
    assert of("same") == [(4.0, 4)] and of("nested") == [(81.0, 4)]
    assert abs(areas.get("flat", 0)) < 1e-9 and len(whole["frame"].outlines) == 2 and whole["frame"].union_area == pytest.approx(20)


def test_one_large_property(spark):
    rows = [("p", 40 * i + j, [(3.0 * i, 3.0 * j), (3.0 * i + 3, 3.0 * j), (3.0 * i + 3, 3.0 * j + 3), (3.0 * i, 3.0 * j + 3)])
            for i in range(40) for j in range(40) if (i, j) != (20, 20)]
    out = footprint.footprints(spark.createDataFrame(rows, SCHEMA), ["property_id"]).collect()[0]
    assert out.union_area == pytest.approx(1599 * 9) and [len(o) for o in out.outlines] == [4, 4]
