"""Steps that were made cheaper: the same results, and one pass where several were taken."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roomfold.operators import clouds, folds, integrity, rings
from roomfold.plans import matching as matching_plans, results, sources
from roomfold.sources import exports


@pytest.mark.parametrize("coords", [["u"], ["u", "v"]])
def test_small_keys_share_a_pass_and_number_alike(spark, coords, monkeypatch):
    draw = random.Random(8)
    rows = [(k, draw.randint(0, 40) / 8, draw.randint(0, 9) / 8, n) for n in range(900) for k in (draw.choice("aab"),)] + [
        ("c", 1.0, None, 901), ("c", None, 1.0, 902), ("c", float("nan"), 1.0, 903), ("c", float("nan"), 1.0, 904), (None, 1.0, 1.0, 905)]
    rows += [("c", 0.0, 2.0, 906), ("c", -0.0, 2.0, 907)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, u double, v double, o long").withColumn("b", F.floor(F.col("o") / 50))
    leaders, want, at = {}, {}, [1, 2][:len(coords)]
    for row in sorted(rows, key=lambda r: r[3]):
        if row[0] is None or any(row[i] is None for i in at):
            continue
        own = leaders.setdefault(row[0], [])
        spot = [row[i] for i in at]
        same = lambda a, b: math.dist(a, b) <= .4 or str(a) == str(b)
        hit = next((i for i, leader in enumerate(own) if same(leader, spot)), len(own))
        if hit == len(own):
            own.append(spot)
        want[row[3]] = hit + 1
    # the reference path: some keys above the bound, then all
    for small in (450, 0):
        got = folds.leader_members(df.filter("k <> 'c'"), ["k"], coords, ["o"], .4, "b", 37, small)
        assert {r.o: r.group_no for r in got.collect()} == {o: n for o, n in want.items() if o < 901}
    monkeypatch.setattr(folds, "leader_groups", None)
    got = folds.leader_members(df, ["k"], coords, ["o"], .4, "b").collect()
    assert {r.o: r.group_no for r in got} == want


def test_documents_shuffle_each_fact_once(spark):
    plan = results.documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # orders and line items, once each


def test_captures_without_parts_keep_their_documents(spark):
    from roomfold.operators import documents, measurements
    from roomfold.plans.results import measure
    rooms = spark.createDataFrame([("a", "lidar", "ra"), ("b", "photo", "rb")], "capture_id string, tier string, room_id string").withColumn(
        "floor_area", measure(F.lit(4.0), "m2"))
    parts = spark.createDataFrame([("a", "w2", 2.0, True), ("a", "w1", 1.0, False)], "capture_id string, wall_id string, size double, door boolean")
    wall = lambda e: F.struct(e["wall_id"].alias("wall_id"), measure(e["size"], "m").alias("length"), F.create_map(F.lit("residual_m"), F.lit("0.5")).alias("metadata"))
    opening = lambda e: F.struct(F.concat(F.lit("o"), e["wall_id"]).alias("opening_id"), measure(e["size"], "m").alias("width"))
    damage = lambda e: F.struct(e["wall_id"].alias("damage_id"))
    whole = documents.assemble_results(rooms, parts, "wall_id", wall, (lambda e: e["door"], opening), (lambda e: e["size"] > 9, damage))
    a, b = (r.property for r in whole.orderBy("capture.capture_id").collect())
    assert [w.wall_id for w in a.rooms[0].walls] == ["w1", "w2"] and a.rooms[0].opening_ids == ["ow2"] and [o.opening_id for o in a.openings] == ["ow2"]
    assert a.rooms[0].damage_ids is None and b.rooms[0].walls is None and b.openings is None
    got = {(r.capture_id, r.measurement_id): (r.measurement_type, r.value, r.residual_m) for r in measurements.unpivot_results(whole).collect()}
    assert got == {**{(c, i): (k, 4.0, None) for c in "ab" for i, k in (("property:total_floor_area", "total_floor_area"), (f"r{c}:floor", "floor_area"))},
                   ("a", "w1:wall_length"): ("wall_length", 1.0, .5), ("a", "w2:wall_length"): ("wall_length", 2.0, .5), ("a", "ow2:opening_width"): ("opening_width", 2.0, None)}


def test_intervals_do_not_shuffle_their_rows(spark):
    plan = results.measurement_intervals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_odometry_of_many_captures_in_one_file(spark, tmp_path):
    (tmp_path / "all.csv").write_text("capture_id, frame, x, y, z, qx, qy, qz, qw\n a,1,1,0,0,0,0,0,1\nb ,1,5,0,0,0,0,0,1\na,1,2,0,0,0,0,0,1\nb,x,9,0,0,0,0,0,1\n")
    assert sorted((r.capture_id, r.frame_id, r.x) for r in exports.read_odometry(spark, str(tmp_path / "all.csv")).collect()) == [("a", 1, 2.0), ("b", 1, 5.0)]


def test_odometry_writes_fewer_files_than_captures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "stage_path", lambda spark, name: str(tmp_path / name))
    captures = sources.odometry_scan(spark, "/root/testdata/sf0.01").select("capture_id").distinct().count()
    assert len(list(tmp_path.glob("odometry/**/part-*.csv"))) <= 8 < captures


def test_neighbours_are_folded_where_they_are_found(spark):
    draw = random.Random(5)
    rows = [(g, i, *(0.25 * draw.randint(-6, 6) for _ in range(3))) for g in "ab" for i in range(150)] + [("c", 1, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "g string, point_id long, x double, y double, z double")
    near = clouds.nearest_in_radius(points, ["g"], "point_id", 0.6, 5).groupBy("g", "point_id").agg(F.count("*").alias("n"), F.sum(F.sqrt("d2")).alias("s"))
    want = {(r.g, r.point_id): (r.n, round(r.s, 9)) for r in near.collect()}
    folded = clouds.fold_in_radius(points, ["g"], "point_id", 0.6, 5, clouds.distances, "neighbours long, distance_sum double")
    assert {(r.g, r.point_id): (r.neighbours, round(r.distance_sum, 9)) for r in folded.collect()} == want and len(want) == len(rows)
    for out in (folded, clouds.point_normals(points, ["g"], "point_id", 0.6, 5)):  # nothing is grouped after the search
        assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_planar_models_are_counted_without_frames_of_a_group(spark):
    plan = matching_plans.robust_planar_fit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan


def test_projections_stay_out_of_join_conditions(spark):
    plan = matching_plans.scale_correspondences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("px" in line or "pose" in line for line in joins)


def test_documents_are_searched_in_one_pass(spark):
    from pyspark.sql import types as T
    shape = T.StructType.fromDDL("schema_version string, a struct<b:array<struct<c:struct<d:int>>>, m:map<string,string>>, e int")
    rows = [(1, '{"schema_version": "1.0.0", "a": {"b": [{"c": {"d": 1}}, {"c": {"x": [1]}}, 3], "m": {"q": "1"}}, "e": {}}'),
            (2, '{"schema_version": 2, "a": {"b": {}, "m": [], "b2": null}, "e": null}'), (3, "null"), (4, "[1"), (5, None), (6, '{"a": {"b": [], "m": null}}'), (7, "{}")]
    out = integrity.nested_unknown_keys(spark.createDataFrame(rows, "capture_id int, body string"), "body", shape)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "FileScan" not in plan  # nothing is written and read back between the levels
    assert sorted(map(tuple, out.collect())) == [
        (1, "unknown_key", "a.b[1].c.x"), (1, "wrong_kind", "a.b[2]"), (1, "wrong_kind", "e"), (2, "schema_version", "2"), (2, "unknown_key", "a.b2"),
        (2, "wrong_kind", "a.b"), (2, "wrong_kind", "a.m"), (3, "wrong_kind", "$"), (4, "malformed_document", "$"), (5, "malformed_document", "$")]


def test_rings_of_small_groups_take_one_pass(spark, monkeypatch):
    draw, rows = random.Random(4), []
    for g in range(6):
        names = draw.sample(range(-500, 500), 40)  # the same edges occur in several groups
        while names:
            ring = [names.pop() for _ in range(min(len(names), draw.choice([1, 2, 3, 7, 16])))]
            rows += [(g, e, f, str(e)) for e, f in zip(ring, ring[1:] + ring[:1])]
    rows += [(7, 1, 2, "1"), (7, 2, 3, "2"), (7, 9, 9, "9")]  # runs into an edge that is not there
    links = spark.createDataFrame(rows, "g int, edge long, next long, note string").repartition(3)
    take = lambda small: sorted(map(tuple, rings.trace_rings(links, ["g"], carry=["note"], small=small).collect()))
    want = take(0)
    assert take(20) == want and len(want) == len(rows) - 2
    monkeypatch.setattr(rings, "grown", None)
    assert take(100) == want
