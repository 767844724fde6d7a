"""Nothing is lost or changed above any size: blocks, gaps, long lists, small budgets."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomfold.config import DamageConfig, OpeningConfig, StitchConfig
from roomfold.operators import damage, documents, folds, graph, openings
from roomfold.session import cut, drop_stages, shared_folder, stage_path
from roomfold.sources import sparse


def running(df, block):
    """Running sum per group: any lost row or state shows."""

    def step(pdf, state):
        total, sums = (state["total"] if state else 0), []
        for v in pdf["v"]:
            total += int(v)
            sums.append(total)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "sum": sums}), {"total": total, "closed": False}

    return sorted(map(tuple, folds.blocked_fold(df, ["g"], "seq", step, "seq long, sum long", "total long, closed boolean", block).collect()))


def test_folds_ignore_block_size_gaps_and_late_groups(spark):
    draw = random.Random(4)
    rows = [(g, s, draw.randrange(9)) for g, positions in (
        ("even", range(0, 40)), ("late", range(37, 41)), ("gaps", [0, 1, 9, 10, 33]), ("one", [20])) for s in positions]
    df = spark.createDataFrame(rows, "g string, seq long, v int")
    want = []
    for g in {r[0] for r in rows}:
        total = 0
        for _, s, v in sorted(r for r in rows if r[0] == g):
            total += v
            want.append((g, s, total))
    for block in (2, 16, 50_000):
        assert running(df, block) == sorted(want)


def first_fit(points, radius):
    leaders, labels = [], []
    for p in points:
        near = [i for i, q in enumerate(leaders) if sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 <= radius]
        if not near:
            leaders.append(p)
        labels.append(near[0] + 1 if near else len(leaders))
    return labels


@pytest.mark.parametrize("block", [2, 16, 50_000])
def test_clusters_ignore_block_size_and_islands(spark, block):
    draw = random.Random(8)
    points = [(round(draw.uniform(0, 6), 2), round(draw.uniform(0, 6), 2)) for _ in range(60)]
    want = first_fit(points, DamageConfig().merge_distance)
    df = spark.createDataFrame([("c", "s", "crack", i, *p) for i, p in enumerate(points)],
                               "capture_id string, surface_id string, damage_type string, ordinal long, center_u double, center_v double")
    got = {r.ordinal: r.group_no for r in damage.cluster(df, ["capture_id"], block_rows=block).collect()}
    assert [got[i] for i in range(60)] == want


def test_opening_links_without_a_partner_keep_their_row(spark):
    doors = spark.createDataFrame([("p", f"o{i}", "lonely" if i < 2 else f"r{i}", i, 0.0, 0.0) for i in range(6)],
                                  "property_id string, opening_id string, room_id string, ordinal long, mx double, my double")
    links = spark.createDataFrame([("p", f"c{i}", i, f"r{i}", "hall", None) for i in range(2, 6)],
                                  "property_id string, connection_id string, connection_order long, room_a string, room_b string, opening_id string")
    edges = spark.createDataFrame([("p", "hall", 0.0, -1.0, 0.0, 1.0)], "property_id string, room_id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.opening_id: r.connection_id for r in openings.link_openings(doors, links, edges, cfg=OpeningConfig()).collect()}
    assert got == {"o0": None, "o1": None} | {f"o{i}": f"c{i}" for i in range(2, 6)}


@pytest.mark.parametrize("seed", range(3))
def test_exclusive_choices_equal_taking_turns(spark, seed):
    draw = random.Random(seed)
    rows = [(g, i, c, draw.choice([0.1, 0.2, 0.3])) for g in range(4) for i in range(12) for c in draw.sample(range(10), draw.randrange(5))]
    rows += [(9, i, c, 0.1 * c) for i in range(6) for c in range(6)]  # everyone wants the same
    want = set()
    for g in {r[0] for r in rows}:
        gone = set()
        for i in range(12):
            left = sorted((d, c) for h, j, c, d in rows if h == g and j == i and c not in gone)
            if left:
                gone.add(left[0][1])
                want.add((g, i, left[0][1]))
    options = spark.createDataFrame(rows, "g int, who int, what int, d double")
    got = openings.exclusive_choices(options, ["g"], "who", "what", ["who"], ["d", "what"]).collect()
    assert {(r.g, r.who, r.what) for r in got} == want and len(got) == len(want)


def test_one_document_however_many_walls(spark):
    walls = spark.range(150).select(F.lit("p").alias("property_id"), F.lit("r").alias("room_id"), F.format_string("w%03d", "id").alias("wall_id"),
                                    *[F.lit(1.0).alias(c) for c in ("x0", "y0", "x1", "y1", "length")])
    rooms = spark.createDataFrame([("p", "r", True)], "property_id string, room_id string, has_ceiling boolean")
    out = documents.room_document(walls, rooms).collect()
    assert len(out) == 1 and [w.wall_id for w in out[0].walls] == [f"r:w{i:03d}" for i in range(150)]
    ids = walls.select("room_id", F.col("wall_id").alias("id"))
    assert [len(r.ids) for r in openings.ids_by_owner(ids, ["room_id"], "id", "ids").collect()] == [150]


def test_evidence_is_screened_before_any_budget(spark):
    rooms = spark.createDataFrame([("p", f"r{i:02d}", 1.0) for i in range(30)], "property_id string, room_id string, area double")
    rows = [("p", f"c{i:03d}", f"r{i % 29:02d}", f"r{i % 29 + 1:02d}", 0.4 + i / 1000, i, [1.0], True, None) for i in range(200)]
    evidence = spark.createDataFrame(rows, "property_id string, connection_id string, room_a string, room_b string, score double, ordinal long, "
                                           "relative_transform array<double>, accepted boolean, rejection_reason string")
    everything = graph.screen_evidence(evidence, rooms)
    assert everything.filter("accepted").count() == 200
    tree = graph.spanning_edges(everything.filter("accepted")).collect()
    assert sorted(r.ordinal for r in tree) == list(range(171, 200))  # a path: the best edge of every neighbour pair
    few = graph.screen_evidence(evidence, rooms, StitchConfig(max_pairs=5)).collect()
    assert len(few) == 200 and sorted(r.ordinal for r in few if r.accepted) == list(range(195, 200))
    assert {r.rejection_reason for r in few if not r.accepted} == {"pair_budget"}
    assert graph.room_pairs(rooms).count() == 30 * 29 // 2


def test_shared_folder_is_demanded_off_a_local_master(spark):
    assert shared_folder("spark://host:7077", "hdfs:///x") == "hdfs:///x"
    with pytest.raises(ValueError):
        shared_folder("spark://host:7077", None)
    drop_stages(spark)
    cut(spark.range(3))
    stage_path(spark, "unused")
    assert drop_stages(spark) == 1 and drop_stages(spark) == 0


def test_sparse_lines_pair_whatever_is_blank(spark, tmp_path):
    folder = tmp_path / "cap"
    folder.mkdir()
    head = "{} 1 0 0 0 0 0 0 1 {}"
    (folder / "images.txt").write_text("\n".join([
        "# comment", "", head.format(1, "a.jpg"), "1 2 7 3 4 -1", "", head.format(2, "b.jpg"), "", head.format(3, "c.jpg"), "5 6 9",
        head.format(4, "d.jpg"), "", "", "# more", head.format(5, "e.jpg")]) + "\n")
    (folder / "cameras.txt").write_text("1 PINHOLE 4 3 2 2 1 1\n")
    images = sparse.read_images(spark, str(folder / "images.txt"))
    got = {r.image_id: r.observations for r in images.collect()}
    assert got == {1: "1 2 7 3 4 -1", 2: "", 3: "5 6 9", 4: "", 5: ""}
    cameras = sparse.read_cameras(spark, str(folder / "cameras.txt"))
    assert sparse.model_faults(images, cameras).count() == 0 and sparse.registered_frames(images, cameras).count() == 5
    (folder / "images.txt").write_text("\n".join([head.format(1, "a.jpg"), "1 2 7 3"]) + "\n")
    (folder / "cameras.txt").write_text("1 OPENCV 4 3 2 2 1 1 0 0 0 0\n")
    images, cameras = sparse.read_images(spark, str(folder / "images.txt")), sparse.read_cameras(spark, str(folder / "cameras.txt"))
    assert {r.code for r in sparse.model_faults(images, cameras).collect()} == {"SPARSE_OBSERVATIONS_MALFORMED", "SPARSE_CAMERA_UNSUPPORTED"}
    assert sparse.registered_frames(images, cameras).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_image_lines_pair_across_pieces_of_a_file(spark, size):
    draw = random.Random(6)
    text, want = [], {}
    for i in range(60):
        text += draw.choice([[], ["# note"], [""], ["", " "]]) if i and want[i - 1] != "" or not i else draw.choice([[], ["# note"], [""]])
        want[i] = draw.choice(["", f"1 2 {i}"])
        text += [f"{i} 1 0 0 0 0 0 0 1 a.jpg", want[i]]
    lines = spark.createDataFrame([("c", n // size, n, line) for n, line in enumerate(text)], "capture_id string, split long, row long, line string")
    assert {r.image_id: r.observations for r in sparse.images(lines).collect()} == want
