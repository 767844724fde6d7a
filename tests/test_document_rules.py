"""Rules inside documents against the rules over flat tables, and the query over planted line items."""

import json
import random

from roomfold.operators import integrity
from roomfold.plans import sources as source_plans
from roomfold.plans.catalog import ORACLES
from roomfold.sources import tables
from tests.compare import difference, spark_rows, sql_rows
from tests.test_stages import upper_floor

IDS = ["slope", "landing", "loft", "slope:1", "landing:1", "landing:top", "loft:2", "loft:floor", "d-west", "d-east", "crack-7", "crack-8", "cellar", None]
SMALL = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]


def broken(draw):
    """The upper floor with more parts, some ids and lists of which are mixed up."""
    doc = json.loads(json.dumps(upper_floor()))
    prop = doc["property"]
    doc["damages"] += [{"damage_id": "crack-8", "surface_id": draw.choice(IDS), "room_id": draw.choice(IDS[:3] + [None]), "polygon_2d": draw.choice([None, {"points": SMALL}]),
                        "bounding_box": draw.choice([None, {"min_point": {"x": 1.0, "y": 0.0}, "max_point": {"x": draw.choice([0.0, 2.0]), "y": 1.0}}])}]
    doc["concealed_damage_flags"] = [{"flag_id": draw.choice(["f", "g"]), "room_id": draw.choice(IDS), "surface_id": draw.choice(IDS)} for _ in range(3)]
    doc["scope_line_items"] += [{"line_item_id": draw.choice(["fill", "paint"]), "room_id": draw.choice(IDS), "surface_id": draw.choice(IDS), "damage_id": draw.choice(IDS)}]
    doc["warnings"] = [{"code": "W", "room_id": draw.choice(IDS), "surface_id": draw.choice(IDS)}]
    prop["footprint_components"] = [{"points": SMALL}] if draw.random() < 0.3 else None
    doc["processing_info"] = {"started_at": "2024-01-02T00:00:00Z", "completed_at": draw.choice(["2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z", None])}
    for _ in range(draw.randint(0, 6)):
        owner = draw.choice([*prop["rooms"], *[w for r in prop["rooms"] for w in r["walls"]], *prop["openings"], *prop["room_connections"], *doc["damages"], *[r["floor"] for r in prop["rooms"]]])
        key = draw.choice([k for k in owner if k.endswith(("_id", "_ids"))])
        owner[key] = (owner[key] or []) + [draw.choice(IDS)] if key.endswith("_ids") else draw.choice(IDS)
    if draw.random() < 0.2:  # listed by a second wall of its room
        prop["rooms"][1]["walls"][2].update(opening_ids=["d-east"])
    if draw.random() < 0.2:
        draw.choice(prop["rooms"])["floor"].update(polygon={"points": SMALL})
    if draw.random() < 0.2:
        prop["rooms"].append(dict(draw.choice(prop["rooms"]), ceiling=None, walls=None))
    return doc


def test_rules_inside_documents_equal_those_over_tables(spark, tmp_path):
    draw = random.Random(11)
    docs = [broken(draw) for _ in range(150)]
    for i, doc in enumerate(docs):
        doc["capture"]["capture_id"] = f"c{i}"
    docs += [{"schema_version": "1.0.0", "capture": {"capture_id": "empty"}, "property": {"property_id": "p"}}, dict(docs[0], property=None)]
    docs[-1]["capture"] = {"capture_id": "none"}
    (tmp_path / "docs.jsonl").write_text("\n".join(map(json.dumps, docs)))
    read = tables.read_result_lines(spark, str(tmp_path / "docs.jsonl")).cache()
    flat = {name: df.cache() for name, df in integrity.flatten_documents(read).items()}
    want = set()
    for rules in (integrity.uniqueness, integrity.references, integrity.agreement, integrity.shapes):
        want |= {tuple(r) for r in rules(flat).collect()}
    out = [tuple(r) for r in integrity.validate_documents(read).collect()]
    assert set(out) == want and len(out) == len(want)
    assert {r[1] for r in want} >= {"duplicate_reference", "opening_host_room", "opening_primary_wall", "damage_reference_surface", "scope_damage_room", "polygon_vertices", "box_order", "chronology"}


def test_repeated_line_items_break_every_rule_they_touch(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        again = "" if name == "orders" else "UNION ALL SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE l_orderkey % 7 = 0 " \
            "UNION ALL SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE l_orderkey % 21 = 0"
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{name}.parquet' {again}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = source_plans.document_violations(spark, str(tmp_path))
    got = spark_rows(found)
    assert difference(got, sql_rows(con, ORACLES["document_violations"])) is None
    assert {row[got[0].index("rule_id")] for row in got[1]} == {"duplicate_surface", "duplicate_opening", "duplicate_damage", "duplicate_reference", "opening_rooms_repeat", "opening_room_limit"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # documents are read once
