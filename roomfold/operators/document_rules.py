"""The cross-entity rules over nested documents, many documents at a time and without a shuffle of their parts.

``integrity`` states the rules over flat tables of any origin. A document is one row, so all that its rules compare lies in one task:
here its lists are opened as Arrow arrays and ids are compared as numbers, in time linear in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

KEY = "capture_id"
#: Kinds of owners of references.
ROOM, WALL, LEVEL = 0, 1, 2


def slim(documents: DataFrame) -> DataFrame:
    """What the rules look at: ids and references as they lie in the documents, distinct corners of polygons, order of boxes and times."""
    corners = lambda polygon: F.when(polygon["points"].isNotNull(), F.size(F.array_distinct(polygon["points"])))
    some = lambda value, *names: [value[n].alias(n) for n in names]
    level = lambda s: F.when(s.isNotNull(), F.struct(*some(s, "surface_id", "damage_ids"), corners(s["polygon"]).alias("corners")))
    wall = lambda w: F.struct(*some(w, "wall_id", "room_id", "opening_ids", "damage_ids"))
    room = lambda r: F.struct(*some(r, "room_id", "opening_ids", "damage_ids"), corners(r["polygon"]).alias("corners"), F.transform(r["walls"], wall).alias("walls"),
                              level(r["floor"]).alias("floor"), level(r["ceiling"]).alias("ceiling"))

    def crossed(box: Column) -> Column:
        low, high = box["min_point"], box["max_point"]
        return F.coalesce((low["x"] > high["x"]) | (low["y"] > high["y"]), F.lit(False)).alias("crossed")

    prop, info = F.col("property"), F.col("processing_info")
    listed = lambda column, *names: F.transform(column, lambda e: F.struct(*some(e, *names)))
    return documents.select(
        F.col("capture.capture_id").alias(KEY), prop["property_id"].alias("property_id"), F.transform(prop["rooms"], room).alias("rooms"),
        listed(prop["openings"], "opening_id", "wall_id", "room_ids").alias("openings"),
        listed(prop["room_connections"], "connection_id", "room_a_id", "room_b_id", "opening_id").alias("connections"),
        F.transform("damages", lambda d: F.struct(*some(d, "damage_id", "room_id", "surface_id"), corners(d["polygon_2d"]).alias("corners"), crossed(d["bounding_box"]))).alias("damages"),
        listed(F.col("concealed_damage_flags"), "flag_id", "room_id", "surface_id").alias("flags"),
        listed(F.col("scope_line_items"), "line_item_id", "room_id", "surface_id", "damage_id").alias("scope"),
        listed(F.col("warnings"), "code", "room_id", "surface_id").alias("warnings"),
        F.concat(F.coalesce(F.transform(prop["footprint_components"], corners), F.array().cast("array<int>")), F.array(corners(prop["footprint_polygon"]))).alias("outlines"),
        F.coalesce(info["completed_at"] < info["started_at"], F.lit(False)).alias("backwards"))


def _opened(lists: pa.Array, doc: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Entries of lists, the document of each, and the list that it comes from."""
    parent = pc.list_parent_indices(lists).to_numpy()
    return pc.list_flatten(lists), doc[parent], parent


def entities(batch: pa.RecordBatch) -> tuple[dict[str, pd.DataFrame], pa.Array]:
    """Entity tables of a batch of documents; ids are numbers of the strings that come along, -1 for null."""
    field = pc.struct_field
    own = np.arange(batch.num_rows)
    rooms, room_doc, _ = _opened(batch["rooms"], own)
    walls, wall_doc, of = _opened(field(rooms, "walls"), room_doc)
    host = field(rooms, "room_id")
    listed = host.take(pa.array(of))
    openings, opening_doc, _ = _opened(batch["openings"], own)
    seen, seen_doc, of_opening = _opened(field(openings, "room_ids"), opening_doc)
    levels = [field(rooms, name) for name in ("floor", "ceiling")]
    part = lambda name, *columns: (lambda v, doc, _: {"doc": doc} | {c: field(v, c) for c in columns})(*_opened(batch[name], own))

    def refs(owner_ids: pa.Array, owner_rooms: pa.Array, doc: np.ndarray, lists: pa.Array, kind: int) -> dict:
        value, at, parent = _opened(lists, doc)
        rows = pa.array(parent)
        return {"doc": at, "owner_id": owner_ids.take(rows), "owner_room_id": owner_rooms.take(rows), "ref_id": value, "owner_kind": np.full(len(at), kind)}

    wall_id = field(walls, "wall_id")
    pieces = {
        "rooms": [{"doc": room_doc, "room_id": host, "corners": field(rooms, "corners")}],
        "walls": [{"doc": wall_doc, "wall_id": wall_id, "room_id": field(walls, "room_id"), "listed_room_id": listed}],
        "surfaces": [{"doc": wall_doc, "surface_id": wall_id, "room_id": listed}, *[
            {"doc": room_doc[keep], "surface_id": field(v, "surface_id").filter(pa.array(keep)), "room_id": host.filter(pa.array(keep))}
            for v in levels for keep in [field(v, "surface_id").is_valid().to_numpy(zero_copy_only=False)]]],
        "levels": [{"doc": room_doc, "surface_id": field(v, "surface_id"), "corners": field(v, "corners")} for v in levels],
        "openings": [{"doc": opening_doc, "opening_id": field(openings, "opening_id"), "wall_id": field(openings, "wall_id")}],
        "opening_rooms": [{"doc": seen_doc, "opening_id": field(openings, "opening_id").take(pa.array(of_opening)), "room_id": seen}],
        "connections": [part("connections", "connection_id", "room_a_id", "room_b_id", "opening_id")],
        "damages": [part("damages", "damage_id", "room_id", "surface_id", "corners", "crossed")],
        "flags": [part("flags", "flag_id", "room_id", "surface_id")],
        "scope": [part("scope", "line_item_id", "room_id", "surface_id", "damage_id")],
        "warnings": [part("warnings", "code", "room_id", "surface_id")],
        "opening_refs": [refs(host, host, room_doc, field(rooms, "opening_ids"), ROOM), refs(wall_id, listed, wall_doc, field(walls, "opening_ids"), WALL)],
        "damage_refs": [refs(host, host, room_doc, field(rooms, "damage_ids"), ROOM), refs(wall_id, listed, wall_doc, field(walls, "damage_ids"), WALL),
                        *[refs(field(v, "surface_id"), host, room_doc, field(v, "damage_ids"), LEVEL) for v in levels]],
        "outlines": [{"doc": doc, "entity": batch["property_id"].take(pa.array(doc)), "corners": value} for value, doc, _ in [_opened(batch["outlines"], own)]],
        "times": [{"doc": own, "entity": batch[KEY], "backwards": batch["backwards"]}],
    }
    texts = [v for rows in pieces.values() for row in rows for v in row.values() if isinstance(v, pa.Array) and pa.types.is_string(v.type)]
    coded = pa.concat_arrays(texts).dictionary_encode()
    numbers = iter(np.split(coded.indices.fill_null(-1).to_numpy().astype(np.int64), np.cumsum([len(v) for v in texts])[:-1]))

    def plain(v) -> np.ndarray:
        if not isinstance(v, pa.Array):
            return v
        if pa.types.is_string(v.type):
            return next(numbers)
        return v.fill_null(3).to_numpy() if pa.types.is_integer(v.type) else v.to_numpy(zero_copy_only=False)

    tables = {name: pd.concat([pd.DataFrame({c: plain(v) for c, v in row.items()}) for row in rows], ignore_index=True) for name, rows in pieces.items()}
    return tables, coded.dictionary


class _Found:
    """Violations of a batch by rule, and the joins that the rules are made of: inside a document, null matches nothing."""

    def __init__(self, strings: pa.Array):
        self.strings, self.rows = strings, []

    def key(self, df: pd.DataFrame, *columns: str) -> np.ndarray:
        out = df["doc"].to_numpy()
        for c in columns:
            out = out * (len(self.strings) + 1) + df[c].to_numpy() + 1
        return out

    def add(self, rule: str, df: pd.DataFrame, *entity: str) -> None:
        if len(df):
            ids = [self.strings.take(pa.array(df[c].to_numpy(), mask=df[c].to_numpy() < 0)) for c in entity]
            text = ids[0] if len(ids) == 1 else pc.binary_join_element_wise(*ids, "/", null_handling="skip")
            self.rows.append((df["doc"].to_numpy(), np.full(len(df), rule, object), text))

    def repeated(self, rule: str, df: pd.DataFrame, by: list[str], *entity: str) -> None:
        self.add(rule, df[df.duplicated(["doc", *by])], *entity)

    def known(self, df: pd.DataFrame, columns: list[str], target: pd.DataFrame, target_columns: list[str]) -> np.ndarray:
        """Which rows have their values in the target; two columns are told apart by their place in a sorted list of pairs."""
        if len(columns) == 1:
            return np.isin(self.key(df, *columns), self.key(target, *target_columns))
        pairs = pd.MultiIndex.from_arrays([target["doc"], *[target[c] for c in target_columns]])
        return pd.MultiIndex.from_arrays([df["doc"], *[df[c] for c in columns]]).isin(pairs) if len(target) else np.zeros(len(df), bool)

    def missing(self, rule: str, df: pd.DataFrame, column: str, target: pd.DataFrame, target_column: str, entity: str) -> None:
        rows = df[df[column] >= 0]
        if len(rows):
            self.add(rule, rows[~self.known(rows, [column], target, [target_column])], entity)


def _meet(left: pd.DataFrame, right: pd.DataFrame, on: str, how: str = "inner") -> pd.DataFrame:
    """Rows that meet inside a document on a value that is known; unmatched rows of a left join get -1."""
    out = left.merge(right[right[on] >= 0], on=["doc", on], how=how)
    return out if how == "inner" else out.fillna(-1).astype({c: np.int64 for c in right.columns})


def _differ(df: pd.DataFrame, a: str, b: str) -> pd.DataFrame:
    return df[(df[a] >= 0) & (df[b] >= 0) & (df[a] != df[b])]


def check(t: dict[str, pd.DataFrame], strings: pa.Array) -> list[tuple]:
    """Document, rule and entity of all violations, by the rules of ``integrity``."""
    found = _Found(strings)
    located = (("damages", "damage_id"), ("flags", "flag_id"), ("scope", "line_item_id"), ("warnings", "code"))
    for name, column, rule in (("rooms", "room_id", "room"), ("openings", "opening_id", "opening"), ("connections", "connection_id", "connection"),
                               ("surfaces", "surface_id", "surface"), ("damages", "damage_id", "damage"), ("flags", "flag_id", "flag"),
                               ("scope", "line_item_id", "scope_item")):
        found.repeated(f"duplicate_{rule}", t[name], [column], column)
    for name in ("opening_refs", "damage_refs"):
        found.repeated("duplicate_reference", t[name], ["owner_id", "ref_id"], "owner_id", "ref_id")

    found.missing("opening_room_missing", t["opening_rooms"], "room_id", t["rooms"], "room_id", "opening_id")
    found.missing("opening_wall_missing", t["openings"], "wall_id", t["walls"], "wall_id", "opening_id")
    for side in ("room_a_id", "room_b_id"):
        found.missing("connection_room_missing", t["connections"], side, t["rooms"], "room_id", "connection_id")
    found.missing("connection_opening_missing", t["connections"], "opening_id", t["openings"], "opening_id", "connection_id")
    for name, entity in located:
        found.missing(f"{name}_room_missing", t[name], "room_id", t["rooms"], "room_id", entity)
        found.missing(f"{name}_surface_missing", t[name], "surface_id", t["surfaces"], "surface_id", entity)
    found.missing("scope_damage_missing", t["scope"], "damage_id", t["damages"], "damage_id", "line_item_id")
    found.missing("opening_reference_missing", t["opening_refs"], "ref_id", t["openings"], "opening_id", "owner_id")
    found.missing("damage_reference_missing", t["damage_refs"], "ref_id", t["damages"], "damage_id", "owner_id")

    found.add("wall_owner", _differ(t["walls"], "room_id", "listed_room_id"), "wall_id")
    owners = t["surfaces"][["doc", "surface_id", "room_id"]].rename(columns={"room_id": "surface_room"})
    walls = t["walls"][["doc", "wall_id", "room_id"]].rename(columns={"room_id": "owner_room"})
    seen = t["opening_rooms"]

    def outside(df: pd.DataFrame, room: str) -> pd.DataFrame:
        """Rows whose opening lists rooms, but not theirs."""
        df = df[df[room] >= 0]
        df = df[found.known(df, ["opening_id"], seen, ["opening_id"]) & (df["opening_id"] >= 0)]
        return df[~found.known(df, ["opening_id", room], seen, ["opening_id", "room_id"])] if len(df) else df

    if len(seen):
        found.add("opening_host_room", outside(_meet(t["openings"], walls, "wall_id"), "owner_room"), "opening_id")
        refs = t["opening_refs"].rename(columns={"ref_id": "opening_id"})
        found.add("opening_reference_room", outside(refs, "owner_room_id"), "owner_id", "opening_id")
        linked = _meet(t["connections"], seen, "opening_id")
        found.add("connection_opening_rooms", linked[(linked["room_id"] >= 0) & (linked["room_id"] != linked["room_a_id"]) & (linked["room_id"] != linked["room_b_id"])], "connection_id")
    by_wall = t["opening_refs"][t["opening_refs"]["owner_kind"] == WALL].rename(columns={"ref_id": "opening_id"})
    if len(by_wall):
        primary = _meet(_meet(by_wall, t["openings"], "opening_id"), walls, "wall_id")
        same = (primary["owner_room"] == primary["owner_room_id"]) & (primary["owner_room"] >= 0)
        found.add("opening_primary_wall", _differ(primary[same], "wall_id", "owner_id"), "owner_id", "opening_id")
    for name, entity in located:
        if len(t[name]):
            found.add(f"{name}_surface_room", _differ(_meet(t[name], owners, "surface_id"), "room_id", "surface_room"), entity)
    if len(t["damages"]) and (len(t["scope"]) or len(t["damage_refs"])):
        placed = _meet(t["damages"], owners, "surface_id", "left")
        placed["damage_room"] = placed["room_id"].where(placed["room_id"] >= 0, placed["surface_room"])
        placed = placed[["doc", "damage_id", "damage_room", "surface_id"]].rename(columns={"surface_id": "damage_surface"})
        items = _meet(_meet(t["scope"], owners, "surface_id", "left"), placed, "damage_id")
        items["owner"] = items["room_id"].where(items["room_id"] >= 0, items["surface_room"])
        found.add("scope_damage_room", _differ(items, "owner", "damage_room"), "line_item_id")
        found.add("scope_damage_surface", _differ(items, "surface_id", "damage_surface"), "line_item_id")
        held = _meet(t["damage_refs"].rename(columns={"ref_id": "damage_id"}), placed, "damage_id")
        found.add("damage_reference_room", _differ(held, "owner_room_id", "damage_room"), "owner_id", "damage_id")
        found.add("damage_reference_surface", _differ(held[held["owner_kind"] != ROOM], "owner_id", "damage_surface"), "owner_id", "damage_id")

    loops = t["connections"]
    found.add("connection_self_loop", loops[(loops["room_a_id"] >= 0) & (loops["room_a_id"] == loops["room_b_id"])], "connection_id")
    if len(seen):
        found.add("opening_room_limit", seen[seen.groupby(["doc", "opening_id"])["room_id"].transform("size") > 2], "opening_id")
        found.add("opening_rooms_repeat", seen[seen.duplicated(["doc", "opening_id", "room_id"]) | (seen["room_id"] < 0)], "opening_id")
    for name, entity in (("rooms", "room_id"), ("levels", "surface_id"), ("damages", "damage_id"), ("outlines", "entity")):
        found.add("polygon_vertices", t[name][t[name]["corners"] < 3], entity)
    found.add("box_order", t["damages"][t["damages"]["crossed"].astype(bool)], "damage_id")
    found.add("chronology", t["times"][t["times"]["backwards"].astype(bool)], "entity")
    return found.rows


def violations(documents: DataFrame) -> DataFrame:
    """(capture_id, rule_id, entity_id) of every cross-entity violation, each once."""
    parts = slim(documents)
    schema = to_arrow_schema(parts.schema)

    def parsed(lines: pa.Array) -> pa.RecordBatch:
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")[0].as_buffer()
        block = max(1 << 22, 2 * pc.max(pc.binary_length(lines)).as_py())  # a line lies in one block or two
        table = json.read_json(text, json.ReadOptions(use_threads=False, block_size=block), json.ParseOptions(explicit_schema=schema))
        return table.select(schema.names).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            batch = parsed(raw["text"]) if raw.num_rows else raw
            rows = check(*entities(batch)) if raw.num_rows else []
            if rows:
                doc, rule, entity = (np.concatenate(v) if i < 2 else pa.chunked_array(v, pa.string()).combine_chunks() for i, v in enumerate(zip(*rows)))
                yield pa.record_batch({KEY: batch[KEY].take(pa.array(doc)), "rule_id": pa.array(rule, pa.string()), "entity_id": entity})

    # As text: Spark takes time for every nested column and row of a batch that it hands over, over ten times that of the parser.
    return parts.select(F.to_json(F.struct(*parts.columns)).alias("text")).mapInArrow(run, f"{KEY} string, rule_id string, entity_id string").distinct()
