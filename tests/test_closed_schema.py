"""Closed schema at all depths against a plain walk."""

import json
import random

from pyspark.sql import types as T

from roomfold.operators import integrity
from roomfold.schemas import result_schema

SHAPE = ("a int, b struct<c:string,d:array<struct<e:double,f:map<string,string>>>>, g array<array<string>>, schema_version string")


def plain(value, schema, path=""):
    """(rule, path) of one document."""
    kind = {dict: "object", list: "array", type(None): "null"}.get(type(value), "scalar")
    wanted = {T.StructType: "object", T.ArrayType: "array", T.MapType: "object"}.get(type(schema), "scalar")
    if kind != wanted and (kind != "null" or not path):
        return {("wrong_kind", path or "$")}
    out = set()
    if kind == "object" and isinstance(schema, T.StructType):
        for k, v in value.items():
            inner = f"{path}.{k}" if path else k
            out |= plain(v, schema[k].dataType, inner) if k in schema.names else {("unknown_key", inner)}
    if kind == "array":
        for i, v in enumerate(value):
            out |= plain(v, schema.elementType, f"{path}[{i}]")
    return out


def noise(draw, depth=0):
    pick = draw.randrange(6 if depth < 5 else 3)
    if pick == 4:
        return [noise(draw, depth + 1) for _ in range(draw.randrange(4))]
    if pick >= 3:
        return {k: noise(draw, depth + 1) for k in draw.sample("abcdefgxyz", draw.randrange(5))}
    return draw.choice([None, 1, 2.5, "text", True, "{\"a\": 1}", "[1]"])


def test_nested_keys_equal_a_plain_walk(spark):
    shape, draw = T.StructType.fromDDL(SHAPE), random.Random(3)
    docs = {i: {k: noise(draw) for k in draw.sample(["a", "b", "g", "x"], 3)} for i in range(150)}
    docs |= {200: [], 201: 5, 202: {}, 203: {"b": {"d": [{"f": {"any": {"deep": 1}}}, {"e": None, "z": 1}]}}, 204: {"schema_version": "2", "a": None}, 205: None}
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [(300, "{broken"), (301, None), (302, "")]
    out = integrity.nested_unknown_keys(spark.createDataFrame(rows, "capture_id int, body string"), "body", shape).collect()
    want = {(i, *fault) for i, d in docs.items() for fault in plain(d, shape)} | {(204, "schema_version", "2")}
    want |= {(i, "malformed_document", "$") for i in (300, 301, 302)}
    assert {(r.capture_id, r.rule_id, r.entity_id) for r in out} == want and len(out) == len(want)


def test_paths_of_the_result_schema(spark):
    paths = dict(integrity.schema_paths(result_schema()))
    assert paths["property.rooms[].walls[].length.value"] == "scalar" and paths["metadata"] == "map" and paths["damages"] == "array" and paths[""] == "object"
    assert "property.rooms[].walls[].colour" not in paths
