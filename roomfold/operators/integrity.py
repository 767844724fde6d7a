"""Validation as queries: every rule returns its violating rows.

All functions take flat entity tables that carry ``capture_id`` and return rows
(capture_id, rule_id, entity_id); a document is valid when no row names it. Keys
always include the entity id, so one huge capture spreads over its entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from roomfold.functions.rigid import is_finite
from roomfold.operators.document_rules import violations
from roomfold.schemas import IDENTIFIER, SCHEMA_VERSION_RULE, UNIT_BY_KIND

KEY = "capture_id"


def _rows(df: DataFrame, rule: str, entity: Column | str) -> DataFrame:
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.select(KEY, F.lit(rule).alias("rule_id"), entity.cast("string").alias("entity_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def flag_rows(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
    """Evaluate many row predicates in one pass over the table."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name))
                                     for name, test in rules.items()]))
    return df.select(KEY, F.explode(hits).alias("rule_id"), F.col(entity).cast("string").alias("entity_id"))


def valid_identifier(value: Column) -> Column:
    return value.isNotNull() & value.rlike(IDENTIFIER)


def measurement_domains(measures: DataFrame) -> DataFrame:
    """Scalar limits of every measurement: finite, non-negative, ordered bounds, right unit."""
    kind, value, lo, hi = (F.col(c) for c in ("measurement_type", "value", "lower_bound", "upper_bound"))
    level = F.col("confidence_level")
    bad = lambda c: c.isNotNull() & (~is_finite(c) | (c < 0))
    unit = F.create_map(*[F.lit(x) for pair in UNIT_BY_KIND.items() for x in pair])
    rules = {
        "value_domain": value.isNull() | bad(value),
        "bound_domain": bad(lo) | bad(hi),
        "bounds_order": (lo > value) | (value > hi),
        "level_domain": level.isNotNull() & (F.isnan(level) | (level < 0) | (level > 1)),
        "unit_mismatch": F.try_element_at(unit, kind) != F.col("unit"),
        "scope_unit": (kind == "scope_quantity") & ~F.col("unit").isin("m", "m2", "item"),
        "angle_limit": (F.col("unit") == "degree") & (F.greatest(value, lo, hi) > 360.0),
        "identifier": ~valid_identifier(F.col("measurement_id")),
    }
    if "confidence_score" in measures.columns:
        score = F.col("confidence_score")
        rules["score_domain"] = score.isNotNull() & (F.isnan(score) | (score < 0) | (score > 1))
    return flag_rows(measures, "measurement_id", rules)


def duplicate_ids(df: DataFrame, entity: str, rule: str) -> DataFrame:
    repeated = df.groupBy(KEY, entity).count().filter("count > 1")
    return _rows(repeated, rule, entity)


def uniqueness(t: dict[str, DataFrame]) -> DataFrame:
    """Repeated ids per kind; walls, floors and ceilings share one surface namespace."""
    named = [("rooms", "room_id", "duplicate_room"), ("openings", "opening_id", "duplicate_opening"),
             ("connections", "connection_id", "duplicate_connection"), ("surfaces", "surface_id", "duplicate_surface"),
             ("damages", "damage_id", "duplicate_damage"), ("flags", "flag_id", "duplicate_flag"),
             ("scope", "line_item_id", "duplicate_scope_item")]
    parts = [duplicate_ids(t[name], column, rule) for name, column, rule in named if name in t]
    if "refs" in t:
        again = t["refs"].groupBy(KEY, "owner_id", "kind", "ref_id").count().filter("count > 1")
        parts.append(_rows(again, "duplicate_reference", F.concat_ws("/", "owner_id", "ref_id")))
    return _all(parts)


def missing(df: DataFrame, column: str, target: DataFrame, target_column: str, rule: str, entity: str) -> DataFrame:
    known = target.select(KEY, F.col(target_column).alias(column)).distinct()
    return _rows(df.filter(F.col(column).isNotNull()).join(known, [KEY, column], "left_anti"), rule, entity)


def references(t: dict[str, DataFrame]) -> DataFrame:
    """References that name nothing."""
    parts = []
    add = lambda name, column, target, key, rule, entity: parts.append(
        missing(t[name], column, t[target], key, rule, entity)) if name in t else None
    add("opening_rooms", "room_id", "rooms", "room_id", "opening_room_missing", "opening_id")
    add("openings", "wall_id", "walls", "wall_id", "opening_wall_missing", "opening_id")
    add("connections", "room_a_id", "rooms", "room_id", "connection_room_missing", "connection_id")
    add("connections", "room_b_id", "rooms", "room_id", "connection_room_missing", "connection_id")
    add("connections", "opening_id", "openings", "opening_id", "connection_opening_missing", "connection_id")
    for name, entity in (("damages", "damage_id"), ("flags", "flag_id"), ("scope", "line_item_id"), ("warnings", "code")):
        add(name, "room_id", "rooms", "room_id", f"{name}_room_missing", entity)
        add(name, "surface_id", "surfaces", "surface_id", f"{name}_surface_missing", entity)
    add("scope", "damage_id", "damages", "damage_id", "scope_damage_missing", "line_item_id")
    if "refs" in t:
        for kind, target, key in (("opening", "openings", "opening_id"), ("damage", "damages", "damage_id")):
            some = t["refs"].filter(F.col("kind") == kind)
            parts.append(missing(some, "ref_id", t[target], key, f"{kind}_reference_missing", "owner_id"))
    return _all(parts)


def agreement(t: dict[str, DataFrame]) -> DataFrame:
    """References that exist but contradict each other; unknown sides never conflict."""
    parts = []
    walls = t["walls"].select(KEY, "wall_id", F.col("room_id").alias("owner_room"))
    parts.append(_rows(t["walls"].filter(F.col("room_id") != F.col("listed_room_id")), "wall_owner", "wall_id"))
    rooms_of = t["opening_rooms"].groupBy(KEY, "opening_id").agg(F.collect_set("room_id").alias("rooms"))
    hosted = t["openings"].join(walls, [KEY, "wall_id"]).join(rooms_of, [KEY, "opening_id"])
    parts.append(_rows(hosted.filter(~F.array_contains("rooms", F.col("owner_room"))), "opening_host_room", "opening_id"))
    if "refs" in t:
        refs = t["refs"].filter("kind = 'opening'").withColumnRenamed("ref_id", "opening_id")
        seen = refs.join(rooms_of, [KEY, "opening_id"])
        parts.append(_rows(seen.filter(~F.array_contains("rooms", F.col("owner_room_id"))),
                           "opening_reference_room", F.concat_ws("/", "owner_id", "opening_id")))
        primary = (refs.filter("owner_kind = 'wall'")
                   .join(t["openings"].select(KEY, "opening_id", "wall_id"), [KEY, "opening_id"])
                   .join(walls, [KEY, "wall_id"]))
        parts.append(_rows(primary.filter((F.col("owner_room") == F.col("owner_room_id"))
                                          & (F.col("wall_id") != F.col("owner_id"))),
                           "opening_primary_wall", F.concat_ws("/", "owner_id", "opening_id")))
    linked = t["connections"].filter("opening_id is not null").join(rooms_of, [KEY, "opening_id"])
    outside = F.size(F.array_except("rooms", F.array("room_a_id", "room_b_id"))) > 0
    parts.append(_rows(linked.filter(outside), "connection_opening_rooms", "connection_id"))
    owners = t["surfaces"].select(KEY, "surface_id", F.col("room_id").alias("surface_room"))
    for name, entity in (("damages", "damage_id"), ("flags", "flag_id"), ("scope", "line_item_id"), ("warnings", "code")):
        if name in t:
            both = t[name].join(owners, [KEY, "surface_id"]).filter(F.col("room_id") != F.col("surface_room"))
            parts.append(_rows(both, f"{name}_surface_room", entity))
    placed = (t["damages"].join(owners, [KEY, "surface_id"], "left")
              .select(KEY, "damage_id", F.coalesce("room_id", "surface_room").alias("damage_room"),
                      F.col("surface_id").alias("damage_surface")))
    if "scope" in t:
        items = (t["scope"].join(owners, [KEY, "surface_id"], "left").join(placed, [KEY, "damage_id"])
                 .withColumn("_owner", F.coalesce("room_id", "surface_room")))
        parts.append(_rows(items.filter(F.col("_owner") != F.col("damage_room")), "scope_damage_room", "line_item_id"))
        parts.append(_rows(items.filter(F.col("surface_id") != F.col("damage_surface")), "scope_damage_surface",
                           "line_item_id"))
    if "refs" in t:
        held = t["refs"].filter("kind = 'damage'").withColumnRenamed("ref_id", "damage_id").join(placed, [KEY, "damage_id"])
        label = F.concat_ws("/", "owner_id", "damage_id")
        parts.append(_rows(held.filter(F.col("owner_room_id") != F.col("damage_room")), "damage_reference_room", label))
        parts.append(_rows(held.filter((F.col("owner_kind") != "room") & (F.col("owner_id") != F.col("damage_surface"))),
                           "damage_reference_surface", label))
    return _all(parts)


def shapes(t: dict[str, DataFrame]) -> DataFrame:
    """Self loops, too many opening rooms, degenerate polygons, unordered boxes and times."""
    parts = []
    if "connections" in t:
        parts.append(_rows(t["connections"].filter("room_a_id = room_b_id"), "connection_self_loop", "connection_id"))
    if "opening_rooms" in t:
        sizes = t["opening_rooms"].groupBy(KEY, "opening_id").agg(
            F.count("*").alias("n"), F.count_distinct("room_id").alias("d"))
        parts.append(_rows(sizes.filter("n > 2"), "opening_room_limit", "opening_id"))
        parts.append(_rows(sizes.filter("n > d"), "opening_rooms_repeat", "opening_id"))
    if "polygons" in t:
        parts.append(_rows(t["polygons"].filter(F.size(F.array_distinct("points")) < 3), "polygon_vertices", "surface_id"))
    if "boxes" in t:
        parts.append(_rows(t["boxes"].filter("min_x > max_x OR min_y > max_y"), "box_order", "entity"))
    if "processing" in t:
        parts.append(_rows(t["processing"].filter("completed_at < started_at"), "chronology", KEY))
    return _all(parts)


def manifest_limits(manifests: DataFrame) -> DataFrame:
    """Calibration and manifest rules: unit and scale agree, focal lengths positive, centre inside."""
    scale = F.create_map(F.lit("meter"), F.lit(1.0), F.lit("millimeter"), F.lit(1000.0))
    return flag_rows(manifests, KEY, {
        "manifest_version": F.col("format_version") != SCHEMA_VERSION_RULE,
        "depth_scale": F.coalesce(F.try_element_at(scale, F.col("depth_unit")) != F.col("depth_scale"), F.lit(True)),
        "frame_count": F.col("frame_count") != F.col("distinct_frames"),
        "frame_ids_repeat": F.col("listed_frames") != F.col("distinct_frames"),
        "focal_length": ~((F.col("fx") > 0) & (F.col("fy") > 0)),
        "principal_point": ~((F.col("cx") >= 0) & (F.col("cx") < F.col("width"))
                             & (F.col("cy") >= 0) & (F.col("cy") < F.col("height"))),
    })


def unknown_keys(raw: DataFrame, text: str, known: list[str], key: str = KEY) -> DataFrame:
    """Top-level keys outside the closed schema, and unsupported versions."""
    extra = F.array_except(F.json_object_keys(F.col(text)), F.array(*[F.lit(k) for k in known]))
    version = F.get_json_object(text, "$.schema_version")
    a = raw.select(F.col(key).alias(KEY), F.explode(extra).alias("entity_id"))
    b = raw.filter(version.isNotNull() & (version != SCHEMA_VERSION_RULE))
    return _all([_rows(a, "unknown_key", "entity_id"),
                 b.select(F.col(key).alias(KEY), F.lit("schema_version").alias("rule_id"), version.alias("entity_id"))])


def schema_paths(schema: T.StructType) -> list[tuple[str, str]]:
    """(path, kind) of everything a closed schema declares; list entries are written [], keys of maps are free."""
    out: list[tuple[str, str]] = []

    def walk(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            out.append((path, "object"))
            for f in kind.fields:
                walk(f"{path}.{f.name}" if path else f.name, f.dataType)
        elif isinstance(kind, T.ArrayType):
            out.append((path, "array"))
            walk(f"{path}[]", kind.elementType)
        else:
            out.append((path, "map" if isinstance(kind, T.MapType) else "scalar"))

    walk("", schema)
    return out


def _kind(value: Column) -> Column:
    """object, array, null or scalar; one level is looked at, whatever lies below."""
    held = lambda kind: F.try_variant_get(value, "$", kind).isNotNull()
    return F.when(F.is_variant_null(value), "null").when(held("map<string,variant>"), "object").when(held("array<variant>"), "array").otherwise("scalar")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns as one generated row, so that later conditions read them and do not repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


def nested_unknown_keys(raw: DataFrame, text: str, schema: T.StructType, key: str = KEY) -> DataFrame:
    """Violations of a closed schema at all depths: unknown keys, values of another kind than declared, text that is no JSON, other versions.

    A null value is allowed everywhere but for the document itself; what lies below an unknown key is not looked at. Documents are parsed
    once into variants and opened level by level, as many levels as the schema is deep, in one pass: a row is either a fault or a sound
    object or list that is still to be opened, and rows of neither sort are dropped where they appear.
    """
    spark = raw.sparkSession
    declared = schema_paths(schema)
    known = spark.createDataFrame(declared, "shape string, declared string")  # as large as the schema
    deep = 1 + max((s.count(".") + s.count("[]") + 1 for s, kind in declared if s and kind in ("object", "array")), default=0)
    parsed = _once(raw.select(F.col(key).alias(KEY), text), value=F.try_parse_json(text), version=F.get_json_object(text, "$.schema_version"))
    whole = F.when(F.col("value").isNull(), "malformed_document").when(_kind(F.col("value")) != "object", "wrong_kind")
    parsed = _once(parsed, fault=whole)
    row = lambda path, value, rule: F.struct(path.alias("path"), F.lit("").alias("shape"), value.alias("value"), rule.alias("rule_id"))
    other = F.col("value").isNotNull() & (F.col("version") != SCHEMA_VERSION_RULE)
    nothing = F.lit(None).cast("variant")
    level = parsed.select(KEY, F.inline(F.array_compact(F.array(
        row(F.when(F.col("fault").isNotNull(), "$").otherwise(""), F.when(F.col("fault").isNull(), F.col("value")), F.col("fault")),
        F.when(other, row(F.col("version"), nothing, F.lit("schema_version")))))))
    for _ in range(deep):
        opened = spark.sql(f"SELECT {KEY}, path, shape, rule_id, t.pos AS pos, t.key AS name, t.value AS value "
                           "FROM {level}, LATERAL variant_explode_outer(value) AS t", level=level).filter("pos IS NOT NULL OR rule_id IS NOT NULL")
        dot = lambda base: F.when(F.col(base) == "", F.col("name")).otherwise(F.concat(base, F.lit("."), "name"))
        place = F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        inner = F.col("rule_id").isNull()
        placed = opened.select(
            KEY, F.when(~inner, F.col("path")).when(F.col("name").isNull(), place).otherwise(dot("path")).alias("path"),
            F.when(inner, F.when(F.col("name").isNull(), F.concat("shape", F.lit("[]"))).otherwise(dot("shape"))).alias("shape"), "rule_id", "value")
        joined = _once(placed.join(F.broadcast(known), "shape", "left"), kind=F.when(F.col("rule_id").isNull() & F.col("declared").isNotNull(), _kind(F.col("value"))))
        wanted = F.when(F.col("declared") == "map", "object").otherwise(F.col("declared"))
        rule = F.when(F.col("rule_id").isNotNull(), F.col("rule_id")).when(F.col("declared").isNull(), "unknown_key").when(
            (F.col("kind") != "null") & (F.col("kind") != wanted), "wrong_kind")
        sound = F.col("declared").isin("object", "array") & (F.col("kind") == F.col("declared"))
        level = joined.select(KEY, "path", "shape", F.when(sound, F.col("value")).alias("value"), rule.alias("rule_id")).filter("value IS NOT NULL OR rule_id IS NOT NULL")
    return level.filter("rule_id IS NOT NULL").select(KEY, "rule_id", F.col("path").alias("entity_id"))


def flatten_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """Entity tables of nested result documents."""
    base = documents.withColumn(KEY, F.col("capture.capture_id"))
    rooms = base.select(KEY, F.explode("property.rooms").alias("r"))
    walls = rooms.select(KEY, F.col("r.room_id").alias("listed_room_id"), F.explode("r.walls").alias("w"))
    openings = base.select(KEY, F.explode("property.openings").alias("o"))
    outlines = base.select(KEY, "property.property_id", F.explode("property.footprint_components").alias("c"))
    wall_rows = walls.select(KEY, "w.wall_id", "w.room_id", "listed_room_id")
    horizontal = rooms.select(KEY, "r.room_id", F.explode(F.array_compact(F.array(
        "r.floor.surface_id", "r.ceiling.surface_id"))).alias("surface_id"))
    tables = {
        "rooms": rooms.select(KEY, "r.room_id"), "walls": wall_rows,
        "surfaces": wall_rows.select(KEY, F.col("listed_room_id").alias("room_id"), F.col("wall_id").alias("surface_id"))
        .unionByName(horizontal),
        "openings": openings.select(KEY, "o.opening_id", "o.wall_id"),
        "opening_rooms": openings.select(KEY, "o.opening_id", F.explode("o.room_ids").alias("room_id")),
        "connections": base.select(KEY, F.inline("property.room_connections")),
        "damages": base.select(KEY, F.inline("damages")).select(KEY, "damage_id", "room_id", "surface_id"),
        "flags": base.select(KEY, F.inline("concealed_damage_flags")).select(KEY, "flag_id", "room_id", "surface_id"),
        "scope": base.select(KEY, F.inline("scope_line_items")).select(
            KEY, "line_item_id", "room_id", "surface_id", "damage_id"),
        "warnings": base.select(KEY, F.inline("warnings")).select(KEY, "code", "room_id", "surface_id"),
        "polygons": reduce(DataFrame.unionByName, [df.select(KEY, F.col(entity).alias("surface_id"), F.col(points).alias("points")) for df, entity, points in (
            (rooms, "r.room_id", "r.polygon.points"), (rooms, "r.floor.surface_id", "r.floor.polygon.points"), (rooms, "r.ceiling.surface_id", "r.ceiling.polygon.points"),
            (base, "property.property_id", "property.footprint_polygon.points"), (outlines, "property_id", "c.points"),
            (base.select(KEY, F.inline("damages")), "damage_id", "polygon_2d.points"))]).filter("points is not null"),
        "boxes": base.select(KEY, F.inline("damages")).filter("bounding_box is not null").select(
            KEY, F.col("damage_id").alias("entity"), F.col("bounding_box.min_point.x").alias("min_x"),
            F.col("bounding_box.min_point.y").alias("min_y"), F.col("bounding_box.max_point.x").alias("max_x"),
            F.col("bounding_box.max_point.y").alias("max_y")),
        "processing": base.select(KEY, "processing_info.started_at", "processing_info.completed_at"),
    }

    def refs(owner: DataFrame, kind: str, owner_kind: str, owner_id: str, room: str, column: str) -> DataFrame:
        return owner.select(KEY, F.lit(owner_kind).alias("owner_kind"), F.col(owner_id).alias("owner_id"),
                            F.col(room).alias("owner_room_id"), F.lit(kind).alias("kind"),
                            F.explode(column).alias("ref_id"))

    tables["refs"] = reduce(DataFrame.unionByName, [
        refs(rooms, "opening", "room", "r.room_id", "r.room_id", "r.opening_ids"),
        refs(rooms, "damage", "room", "r.room_id", "r.room_id", "r.damage_ids"),
        refs(walls, "opening", "wall", "w.wall_id", "listed_room_id", "w.opening_ids"),
        refs(walls, "damage", "wall", "w.wall_id", "listed_room_id", "w.damage_ids"),
        refs(rooms, "damage", "floor", "r.floor.surface_id", "r.room_id", "r.floor.damage_ids"),
        refs(rooms, "damage", "ceiling", "r.ceiling.surface_id", "r.room_id", "r.ceiling.damage_ids")])
    return tables


def validate_documents(documents: DataFrame) -> DataFrame:
    """All cross-entity violations of nested documents: ``uniqueness``, ``references``, ``agreement`` and ``shapes`` of their entities, found inside each document."""
    return violations(documents)
