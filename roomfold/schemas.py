"""Declared schema of a capture result document. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURE = ("struct<value:double,unit:string,lower_bound:double,upper_bound:double,confidence_level:double,"
           "confidence_score:double,method:string,confidence_method:string>")
POINT = "struct<x:double,y:double>"
POLYGON = f"struct<points:array<{POINT}>>"
META = "map<string,string>"
WALL = (f"struct<wall_id:string,room_id:string,start_point:{POINT},end_point:{POINT},length:{MEASURE},"
        f"height:{MEASURE},thickness:{MEASURE},orientation:{MEASURE},opening_ids:array<string>,"
        f"damage_ids:array<string>,confidence:double,metadata:{META}>")
FLOOR = (f"struct<surface_id:string,polygon:{POLYGON},area:{MEASURE},material:string,damage_ids:array<string>,"
         f"confidence:double,metadata:{META}>")
CEILING = (f"struct<surface_id:string,polygon:{POLYGON},height:{MEASURE},area:{MEASURE},"
           f"damage_ids:array<string>,confidence:double,metadata:{META}>")
OPENING = (f"struct<opening_id:string,type:string,wall_id:string,room_ids:array<string>,width:{MEASURE},"
           f"height:{MEASURE},sill_height:{MEASURE},position_along_wall:{MEASURE},confidence:double,metadata:{META}>")
ROOM = (f"struct<room_id:string,name:string,room_type:string,polygon:{POLYGON},floor:{FLOOR},ceiling:{CEILING},"
        f"walls:array<{WALL}>,opening_ids:array<string>,damage_ids:array<string>,confidence:double,metadata:{META}>")
CONNECTION = ("struct<connection_id:string,room_a_id:string,room_b_id:string,opening_id:string,"
              "connection_type:string,confidence:double>")
BOUNDS = f"struct<length:{MEASURE},width:{MEASURE},height:{MEASURE}>"
PROPERTY = (f"struct<property_id:string,rooms:array<{ROOM}>,openings:array<{OPENING}>,"
            f"room_connections:array<{CONNECTION}>,footprint_polygon:{POLYGON},"
            f"footprint_components:array<{POLYGON}>,total_floor_area:{MEASURE},bounding_dimensions:{BOUNDS},"
            f"confidence:double,metadata:{META}>")
BOX = f"struct<min_point:{POINT},max_point:{POINT}>"
DAMAGE = (f"struct<damage_id:string,damage_type:string,surface_id:string,room_id:string,polygon_2d:{POLYGON},"
          f"bounding_box:{BOX},metric_area:{MEASURE},metric_length:{MEASURE},severity:string,confidence:double,"
          f"source_frames:array<string>,notes:string,metadata:{META}>")
FLAG = (f"struct<flag_id:string,room_id:string,surface_id:string,suspected_damage_type:string,rule_id:string,"
        f"rule_description:string,evidence:array<string>,confidence:double,metadata:{META}>")
SCOPE = (f"struct<line_item_id:string,room_id:string,surface_id:string,damage_id:string,action:string,"
         f"description:string,quantity:{MEASURE},confidence:double,metadata:{META}>")
WARNING = "struct<code:string,message:string,room_id:string,surface_id:string>"
ISSUE = "struct<code:string,message:string,module:string>"
CAPTURE = (f"struct<capture_id:string,tier:string,source_type:string,source_reference:string,"
           f"capture_timestamp:timestamp,processing_timestamp:timestamp,metadata:{META}>")
PROCESSING = (f"struct<pipeline_version:string,started_at:timestamp,completed_at:timestamp,"
              f"processing_seconds:double,modules_used:array<string>,model_versions:{META},"
              f"errors:array<{ISSUE}>,metadata:{META}>")

RESULT_DDL = (f"schema_version string, capture {CAPTURE}, property {PROPERTY}, damages array<{DAMAGE}>, "
              f"concealed_damage_flags array<{FLAG}>, scope_line_items array<{SCOPE}>, "
              f"warnings array<{WARNING}>, processing_info {PROCESSING}, metadata {META}")


def result_schema() -> T.StructType:
    return T.StructType.fromDDL(RESULT_DDL)


def field(ddl: str) -> T.DataType:
    return T.StructType.fromDDL(f"v {ddl}")["v"].dataType


# Closed vocabularies.
TIERS = ["photo", "video", "lidar"]
UNITS = {"length": "m", "area": "m2", "angle": "degree"}
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9_.:-]*$"
MEASUREMENT_COLUMNS = ["measurement_id", "tier", "room_id", "surface_id", "measurement_type", "value", "unit",
                       "lower_bound", "upper_bound", "confidence_level", "confidence_method"]
SCHEMA_VERSION_RULE = "1.0.0"

# Unit of every measurement kind (scope quantities may use three units).
UNIT_BY_KIND = {
    "total_floor_area": "m2", "property_length": "m", "property_width": "m", "property_height": "m",
    "wall_length": "m", "wall_height": "m", "wall_thickness": "m", "wall_orientation": "degree",
    "floor_area": "m2", "ceiling_height": "m", "ceiling_area": "m2", "opening_width": "m", "opening_height": "m",
    "sill_height": "m", "opening_position": "m", "damage_area": "m2", "damage_length": "m",
}
