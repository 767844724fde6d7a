"""Domain tables derived from the supplied tables.

Each projection is a list of select expressions that both engines accept, so the
input of a query and of its SQL counterpart is the same by construction. Every
projection covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomfold.plans.tables import table

# Points of a cloud per supplier, in whole millimetres: a floor layer, a ceiling layer, clutter.
POINTS = [
    "l_suppkey AS capture_id", "l_orderkey", "l_linenumber", "l_partkey",
    "cast(l_quantity * 100 AS bigint) AS x_mm",
    "cast(floor(l_extendedprice * 10) AS bigint) % 4000 AS y_mm",
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2800 ELSE cast(floor(l_tax * 35000) AS bigint) END AS z_mm",
]

# Frames per user in time order. k is the number inside props.
FRAMES = [
    "user_id AS capture_id", "event_id AS frame_id", "ts", "event_type", "value",
    "cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k",
]

# Edges of room graphs, one property per customer. Rooms are priorities and months.
EDGES = [
    "o_custkey AS property_id", "o_orderkey AS connection_id",
    "concat('p', substr(o_orderpriority, 1, 1)) AS room_a",
    "concat('m', lpad(cast(extract(month FROM o_orderdate) AS varchar(2)), 2, '0')) AS room_b",
    "o_totalprice / 500000 AS score", "o_orderdate",
    "cast(o_orderkey % 7 - 3 AS double) AS dx", "cast(o_orderkey % 5 - 2 AS double) AS dy",
    "o_orderkey % 4 AS quarter",
]

# Walls: one per supplier. Length and angle come from balance and nation.
WALLS = [
    "s_suppkey AS wall_id", "s_nationkey AS room_id",
    "cast(floor(abs(s_acctbal)) AS bigint) % 6 + 5 AS length_m",
    "cast(s_suppkey % 4 AS int) AS side",
]

# Opening candidates on the wall of their supplier; u and width in metres.
CANDIDATES = [
    "l_suppkey AS wall_id", "l_orderkey AS frame_id", "l_orderkey * 8 + l_linenumber AS ordinal",
    "l_partkey", "l_quantity / 10 AS u_min", "l_quantity / 10 + 0.4 + l_discount * 10 AS u_max",
    "l_tax * 5 AS v_min", "l_tax * 5 + 1.2 + l_discount * 8 AS v_max",
    "CASE l_returnflag WHEN 'A' THEN 'door' WHEN 'R' THEN 'window' ELSE 'open_passage' END AS kind",
    "l_discount * 10 AS semantic_score", "l_tax * 12 AS quality",
]


def source(name: str, columns: list[str]) -> str:
    """The projection as a sub-select for SQL text."""
    return f"(SELECT {', '.join(columns)} FROM {name})"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*POINTS)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*FRAMES)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*EDGES)


def walls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*WALLS)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*CANDIDATES)
