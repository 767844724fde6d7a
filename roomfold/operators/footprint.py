"""Union of the placed rooms of a property: covered area and outlines, swept over x-slabs as rows.

Between two consecutive abscissas of vertices and crossings no two edges cross, so a slab is a stack of trapezoids.
Slabs never reach over the borders of stripes of fixed width, and every step is keyed by property and stripe, slab or corner: no
task holds a property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.operators import polygons
from roomfold.operators.rings import trace_rings
from roomfold.session import grown

#: Gaps narrower than this count as none, in metres.
TOLERANCE = 1e-7


def _crossings(edges: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Abscissas where edges of two rooms cross; edges meet on the grid cells of their boxes."""
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - TOLERANCE) / cell), F.floor((F.greatest(a, b) + TOLERANCE) / cell))
    cells = edges.select(*keys, "room_id", "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("_i"), span("y0", "y1").alias("_js")).withColumn(
        "_j", F.explode("_js")).drop("_js").repartition(*keys, "_i", "_j")  # shuffled once for both sides
    other = cells.select(*keys, "_i", "_j", *[F.col(c).alias(f"b_{c}") for c in ("room_id", "x0", "y0", "x1", "y1")])
    met = cells.join(other, [*keys, "_i", "_j"]).filter(F.col("room_id") < F.col("b_room_id"))
    rx, ry, sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0")
    dx, dy, cross = F.col("b_x0") - F.col("x0"), F.col("b_y0") - F.col("y0"), rx * sy - ry * sx
    t, u = (dx * sy - dy * sx) / F.nullif(cross, F.lit(0.0)), (dx * ry - dy * rx) / F.nullif(cross, F.lit(0.0))
    return met.withColumn("_t", t).withColumn("_u", u).filter(F.col("_t").between(0, 1) & F.col("_u").between(0, 1)).select(
        *keys, (F.col("x0") + F.col("_t") * rx).alias("x"))


def slabs(placed: DataFrame, keys: list[str], stripe: float = 2.0) -> DataFrame:
    """Covered stacks of every slab: ``xa``, ``xb``, and the heights ``la``, ``lb`` and ``ha``, ``hb`` of lower and upper side at both ends.

    ``placed`` has ``room_id`` and simple ``ring``; rings of no extent cover nothing.
    """
    edges = grown(polygons.edges(placed, [*keys, "room_id"], "ring").select(
        *keys, "room_id", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    sloped = edges.filter("x0 <> x1").select(*keys, "room_id", F.least("x0", "x1").alias("xl"), F.greatest("x0", "x1").alias("xr"), "x0", "y0",
                                             ((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))
    last = F.greatest(F.ceil(F.col("xr") / stripe) - 1, F.floor(F.col("xl") / stripe))
    struck = grown(sloped.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("xl") / stripe), last))))
    found = edges.select(*keys, F.col("x0").alias("x")).unionByName(_crossings(edges, keys, stripe)).withColumn("x", F.round("x", 9))
    # an abscissa on a border belongs to both stripes, which the borders themselves take care of
    events = found.withColumn("stripe", F.floor(F.col("x") / stripe)).unionByName(struck.select(*keys, "stripe").distinct().select(
        *keys, "stripe", F.explode(F.array(F.col("stripe") * stripe, (F.col("stripe") + 1) * stripe)).alias("x")).select(*keys, "x", "stripe")).distinct()
    order = Window.partitionBy(*keys, "stripe").orderBy("x")
    wide = events.select(*keys, "stripe", F.col("x").alias("xa"), F.lead("x").over(order).alias("xb")).filter(F.col("xb") - F.col("xa") > TOLERANCE)
    at = lambda x: F.col("y0") + F.col("slope") * (F.col(x) - F.col("x0"))
    inside = struck.join(wide, [*keys, "stripe"]).filter((F.col("xl") <= F.col("xa") + TOLERANCE) & (F.col("xr") >= F.col("xb") - TOLERANCE)).select(
        *keys, "room_id", "xa", "xb", at("xa").alias("ya"), at("xb").alias("yb")).withColumn("ym", (F.col("ya") + F.col("yb")) / 2)
    room = Window.partitionBy(*keys, "xa", "room_id").orderBy("ym")
    ahead = lambda c: F.lead(c).over(room)
    spans = inside.withColumn("_n", F.row_number().over(room)).withColumns({"hm": ahead("ym"), "ha": ahead("ya"), "hb": ahead("yb")}).filter(
        "_n % 2 = 1 AND hm IS NOT NULL")
    stack = Window.partitionBy(*keys, "xa").orderBy("ym", "hm")
    top = F.max("hm").over(stack.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(top.isNull() | (F.col("ym") > top + TOLERANCE), 1).otherwise(0)).withColumn(
        "_pile", F.sum("_new").over(stack.rowsBetween(Window.unboundedPreceding, 0)))
    piles = marked.groupBy(*keys, "xa", "xb", "_pile").agg(
        F.min(F.struct("ym", "ya", "yb")).alias("_l"), F.max(F.struct("hm", "ha", "hb")).alias("_h"))
    return piles.select(*keys, "xa", "xb", F.col("_l.ya").alias("la"), F.col("_l.yb").alias("lb"), F.col("_h.ha").alias("ha"), F.col("_h.hb").alias("hb"))


def union_areas(placed: DataFrame, keys: list[str], stacks: DataFrame | None = None) -> DataFrame:
    """Area that the rooms of a property cover together; ``stacks`` are its slabs, if they are there already."""
    return (slabs(placed, keys) if stacks is None else stacks).groupBy(*keys).agg(F.sum(
        (F.col("xb") - F.col("xa")) * (F.col("ha") + F.col("hb") - F.col("la") - F.col("lb")) / 2).alias("union_area"))


def _upright(stacks: DataFrame, keys: list[str]) -> DataFrame:
    """Vertical pieces of the outline: where only one of the slabs beside an abscissa is covered."""
    side = lambda x, low, high, left: stacks.select(*keys, F.col(x).alias("x"), F.explode(F.array(
        F.struct(F.round(low, 9).alias("y"), F.lit(1).alias("d")), F.struct(F.round(high, 9).alias("y"), F.lit(-1).alias("d")))).alias("_e")).select(
        *keys, "x", F.col("_e.y").alias("y"), (F.col("_e.d") if left else F.lit(0)).alias("_l"), (F.lit(0) if left else F.col("_e.d")).alias("_r"))
    steps = side("xb", "lb", "hb", True).unionByName(side("xa", "la", "ha", False)).groupBy(*keys, "x", "y").agg(
        F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    order = Window.partitionBy(*keys, "x").orderBy("y")
    swept = steps.select(*keys, "x", "y", F.lead("y").over(order).alias("_y"), F.sum("_l").over(order).alias("_l"), F.sum("_r").over(order).alias("_r")).filter(
        (F.col("_y") - F.col("y") > TOLERANCE) & ((F.col("_l") > 0) != (F.col("_r") > 0)))
    up = F.col("_l") > 0  # covered on the left only: the inside lies left of the way up
    return swept.select(*keys, F.col("x").alias("px"), F.when(up, F.col("y")).otherwise(F.col("_y")).alias("py"), F.col("x").alias("qx"),
                        F.when(up, F.col("_y")).otherwise(F.col("y")).alias("qy"))


def _corner(x: str, y: str) -> Column:
    return F.struct(F.round(F.col(x) * 1e6).cast("long").alias("x"), F.round(F.col(y) * 1e6).cast("long").alias("y"))


def outlines(stacks: DataFrame, keys: list[str]) -> DataFrame:
    """``ring`` number, signed ``area`` (holes are negative), ``perimeter`` and ``outline`` of every ring around covered ground.

    The inside lies to the left of every piece. Where rings touch in a corner, the way goes left, so they stay apart. Corners
    are told apart to a micrometre.
    """
    low = stacks.select(*keys, F.col("xa").alias("px"), F.col("la").alias("py"), F.col("xb").alias("qx"), F.col("lb").alias("qy"))
    high = stacks.select(*keys, F.col("xb").alias("px"), F.col("hb").alias("py"), F.col("xa").alias("qx"), F.col("ha").alias("qy"))
    pieces = low.unionByName(high).unionByName(_upright(stacks, keys)).withColumn("_p", _corner("px", "py")).withColumn("_q", _corner("qx", "qy")).filter(
        "_p <> _q")
    pieces = grown(pieces.withColumn("edge", F.xxhash64("_p", "_q")))
    onward = pieces.select(*keys, F.col("_p").alias("_q"), F.col("edge").alias("next"), (F.col("qx") - F.col("px")).alias("_ox"), (F.col("qy") - F.col("py")).alias("_oy"))
    ix, iy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    turn = F.atan2(ix * F.col("_oy") - iy * F.col("_ox"), ix * F.col("_ox") + iy * F.col("_oy"))
    # a corner has one way on, or two where rings touch
    links = grown(pieces.join(onward, [*keys, "_q"]).withColumn("_turn", turn).groupBy(*keys, "edge").agg(
        F.max(F.struct(F.round("_turn", 9).alias("turn"), "next")).alias("_n"), F.first("px").alias("px"), F.first("py").alias("py"),
        F.first("qx").alias("qx"), F.first("qy").alias("qy")).select(*keys, "edge", F.col("_n.next").alias("next"), F.col("_n.turn").alias("turn"), "px", "py", "qx", "qy"))
    traced = trace_rings(links, keys, carry=["turn", "px", "py", "qx", "qy"])
    bent = F.when(F.abs("turn") > 1e-6, F.struct("position", F.col("qx").alias("x"), F.col("qy").alias("y")))
    return traced.groupBy(*keys, "ring").agg(
        (F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2).alias("area"),
        F.sum(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))).alias("perimeter"),
        F.transform(F.array_sort(F.collect_list(bent)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("outline"))


def footprints(placed: DataFrame, keys: list[str], stacks: DataFrame | None = None) -> DataFrame:
    """``union_area`` and ``outlines`` of every property; outlines go by their area, the largest first, holes last."""
    stacks = grown(slabs(placed, keys)) if stacks is None else stacks
    rings = outlines(stacks, keys).groupBy(*keys).agg(F.sum("area").alias("union_area"), F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("back"), "ring", "outline"))), lambda r: r["outline"]).alias("outlines"))
    return rings
