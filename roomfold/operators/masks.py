"""Morphology and connected regions of masks and grids, as rows: set cells, and runs of set cells along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.config import OpeningConfig
from roomfold.operators import graph
from roomfold.operators.rings import numbered
from roomfold.session import cut


def _reach(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Every cell once for each window of ``size`` x ``size`` that holds it; ``row`` and ``col`` are those of the window."""
    before = size // 2
    around = F.sequence(F.lit(before - size + 1), F.lit(before))
    return cells.select(*keys, "row", "col", F.explode(around).alias("_r")).select(*keys, (F.col("row") + F.col("_r")).alias("row"), "col", F.explode(around).alias("_c")).select(
        *keys, "row", (F.col("col") + F.col("_c")).alias("col"))


def dilate(cells: DataFrame, sizes: DataFrame, keys: list[str], size: int = 3, border: bool = False) -> DataFrame:
    """Cells whose window holds a set cell; with ``border`` the outside of the grid counts as set.

    ``cells`` has each set cell once, ``sizes`` the ``height`` and ``width`` of every grid.
    """
    before = size // 2
    inside = _reach(cells, keys, size).join(sizes, keys).filter(
        F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)).select(*keys, "row", "col")
    if border:
        line = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rim = lambda n, i: (F.col(i) < before) | (F.col(i) >= F.col(n) - (size - 1 - before))
        rows = sizes.select(*keys, "height", "width", line("height").alias("row"))
        # whole lines near the rim, and the ends of all others
        whole = rows.filter(rim("height", "row")).select(*keys, "row", line("width").alias("col"))
        ends = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda c: (c < before) | (c >= F.col("width") - (size - 1 - before)))
        inside = inside.unionByName(whole).unionByName(rows.select(*keys, "row", F.explode(ends).alias("col")))
    return inside.distinct()


def erode(cells: DataFrame, sizes: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """Cells whose window is set throughout; the outside of the grid counts as set."""
    before = size // 2
    seen = lambda n, i: F.least(F.col(n) - 1, F.col(i) - before + size - 1) - F.greatest(F.lit(0), F.col(i) - before) + 1
    counted = _reach(cells, keys, size).groupBy(*keys, "row", "col").agg(F.count("*").alias("_n")).join(sizes, keys)
    return counted.filter(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
                          & (F.col("_n") == seen("height", "row") * seen("width", "col"))).select(*keys, "row", "col")


def runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``row``, ``start`` and ``stop`` (one past the last) of every run of set cells along a line."""
    line = Window.partitionBy(*keys, "row").orderBy("col")
    return cells.withColumn("_g", F.col("col") - F.row_number().over(line)).groupBy(*keys, "row", "_g").agg(
        F.min("col").alias("start"), (F.max("col") + 1).alias("stop")).drop("_g")


def gaps(found: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of unset cells between the runs ``found`` and up to the borders, on lines without any run too."""
    rows = sizes.select(*keys, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    ends = rows.select(*keys, "row", F.explode(F.array(
        F.struct(F.lit(-1).alias("start"), F.lit(0).alias("stop")), F.struct(F.col("width").alias("start"), (F.col("width") + 1).alias("stop")))).alias("_e")).select(
        *keys, "row", F.col("_e.start").cast("int").alias("start"), F.col("_e.stop").cast("int").alias("stop"))
    line = Window.partitionBy(*keys, "row").orderBy("start")
    every = found.select(*keys, "row", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")).unionByName(ends)
    return every.select(*keys, "row", F.col("stop").alias("start"), F.lead("start").over(line).alias("stop")).filter("stop > start")


def _name(row: Column, start: Column) -> Column:
    """Number of a run in raster order; lines have less than a million cells."""
    return F.shiftleft(row.cast("long"), 20) + start


def regions(found: DataFrame, keys: list[str], diagonal: bool) -> DataFrame:
    """Runs with ``component``, the number of their connected region from one in raster order of the first cell.

    Runs are joined to the runs of the next line that they touch (``diagonal``: also by a corner) and regions are the components of these links,
    so a region costs its runs, not its cells, and no image or wall is labelled in one task.
    """
    named = cut(found.select(*keys, "row", "start", "stop", _name(F.col("row"), F.col("start")).alias("run")))
    reach = 1 if diagonal else 0
    below = named.select(*keys, (F.col("row") - 1).alias("row"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.col("run").alias("room_b"))
    links = named.join(below, [*keys, "row"]).filter((F.col("_s") < F.col("stop") + reach) & (F.col("start") < F.col("_e") + reach))
    key = F.struct(*keys).alias(graph.KEY)
    parts = graph.components(named.select(key, F.col("run").alias("room_id")), links.select(key, F.col("run").alias("room_a"), "room_b"))
    flat = parts.select(*[F.col(f"{graph.KEY}.{k}").alias(k) for k in keys], F.col("room_id").alias("run"), F.col("component").alias("_c"))
    ranked = numbered(flat.select(*keys, "_c").distinct(), keys, ["_c"], "component")
    return named.join(flat, [*keys, "run"]).join(ranked, [*keys, "_c"]).select(*keys, "row", "start", "stop", "component")


def mask_components(masks: DataFrame, cfg: OpeningConfig = OpeningConfig(), keys: list[str] = ("frame_id", "kind")) -> DataFrame:
    """Pixels of every cleaned 8-connected region of a probability mask that is large enough.

    ``masks`` has one row per pixel; a group is one class of one image. Cleaning opens and then closes the mask. Pixels that closing
    adds without a row of their own have probability 0.
    """
    keys, size = list(keys), cfg.morphology
    pixels = cut(masks.select(*keys, "row", "col", "probability"))
    sizes = cut(pixels.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")))
    cells = pixels.filter(F.col("probability") >= cfg.min_score).select(*keys, "row", "col").distinct()
    if size > 1:
        cells = dilate(erode(cells, sizes, keys, size), sizes, keys, size)
        cells = erode(dilate(cells, sizes, keys, size), sizes, keys, size)
    found = regions(runs(cells, keys), keys, diagonal=True)
    large = found.groupBy(*keys, "component").agg(F.sum(F.col("stop") - F.col("start")).alias("_n")).filter(F.col("_n") >= cfg.min_pixel_area).drop("_n")
    cleaned = found.join(large, [*keys, "component"]).select(*keys, "row", "component", F.explode(F.sequence("start", F.col("stop") - 1)).alias("col"))
    return cleaned.join(pixels, [*keys, "row", "col"], "left").select(
        *keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.col("component").cast("int").alias("component"))


def component_table(pixels: DataFrame, keys: list[str] = ("frame_id", "kind")) -> DataFrame:
    """Area, bounding box and median score per region."""
    keys = list(keys)
    return pixels.groupBy(*keys, "component").agg(
        F.count("*").alias("pixel_area"), F.min("col").alias("left"), F.min("row").alias("top"),
        (F.max("col") + 1).alias("right"), (F.max("row") + 1).alias("bottom"),
        F.median("probability").alias("semantic_score")).withColumn(
        "candidate_id", F.concat_ws(":", F.lit("candidate"), *keys, "component"))
