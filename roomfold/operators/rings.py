"""Closed rings of directed edges, labelled and put in order by pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from roomfold.operators.groups import map_groups
from roomfold.session import cut, grown


def _walk(group: np.ndarray, edge: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the smallest edge of every edge's ring, how far on that is, and which edges run into an unknown one."""
    n = len(edge)
    code = np.unique(np.concatenate([edge, following]), return_inverse=True)[1] + 2 * n * np.tile(group, 2)
    order = np.argsort(code[:n])
    found = np.minimum(np.searchsorted(code[:n], code[n:], sorter=order), n - 1)
    jump = np.where(code[order[found]] == code[n:], order[found], n)
    jump, root, on, step = np.append(jump, n), np.arange(n + 1), np.zeros(n + 1, np.int64), 1
    value = np.append(edge, np.iinfo(np.int64).max)
    while True:
        later = root[jump]
        better = value[later] < value[root]
        ahead = jump[jump]
        if not better.any() and np.array_equal(ahead == n, jump == n):
            return root[:n], on[:n], jump[:n] == n
        root, on, jump, step = np.where(better, later, root), np.where(better, on[jump] + step, on), ahead, 2 * step


def trace_rings(links: DataFrame, keys: list[str], max_rounds: int = 40, carry: list[str] = (), small: int = 20_000) -> DataFrame:
    """``ring``, ``position`` and ring ``size`` of every edge, from rows (keys, ``edge``, ``next``); columns of ``carry`` stay.

    Every edge has one successor and one predecessor in its group. Groups of at most ``small`` edges are settled many at a time in
    one pass. In larger ones an edge knows the smallest edge among the next 2**k and how far on it is; each round doubles that span, so a
    ring of n edges is through after log2(n) rounds, and no group is walked in one task. ``ring`` is the smallest edge of
    the ring, which has position 0.
    """
    links = links.select(*keys, "edge", "next", *carry)
    if links.schema["edge"].dataType != LongType():  # edges of several fields
        return _trace_far(links, keys, max_rounds, carry)
    large = cut(links.groupBy(*keys).count().filter(F.col("count") > small).select(*keys))
    types = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    kept = [*keys, "edge", *carry]

    def settle(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        edge = table["edge"].to_numpy()
        root, on, lost = _walk(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), edge, table["next"].to_numpy())
        size = np.bincount(root[~lost], minlength=len(edge))[root]
        place = (size - on) % np.maximum(size, 1)
        out = {c: table[c] for c in kept} | {c: pa.array(v) for c, v in (("ring", edge[root]), ("size", size), ("position", place))}
        return pa.table(out).filter(pa.array(~lost))

    fields = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", ring long, size long, position long"
    whole = lambda rows: map_groups(rows, keys, fields, settle).select(*keys, "edge", "ring", "size", "position", *carry)
    if large.isEmpty():
        return whole(links)
    far = _trace_far(links.join(large, keys, "left_semi").hint("merge"), keys, max_rounds, carry)
    return whole(links.join(large, keys, "left_anti")).unionByName(far)


def _trace_far(links: DataFrame, keys: list[str], max_rounds: int, carry: list[str]) -> DataFrame:
    far = _trace_rounds(links, keys, max_rounds)
    return far.join(links.drop("next"), [*keys, "edge"]).select(*far.columns, *carry) if carry else far


def _trace_rounds(links: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """``trace_rings`` by rounds over rows."""
    first = F.struct(F.col("edge").alias("id"), F.lit(0).cast("long").alias("on"))
    state = grown(links.select(*keys, "edge", F.col("next").alias("jump"), first.alias("least")))
    for k in range(max_rounds):
        ahead = state.select(*keys, F.col("edge").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        later = F.struct(F.col("_least.id").alias("id"), (F.col("_least.on") + F.lit(1 << k)).alias("on"))
        step = grown(state.join(ahead, [*keys, "jump"]).select(
            *keys, "edge", F.col("_jump").alias("jump"), F.least("least", later).alias("least"), (later < F.col("least")).alias("_new")))
        state = step.drop("_new")
        if step.filter("_new").isEmpty():
            break
    else:
        raise ValueError("rings did not close; raise max_rounds")
    labelled = state.select(*keys, "edge", F.col("least.id").alias("ring"), F.col("least.on").alias("_on"))
    sizes = labelled.groupBy(*keys, "ring").agg(F.count("*").alias("size"))
    return labelled.join(sizes, [*keys, "ring"]).select(
        *keys, "edge", "ring", "size", F.pmod(F.col("size") - F.col("_on"), F.col("size")).alias("position"))


def first_fit_spots(spots: DataFrame, keys: list[str], tolerance: float, max_rounds: int = 60) -> DataFrame:
    """``spot``: the number of the first earlier kept spot within ``tolerance``, or the row's own number ``n``.

    Taken in the order of ``n`` a spot is kept unless a kept one lies close. All spots are settled side by side: one is
    settled as soon as every closer-ranked neighbour is. Neighbours are found on grid cells of the tolerance.
    """
    base = grown(spots.select(*keys, "n", "x", "y"))
    cell = [F.floor(F.col(c) / tolerance).alias(f"_c{c}") for c in "xy"]
    around = base.select(*keys, F.col("n"), "x", "y", *cell)
    for c in "xy":
        around = around.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_d")).drop("_d")
    other = base.select(*keys, F.col("n").alias("m"), F.col("x").alias("_x"), F.col("y").alias("_y"), *cell)
    near = grown(around.join(other, [*keys, "_cx", "_cy"]).filter(
        (F.col("m") < F.col("n")) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= tolerance)).select(*keys, "n", "m"))
    state = base.select(*keys, "n", F.lit(None).cast(dict(base.dtypes)["n"]).alias("spot"))
    for _ in range(max_rounds):
        seen = near.join(state.select(*keys, F.col("n").alias("m"), F.col("spot").alias("_s")), [*keys, "m"]).groupBy(*keys, "n").agg(
            F.min(F.when(F.col("_s") == F.col("m"), F.col("m"))).alias("_kept"), F.min(F.when(F.col("_s").isNull(), F.col("m"))).alias("_open"))
        fits = F.when(F.col("_kept").isNotNull() & (F.col("_open").isNull() | (F.col("_open") > F.col("_kept"))), F.col("_kept"))
        alone = F.when(F.col("_kept").isNull() & F.col("_open").isNull(), F.col("n"))
        state = grown(state.join(seen, [*keys, "n"], "left").select(*keys, "n", F.coalesce("spot", fits, alone).alias("spot")))
        if state.filter("spot IS NULL").isEmpty():
            return state
    raise ValueError("spots did not settle; raise max_rounds")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered inside groups that configuration bounds."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
