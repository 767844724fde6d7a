"""Room graphs of all properties at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from roomfold.config import StitchConfig
from roomfold.functions import rigid
from roomfold.operators.groups import map_groups
from roomfold.operators.ordering import best_per_group, top_per_group
from roomfold.operators.rings import trace_rings
from roomfold.session import grown

KEY = "property_id"


def room_pairs(rooms: DataFrame, limit: int | None = None) -> DataFrame:
    """Sorted room pairs of every property; with ``limit`` only the first so many of each.

    Pairs are numbered arithmetically from room ranks, so only the wanted ones exist;
    no room beyond rank ``limit`` can take part in them.
    """
    ids = rooms.select(KEY, "room_id").distinct()
    sizes = ids.groupBy(KEY).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(KEY).orderBy("room_id")
    ranks = top_per_group(ids, [KEY], [F.col("room_id")], limit + 1, "_rank") if limit else ids.withColumn("_rank", F.row_number().over(order))
    ranked = ranks.withColumn("_i", F.col("_rank") - 1).drop("_rank").join(sizes, KEY)
    i, n = F.col("_i"), F.col("_n")
    start = i * (n - 1) - F.floor(i * (i - 1) / 2)  # pairs of earlier rooms
    room_for = F.least(n - 1 - i, F.lit(limit) - start) if limit else n - 1 - i
    firsts = ranked.withColumn("_m", room_for).filter(F.col("_m") > 0).select(
        KEY, F.col("room_id").alias("room_a"), F.explode(F.sequence((i + 1).cast("long"), i + F.col("_m"))).alias("_j"))
    seconds = ranked.select(KEY, F.col("room_id").alias("room_b"), F.col("_i").cast("long").alias("_j"))
    return firsts.join(seconds, [KEY, "_j"]).drop("_j")


def screen_evidence(evidence: DataFrame, rooms: DataFrame, cfg: StitchConfig = StitchConfig()) -> DataFrame:
    """Accept or reject every evidence row.

    An existing rejection reason is kept, except for unknown rooms. Where ``max_pairs`` is set, at most so
    many rows of a property stay accepted, the best scores first; the others are rejected for the budget.
    """
    known = rooms.select(KEY, "room_id").distinct().hint("merge")
    side = lambda name: known.select(KEY, F.col("room_id").alias(name), F.lit(True).alias(f"_{name}"))
    joined = evidence.join(side("room_a"), [KEY, "room_a"], "left").join(side("room_b"), [KEY, "room_b"], "left")
    reason = (F.when(F.col("_room_a").isNull() | F.col("_room_b").isNull(), "unknown_room")
              .when(F.col("relative_transform").isNull(), F.coalesce("rejection_reason", F.lit("relative_transform_unavailable")))
              .when(~F.col("accepted") | (F.col("score") < cfg.acceptance),
                    F.coalesce("rejection_reason", F.lit("below_acceptance_threshold"))))
    judged = joined.withColumn("rejection_reason", reason).drop("_room_a", "_room_b")
    if cfg.max_pairs:
        best = top_per_group(judged.filter("rejection_reason IS NULL"), [KEY], [F.col("score").desc(), F.col("ordinal")], cfg.max_pairs)
        kept = best.select(KEY, "ordinal", F.lit(True).alias("_kept")).hint("merge")
        judged = judged.join(kept, [KEY, "ordinal"], "left").withColumn("rejection_reason", F.when(
            F.col("_kept").isNull(), F.coalesce("rejection_reason", F.lit("pair_budget")))).drop("_kept")
    return judged.withColumn("accepted", F.col("rejection_reason").isNull())


def best_evidence(frame_pairs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Highest combined score per room pair, first one on ties; pairs without any get a default row."""
    best = best_per_group(frame_pairs, [KEY, "room_a", "room_b"], [F.col("score").desc(), F.col("ordinal")])
    out = pairs.join(best, [KEY, "room_a", "room_b"], "left")
    return (out.withColumn("rejection_reason", F.when(F.col("score").isNull(), "NO_CROSS_ROOM_MATCHES")
                           .otherwise(F.col("rejection_reason")))
            .withColumn("score", F.coalesce("score", F.lit(0.0)))
            .withColumn("accepted", F.coalesce("accepted", F.lit(False))))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.col("room_a").alias("u"), F.col("room_b").alias("v")).unionByName(
        edges.select(KEY, F.col("room_b").alias("u"), F.col("room_a").alias("v"))).distinct()


def components(rooms: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of graphs of any size: smallest reachable room id per room.

    Minimum labels spread along edges and every label then jumps to its own label,
    which shortens long chains; all properties advance together until nothing changes.
    """
    links = grown(_both_ways(edges))
    labels = grown(rooms.select(KEY, F.col("room_id").alias("u")).distinct().withColumn("label", F.col("u")))
    for _ in range(max_rounds):
        heard = links.join(labels.withColumnRenamed("u", "v"), [KEY, "v"]).groupBy(KEY, "u").agg(F.min("label").alias("_h"))
        spread = labels.join(heard, [KEY, "u"], "left").select(
            KEY, "u", F.col("label").alias("_old"), F.least("label", F.coalesce("_h", "label")).alias("label"))
        target = spread.select(KEY, F.col("u").alias("label"), F.col("label").alias("_far"))
        jumped = grown(spread.join(target.hint("merge"), [KEY, "label"], "left").select(
            KEY, "u", "_old", F.least("label", F.coalesce("_far", "label")).alias("label")))
        if jumped.filter("label <> _old").isEmpty():
            break
        labels = jumped.drop("_old")
    else:
        raise ValueError("components did not settle; raise max_rounds")
    return labels.select(KEY, F.col("u").alias("room_id"), F.col("label").alias("component"))


def component_list(parts: DataFrame) -> DataFrame:
    """Components ranked by (size descending, smallest room)."""
    sizes = parts.groupBy(KEY, "component").agg(F.count("*").alias("size"))
    return sizes.withColumn("component_no", F.row_number().over(
        Window.partitionBy(KEY).orderBy(F.col("size").desc(), "component")))


def choose_root(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """Root by (degree, summed score, area) descending, then room id."""
    ends = edges.select(KEY, F.explode(F.array("room_a", "room_b")).alias("room_id"), "score")
    degree = ends.groupBy(KEY, "room_id").agg(F.count("*").alias("degree"), F.sum("score").alias("total"))
    scored = rooms.join(degree.hint("merge"), [KEY, "room_id"], "left").fillna({"degree": 0, "total": 0.0})
    return best_per_group(scored, [KEY], [F.col("degree").desc(), F.col("total").desc(), F.col("area").desc(),
                                          F.col("room_id")]).select(KEY, F.col("room_id").alias("root"))


def _forest(edges: pa.Table, bounds: np.ndarray) -> pa.Table:
    """Maximum spanning forests of properties of bounded size, whose better edges come first, each joining two groups."""
    keep = []
    firsts, seconds = edges["room_a"].to_pylist(), edges["room_b"].to_pylist()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(low, high):
            a, b = find(firsts[i]), find(seconds[i])
            if a != b:
                keep.append(i)
                parent[a] = b
    return edges.take(pa.array(keep, pa.int64()))


def _forest_rounds(ends: DataFrame, max_rounds: int) -> list[DataFrame]:
    """The same for properties of any size: every group of rooms takes its best edge, and groups so joined become one.

    Groups at least halve in number, and no property is gathered in one row.
    """
    alive = ends.select(KEY, "connection_id", "score", F.col("room_a").alias("ga"), F.col("room_b").alias("gb"))
    chosen = []
    rank = [F.col("score").desc(), F.col("connection_id")]
    for _ in range(max_rounds):
        alive = grown(alive.filter("ga <> gb"))
        if alive.isEmpty():
            return chosen
        sides = alive.withColumn("g", F.explode(F.array("ga", "gb")))
        best = grown(best_per_group(sides, [KEY, "g"], rank).select(KEY, "connection_id", "ga", "gb").distinct())
        chosen.append(best.select(KEY, "connection_id"))
        groups = alive.select(KEY, F.explode(F.array("ga", "gb")).alias("room_id")).distinct()
        merged = components(groups, best.select(KEY, F.col("ga").alias("room_a"), F.col("gb").alias("room_b")))
        label = lambda g: merged.select(KEY, F.col("room_id").alias(g), F.col("component").alias(f"_{g}"))
        alive = alive.join(label("ga"), [KEY, "ga"]).join(label("gb"), [KEY, "gb"]).select(
            KEY, "connection_id", "score", F.col("_ga").alias("ga"), F.col("_gb").alias("gb"))
    raise ValueError("spanning forest did not settle; raise max_rounds")


def spanning_edges(edges: DataFrame, max_rounds: int = 40, small: int = 20_000) -> DataFrame:
    """Maximum spanning forest: an edge joins two groups that no better edge joined before, by (score, smaller connection id).

    Properties of at most ``small`` edges are joined up one by one, many in one pass; larger ones go through rounds over rows. Both
    give the same edges.
    """
    ends = grown(edges.select(KEY, "connection_id", "room_a", "room_b", "score"))
    large = grown(ends.groupBy(KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select(KEY))
    types = dict(ends.dtypes)
    tree = map_groups(ends.join(large, KEY, "left_anti"), [KEY], f"{KEY} {types[KEY]}, connection_id {types['connection_id']}", _forest,
                      [F.nanvl(F.col("score").cast("double"), F.lit(None)).desc_nulls_last(), F.col("connection_id").asc_nulls_last()])
    if not large.isEmpty():
        for part in _forest_rounds(ends.join(large, KEY, "left_semi"), max_rounds):
            tree = tree.unionByName(part)
    return edges.join(tree.distinct().hint("merge"), [KEY, "connection_id"], "left_semi")


def rooted(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """``room_id``, ``parent`` and the ``step`` from it, for all rooms that the tree joins to the root.

    The tree is walked around as one ring of directed edges: behind an edge comes the next one, in a fixed turn, from the room it leads to. Seen
    from the root, an edge leads outwards if its ring position comes before that of its opposite. Rings are put in order by pointer
    jumping, so a tree of n rooms takes log2(n) rounds whatever its depth.
    """
    turn = Window.partitionBy(KEY, "at").orderBy("to")
    ring = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = grown(steps.select(KEY, "at", "to", F.coalesce(F.lead("to").over(turn), F.first("to").over(ring)).alias("after"), F.first("to").over(ring).alias("first")))
    name = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("to"))
    links = out.select(KEY, name("at", "to").alias("edge"), F.col("to").alias("_at"), F.col("at").alias("_to")).join(
        out.select(KEY, F.col("at").alias("_at"), F.col("to").alias("_to"), "after"), [KEY, "_at", "_to"]).select(KEY, "edge", name("_at", "after").alias("next"))
    traced = grown(trace_rings(links, [KEY]).select(KEY, "ring", "size", "position", F.col("edge.at").alias("at"), F.col("edge.to").alias("to")))
    begin = out.join(roots.select(KEY, F.col("root").alias("at")), [KEY, "at"]).filter("to = first").select(KEY, "at", "to").join(
        traced, [KEY, "at", "to"]).select(KEY, "ring", F.col("position").alias("_p0"))
    placed = traced.join(begin, [KEY, "ring"]).withColumn("rank", F.pmod(F.col("position") - F.col("_p0"), F.col("size"))).select(KEY, "at", "to", "rank")
    back = placed.select(KEY, F.col("to").alias("at"), F.col("at").alias("to"), F.col("rank").alias("_back"))
    outward = placed.join(back.hint("merge"), [KEY, "at", "to"]).filter("rank < _back").select(KEY, "at", "to")
    return steps.join(outward, [KEY, "at", "to"]).select(KEY, F.col("to").alias("room_id"), F.col("at").alias("parent"), "step")


def _deep_layout(roots: DataFrame, steps: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Poses of all rooms: each knows the transform from an ancestor, and takes over that of the ancestor's ancestor in every round."""
    top = roots.select(KEY, F.col("root").alias("room_id"), F.col("root").alias("above"), rigid.identity(3).alias("pose"))
    state = grown(rooted(steps, roots).select(KEY, "room_id", F.col("parent").alias("above"), F.col("step").alias("pose")).unionByName(top))
    for _ in range(max_rounds):
        if state.join(roots, KEY).filter("above <> root").isEmpty():
            return state.select(KEY, "room_id", "pose")
        higher = state.select(KEY, F.col("room_id").alias("above"), F.col("above").alias("_above"), F.col("pose").alias("_pose"))
        state = grown(state.join(higher, [KEY, "above"]).select(
            KEY, "room_id", F.col("_above").alias("above"), rigid.compose(F.col("_pose"), F.col("pose"), 3).alias("pose")))
    raise ValueError("layout did not settle; raise max_rounds")


def layout(roots: DataFrame, tree: DataFrame, levels: int = 12) -> DataFrame:
    """Room-to-property transform by composing tree edges outwards from the root.

    Shallow trees are placed level by level; properties that are deeper than ``levels`` are placed by pointer jumping, in
    a number of rounds that grows with the logarithm of their rooms.
    """
    forward = tree.select(KEY, F.col("room_a").alias("at"), F.col("room_b").alias("to"), F.col("relative_transform").alias("step"))
    backward = tree.select(KEY, F.col("room_b").alias("at"), F.col("room_a").alias("to"),
                           rigid.invert(F.col("relative_transform"), 3).alias("step"))
    steps = grown(forward.unionByName(backward))
    frontier = grown(roots.select(KEY, F.col("root").alias("room_id"), F.lit(None).cast(
        roots.schema["root"].dataType).alias("parent"), rigid.identity(3).alias("pose")))
    placed = [frontier]
    for _ in range(levels):
        reached = frontier.join(steps, (steps[KEY] == frontier[KEY]) & (steps["at"] == frontier["room_id"])
                                & (frontier["parent"].isNull() | (steps["to"] != frontier["parent"])))
        frontier = grown(reached.select(frontier[KEY], F.col("to").alias("room_id"), F.col("at").alias("parent"),
                                      rigid.compose(F.col("pose"), F.col("step"), 3).alias("pose")))
        if frontier.isEmpty():
            break
        placed.append(frontier)
    out = placed[0]
    for level in placed[1:]:
        out = out.unionByName(level)
    out = out.select(KEY, "room_id", "pose")
    if frontier.isEmpty():
        return out
    deep = grown(frontier.select(KEY).distinct())
    rest = _deep_layout(grown(roots.join(deep, KEY, "left_semi")), grown(steps.join(deep, KEY, "left_semi")))
    return out.join(deep, KEY, "left_anti").unionByName(rest)


def edge_residuals(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """Disagreement (dx, dy, dyaw) of every edge with the two poses it connects."""
    a = poses.select(KEY, F.col("room_id").alias("room_a"), F.col("pose").alias("_pa"))
    b = poses.select(KEY, F.col("room_id").alias("room_b"), F.col("pose").alias("_pb"))
    both = edges.join(a.hint("merge"), [KEY, "room_a"]).join(b.hint("merge"), [KEY, "room_b"])
    both = both.withColumn("_rel", rigid.compose(rigid.invert(F.col("_pa"), 3), F.col("_pb"), 3))
    both = both.withColumn("_delta", rigid.compose(rigid.invert(F.col("relative_transform"), 3), F.col("_rel"), 3))
    x, y, yaw = rigid.se2_components(F.col("_delta"))
    both = both.withColumn("rx", x).withColumn("ry", y).withColumn("ryaw", yaw)
    norm = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("ryaw") * F.col("ryaw"))
    return both.withColumn("residual", norm).drop("_pa", "_pb", "_rel", "_delta")


def check_cycles(edges: DataFrame, tree: DataFrame, poses: DataFrame, threshold: float) -> DataFrame:
    """Tree edges stay; other edges stay while their cycle residual is within the threshold."""
    in_tree = tree.select(KEY, "connection_id", F.lit(True).alias("_tree"))
    judged = edge_residuals(edges, poses).join(in_tree.hint("merge"), [KEY, "connection_id"], "left")
    on_tree = F.coalesce("_tree", F.lit(False))
    return judged.withColumn("in_tree", on_tree).withColumn("retained", on_tree | (F.col("residual") <= threshold)).drop("_tree")


def _turn(angle: np.ndarray) -> np.ndarray:
    """Transposed rotations."""
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([np.stack([c, s], -1), np.stack([-s, c], -1)], -2)


def _residuals(state: np.ndarray, a: np.ndarray, b: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted disagreement (layout, edge, 3) of stacked layouts with their edges; edges of weight zero are padding."""
    row = np.arange(len(state))[:, None]
    pa, pb = state[row, a], state[row, b]
    rel = np.einsum("leij,lej->lei", _turn(pa[..., 2]), pb[..., :2] - pa[..., :2])
    shift = np.einsum("leij,lej->lei", _turn(goal[..., 2]), rel - goal[..., :2])
    angle = (pb[..., 2] - pa[..., 2] - goal[..., 2] + np.pi) % (2 * np.pi) - np.pi
    return np.concatenate([shift, angle[..., None]], axis=2) * weight[..., None]


def _jacobian(state: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray, goal: np.ndarray, weight: np.ndarray, free: int) -> np.ndarray:
    """Derivatives (layout, 3 * edge, 3 * free room); ``slot`` numbers the free rooms of a layout, -1 is its root."""
    count, edges = a.shape
    row = np.arange(count)[:, None]
    pa, pb = state[row, a], state[row, b]
    outer = _turn(goal[..., 2])
    inner = outer @ _turn(pa[..., 2])
    spin = np.einsum("leij,lejk,lek->lei", outer, _turn(pa[..., 2] + np.pi / 2), pb[..., :2] - pa[..., :2])  # of the transposed rotation
    out = np.zeros((count, edges, 3, free, 3))
    for end, sign in ((a, -1.0), (b, 1.0)):
        k = slot[row, end]
        at, e = np.nonzero(k >= 0)
        k = k[at, e]
        out[at, e, :2, k, :2] += sign * inner[at, e]
        out[at, e, 2, k, 2] += sign
        if sign < 0:
            out[at, e, :2, k, 2] += spin[at, e]
    return (out * weight[:, :, None, None, None]).reshape(count, edges * 3, free * 3)


def _settle(state: np.ndarray, slot: np.ndarray, a: np.ndarray, b: np.ndarray, goal: np.ndarray, weight: np.ndarray, free: int, max_iterations: int) -> np.ndarray:
    """Huber-weighted Levenberg-Marquardt steps on stacked layouts; each has its own damping and stops by itself."""
    def cost(f):
        size = np.abs(f)
        return np.where(size <= 1, f * f, 2 * size - 1).sum(axis=(1, 2))

    state, open_ = state.copy(), np.arange(len(state))
    f, damping = _residuals(state, a, b, goal, weight), np.full(len(state), 1e-6)
    for _ in range(max_iterations):
        if not len(open_):
            break
        here = [v[open_] for v in (state, a, b, goal, weight)]
        jac = _jacobian(here[0], here[1], here[2], slot[open_], here[3], here[4], free)
        flat = f[open_].reshape(len(open_), -1, 1)
        robust = 1.0 / np.maximum(np.abs(flat), 1.0)
        turned = jac.transpose(0, 2, 1)
        move = np.linalg.solve(turned @ (robust * jac) + damping[open_, None, None] * np.eye(free * 3), -turned @ (robust * flat)).reshape(len(open_), free, 3)
        steps = np.concatenate([move, np.zeros((len(open_), 1, 3))], axis=1)  # the root, at -1, stays
        trial = here[0] + steps[np.arange(len(open_))[:, None], slot[open_]]
        after = _residuals(trial, *here[1:])
        good = cost(after) <= cost(f[open_])
        kept, lost = open_[good], open_[~good]
        state[kept], f[kept], damping[kept] = trial[good], after[good], np.maximum(damping[kept] / 10, 1e-12)
        damping[lost] *= 10
        open_ = np.concatenate([kept[np.abs(move[good]).max(axis=(1, 2)) >= 1e-10], lost[damping[lost] <= 1e6]])
    return state


def refine_layout(poses: DataFrame, edges: DataFrame, roots: DataFrame,
                  cfg: StitchConfig = StitchConfig(), work: int = 1_000_000) -> DataFrame:
    """Huber-weighted layout with the root fixed, plus the RMS residual per property.

    A property's accepted edges are solved together. Properties of about the same size are stacked and take their steps side by
    side, as many as keep ``work`` derivatives at once, or a single one of any size.
    """
    types = dict(poses.dtypes)
    schema = f"{KEY} {types[KEY]}, room_id {types['room_id']}, pose array<double>, rms double"
    spot = lambda m: [m[i].alias(f"m{i}") for i in (0, 2, 3, 5)]
    nodes = poses.join(roots.hint("merge"), KEY).select(
        KEY, F.lit(0).alias("kind"), F.col("room_id").alias("one"), F.when(F.col("room_id") == F.col("root"), F.col("root")).alias("two"), *spot(F.col("pose")), F.lit(1.0).alias("score"))
    used = edges.select(KEY, F.lit(1).alias("kind"), F.col("room_a").alias("one"), F.col("room_b").alias("two"), *spot(F.col("relative_transform")), F.col("score").cast("double").alias("score"))

    def solve(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        is_node = table["kind"].to_numpy() == 0
        own = group[is_node]
        known = np.bincount(own, minlength=len(bounds) - 1) > 0  # properties without a pose have no layout
        is_edge = ~is_node & known[group]
        owner = group[is_edge]
        one, two = (table[c].combine_chunks() for c in ("one", "two"))
        codes = pa.concat_arrays([one, two]).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64).reshape(2, -1)
        place = np.column_stack([table["m2"].to_numpy(), table["m5"].to_numpy(), np.arctan2(table["m3"].to_numpy(), table["m0"].to_numpy())])
        weight = np.sqrt(np.maximum(table["score"].to_numpy()[is_edge], 1e-3))
        wide = codes.max(initial=0) + 1
        name = own * wide + codes[0, is_node]
        order = np.argsort(name, kind="stable")
        first = np.searchsorted(own, np.arange(len(bounds)))
        start_edge = np.searchsorted(owner, np.arange(len(bounds)))

        def index(code):
            want = owner * wide + code
            at = order[np.minimum(np.searchsorted(name[order], want), len(name) - 1)]
            if (name[at] != want).any():
                raise ValueError("an edge leads to a room without a pose")
            return at - first[owner]

        a, b = index(codes[0, is_edge]), index(codes[1, is_edge])
        state, goal = place[is_node], place[is_edge]
        loose = codes[1, is_node] < 0
        so_far = np.cumsum(loose)
        slot = np.where(loose, so_far - 1 - np.append(0, so_far)[first[own]], -1)
        free, rooms, links = np.bincount(own, loose, len(bounds) - 1).astype(int), np.diff(first), np.diff(start_edge)
        rms = np.zeros(len(bounds) - 1)
        todo = np.flatnonzero(links > 0)
        todo = todo[np.lexsort((links[todo], free[todo]))]
        while len(todo):
            load = 9 * np.maximum.accumulate(free[todo]) * np.maximum.accumulate(links[todo]) * np.arange(1, len(todo) + 1)
            some, todo = np.split(todo, [max(1, int(np.searchsorted(load, work, side="right")))])
            stacked = lambda values, begin, sizes, fill: _padded(values, begin[some], sizes[some], fill)
            s, k = stacked(state, first, rooms, 0.0), stacked(slot, first, rooms, -1)
            e = [stacked(v, start_edge, links, fill) for v, fill in ((a, 0), (b, 0), (goal, 0.0), (weight, 0.0))]
            most = int(free[some].max())
            done = _settle(s, k, *e, most, cfg.max_iterations) if most else s
            f = _residuals(done, *e)
            rms[some] = np.sqrt((f * f).sum(axis=(1, 2)) / (3 * links[some]))
            inside = np.arange(done.shape[1])[None] < rooms[some][:, None]
            state[(first[some][:, None] + np.arange(done.shape[1]))[inside]] = done[inside]
        c, s = np.cos(state[:, 2]), np.sin(state[:, 2])
        zero, unit = np.zeros(len(state)), np.ones(len(state))
        flat = np.column_stack([c, -s, state[:, 0], s, c, state[:, 1], zero, zero, unit])
        rows = pa.array(np.flatnonzero(is_node))
        pose = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, 9), pa.int32()), pa.array(flat.ravel()))
        return pa.table({KEY: table[KEY].take(rows), "room_id": one.take(rows), "pose": pose, "rms": pa.array(rms[own])})

    return map_groups(nodes.unionByName(used), [KEY], schema, solve, ["kind", "one", "two"])


def _padded(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, fill: float) -> np.ndarray:
    """Runs of values stacked to the length of the longest."""
    inside = np.arange(sizes.max(initial=0))[None] < sizes[:, None]
    out = np.full((*inside.shape, *values.shape[1:]), fill, values.dtype)
    out[inside] = values[(begin[:, None] + np.arange(inside.shape[1]))[inside]]
    return out
