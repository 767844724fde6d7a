"""Order-dependent greedy selections as folds over bounded blocks.

``blocked_fold`` walks every group in blocks of ``block_rows`` consecutive
positions. Blocks without rows do not count: a group takes its turns through the
blocks it has. All groups advance together; what crosses a block border is a small
state row. A group of normal size needs one block, hence one pass. Once a group's
state can no longer change (``closed``) its remaining blocks run side by side.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from roomfold.config import FrameConfig, PhotoConfig, VideoConfig
from roomfold.operators.groups import map_frames, map_groups
from roomfold.operators.ordering import positions, top_per_group
from roomfold.session import cut, fresh, stage_path

Step = Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]]


def blocked_fold(df: DataFrame, keys: list[str], seq: str, step: Step, out_schema: str,
                 state_schema: str, block_rows: int = 50_000) -> DataFrame:
    """Fold ``step`` along ``seq`` inside each group.

    ``step`` gets the ordered rows of one block and the state left by the block before
    (None at first) and returns output rows plus the new state. Both schemas exclude
    the keys; the state has a boolean ``closed``.
    """
    out_cols = [part.strip().split(" ", 1)[0] for part in out_schema.split(", ")]
    state_cols = [part.strip().split(" ", 1)[0] for part in state_schema.split(", ")]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    key_order = [f.name for f in df.schema.fields if f.name in keys]
    schema = (f"{key_schema}, _is_state boolean, {out_schema}, "
              + ", ".join(f"_s_{part.strip()}" for part in state_schema.split(", ")))
    columns = [*key_order, "_is_state", *out_cols, *[f"_s_{c}" for c in state_cols]]

    def run(pdf: pd.DataFrame, state: dict | None) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        rows, after = step(pdf, state)
        out = rows.astype(object)
        out = out.where(out.notna(), None)
        out["_is_state"] = False
        for c in state_cols:
            out[f"_s_{c}"] = None
        last = {c: None for c in columns}
        last.update({k: pdf[k].iloc[0] for k in key_order})
        last["_is_state"] = True
        last.update({f"_s_{c}": after[c] for c in state_cols})
        for k in key_order:
            out[k] = pdf[k].iloc[0]
        tail = pd.DataFrame([last], columns=columns, dtype=object)
        return pd.concat([out[columns].astype(object), tail], ignore_index=True)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, None)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group that has a single block: nothing is left for a later turn."""
        rows, _ = step(pdf.sort_values(seq, kind="stable"), None)
        for k in key_order:
            rows[k] = pdf[k].iloc[0]
        return rows[[*key_order, *out_cols]]

    def later(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=columns)
        return run(left, {c: right[f"_s_{c}"].iloc[0] for c in state_cols})

    blocks = df.withColumn("_block", F.floor(F.col(seq) / block_rows))
    if not blocks.agg(F.max("_block")).first()[0]:
        return map_frames(df, keys, f"{key_schema}, {out_schema}", whole)

    # A group's n-th block that has rows is its n-th turn, wherever it starts and whatever gaps it has.
    turns = blocks.select(*keys, "_block").distinct().withColumn(
        "_turn", (F.row_number().over(Window.partitionBy(*keys).orderBy("_block")) - 1).cast("int"))
    spark, path = df.sparkSession, stage_path(df.sparkSession, "turns")
    staged = blocks.join(turns, [*keys, "_block"]).drop("_block")
    staged.write.partitionBy("_turn").parquet(path)
    blocks = spark.read.schema(staged.schema).parquet(path)  # a turn is read alone
    last_turn = blocks.agg(F.max("_turn")).first()[0]
    result = cut(blocks.filter("_turn = 0").drop("_turn").groupBy(*keys).applyInPandas(first, schema))
    outputs = [result.filter(~F.col("_is_state"))]
    states = result.filter("_is_state")
    for number in range(1, int(last_turn) + 1):
        closed = states.filter("_s_closed")
        if not closed.isEmpty():
            # A closed state is constant: every remaining block is independent.
            rest = blocks.filter(F.col("_turn") >= number).join(closed.select(*keys), keys, "left_semi")
            copies = rest.select(*keys, "_turn").distinct().join(closed, keys)
            finished = (rest.groupBy(*keys, "_turn").cogroup(fresh(copies).groupBy(*keys, "_turn"))
                        .applyInPandas(lambda a, b: later(a.drop(columns="_turn"), b), schema))
            outputs.append(cut(finished).filter(~F.col("_is_state")))
        states = states.filter(~F.col("_s_closed"))
        part = blocks.filter(F.col("_turn") == number).drop("_turn").join(states.select(*keys), keys, "left_semi")
        result = cut(part.groupBy(*keys).cogroup(fresh(states).groupBy(*keys)).applyInPandas(later, schema))
        outputs.append(result.filter(~F.col("_is_state")))
        states = result.filter("_is_state")
    merged = outputs[0]
    for extra in outputs[1:]:
        merged = merged.unionByName(extra)
    return merged.select(*key_order, *out_cols)


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    cosine = (np.sum(a * b) - 1.0) / 2.0
    return float(np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0))))


def motion_keyframes(df: DataFrame, keys: list[str], cfg: FrameConfig = FrameConfig(),
                     seq: str = "seq", pose: str = "pose", block_rows: int = 50_000,
                     usable: str | None = None) -> DataFrame:
    """Frames moved or turned far enough from the last *kept* frame, at most ``max_frames``.

    ``usable`` marks frames whose cloud is large enough to be kept at all.
    """
    rotation = [0, 1, 2, 4, 5, 6, 8, 9, 10]

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        count = int(state["kept"]) if state else 0
        last = np.asarray(state["pose"], dtype=float) if state and state["pose"] is not None else None
        poses = np.vstack(pdf[pose].to_numpy()) if len(pdf) else np.empty((0, 16))
        able = pdf[usable].to_numpy(bool) if usable else np.ones(len(pdf), bool)
        keep = np.zeros(len(pdf), bool)
        for i, current in enumerate(poses):
            if count >= cfg.max_frames:
                break
            if not able[i]:
                continue
            if last is not None:
                shift = np.linalg.norm(current[[3, 7, 11]] - last[[3, 7, 11]])
                if shift < cfg.min_translation and _angle(last[rotation], current[rotation]) < cfg.min_rotation:
                    continue
            keep[i], last, count = True, current, count + 1
        rows = pd.DataFrame({seq: pdf[seq].to_numpy(), "selected": keep})
        return rows, {"kept": count, "pose": None if last is None else list(last), "closed": count >= cfg.max_frames}

    return blocked_fold(df.select(*keys, seq, pose, *([usable] if usable else [])), keys, seq, step,
                        f"{seq} long, selected boolean",
                        "kept int, pose array<double>, closed boolean", block_rows)


def visual_keyframes(df: DataFrame, keys: list[str], cfg: VideoConfig = VideoConfig(), seq: str = "seq",
                     block_rows: int = 50_000) -> DataFrame:
    """Ladder dark, blur, time, duplicate, budget; change is against the last kept frame.

    Needs columns brightness, blur, ts (seconds) and thumb.
    """

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        count = int(state["kept"]) if state else 0
        last_ts = state["ts"] if state else None
        last = np.asarray(state["thumb"], dtype=float) if state and state["thumb"] is not None else None
        thumbs = np.vstack(pdf["thumb"].to_numpy()).astype(float)
        reasons, changes = [], []
        for i, (bright, blur, ts) in enumerate(zip(pdf["brightness"], pdf["blur"], pdf["ts"])):
            change = float(np.mean(np.abs(thumbs[i] - last))) if last is not None else None
            reason = None
            if bright < cfg.dark:
                reason = "dark"
            elif blur < cfg.blur:
                reason = "blur"
            elif count and ts - last_ts < cfg.min_gap:
                reason = "time"
            elif change is not None and change < cfg.duplicate:
                reason = "duplicate"
            elif count >= cfg.max_keyframes:
                reason = "budget"
            else:
                count, last_ts, last = count + 1, float(ts), thumbs[i]
            reasons.append(reason)
            changes.append(change)
        rows = pd.DataFrame({seq: pdf[seq].to_numpy(), "visual_change": changes, "rejection_reason": reasons})
        return rows, {"kept": count, "ts": last_ts, "thumb": None if last is None else list(last),
                      "closed": count >= cfg.max_keyframes}

    return blocked_fold(df.select(*keys, seq, "brightness", "blur", "ts", "thumb"), keys, seq, step,
                        f"{seq} long, visual_change double, rejection_reason string",
                        "kept int, ts double, thumb array<double>, closed boolean", block_rows)


def select_photos(df: DataFrame, keys: list[str], cfg: PhotoConfig = PhotoConfig(), seq: str = "seq",
                  block_rows: int = 50_000) -> DataFrame:
    """Best photos by rank; near copies of a chosen photo are skipped, two are always kept.

    ``seq`` is the rank by (score descending, name).
    """

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        thumbs = np.vstack(pdf["thumb"].to_numpy()).astype(float)
        before = state["thumbs"] if state else []
        chosen, count = np.empty((min(cfg.max_images, len(before) + len(thumbs)), thumbs.shape[1])), len(before)
        for i, thumb in enumerate(before):
            chosen[i] = thumb
        reasons = []
        for thumb in thumbs:
            if (np.abs(chosen[:count] - thumb).mean(axis=1) < cfg.duplicate).any():
                reasons.append("near_duplicate")
            elif count < cfg.max_images:
                chosen[count] = thumb
                count += 1
                reasons.append(None)
            else:
                reasons.append("selection_budget")
        rows = pd.DataFrame({seq: pdf[seq].to_numpy(), "reason": reasons})
        return rows, {"thumbs": [list(t) for t in chosen[:count]],
                      "closed": count >= cfg.max_images}

    folded = blocked_fold(df.select(*keys, seq, "thumb"), keys, seq, step, f"{seq} long, reason string",
                          "thumbs array<array<double>>, closed boolean", block_rows)
    # Backfill: the first near copies of a room that would stay below the minimum. Only rooms
    # with fewer than ``min_images`` choices qualify, and only their first copies are kept.
    counts = folded.groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("_chosen"))
    short = counts.filter(F.col("_chosen") < cfg.min_images)
    copies = folded.filter("reason = 'near_duplicate'").join(short, keys)
    refill = (top_per_group(copies, keys, [F.col(seq)], cfg.min_images, "_nth")
              .filter(F.col("_nth") <= cfg.min_images - F.col("_chosen"))
              .select(*keys, seq, F.lit(True).alias("_refill")))
    return (folded.join(refill, [*keys, seq], "left")
            .withColumn("rejection_reason", F.when(F.col("_refill"), F.lit(None)).otherwise(F.col("reason")))
            .withColumn("selected", F.col("rejection_reason").isNull())
            .select(*keys, seq, "selected", "rejection_reason"))


#: Cells a trace wider than the radius, so that rounding leaves no two cells between spots within it.
MARGIN = 1 + 1e-9


def islands(spots: DataFrame, keys: list[str], coords: list[str], radius: float) -> DataFrame:
    """Adds ``_island``: spots of different islands lie further apart than ``radius``.

    Along each coordinate in turn a run of occupied cells, one radius wide, ends where a cell is empty:
    nothing can bridge two cells that are not neighbours. Only distinct cells are ordered, never rows.
    """
    out = spots.withColumn("_island", F.lit(0).cast("long"))
    for c in coords:
        owner = [*keys, "_island"]
        cell = F.floor(F.col(c) / (radius * MARGIN))
        order = Window.partitionBy(*owner).orderBy("_cell")
        cells = out.select(*owner, cell.alias("_cell")).distinct()
        starts = cells.withColumn("_new", (F.col("_cell") - F.lag("_cell").over(order) > 1).cast("int"))
        runs = starts.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order)).drop("_new")
        # the first cell of a run names it, together with the island it lies in
        first = runs.withColumn("_first", F.min("_cell").over(Window.partitionBy(*owner, "_run")))
        named = first.select(*owner, "_cell", F.xxhash64("_island", "_first").alias("_named"))
        out = out.withColumn("_cell", cell).join(named, [*owner, "_cell"]).drop("_cell", "_island").withColumnRenamed("_named", "_island")
    return out


def leader_spots(df: DataFrame, keys: list[str], coords: list[str], order: list[str], radius: float,
                 bucket: str, block_rows: int = 50_000) -> DataFrame:
    """First-fit inside islands that no radius bridges: every distinct coordinate with ``local_no`` and ``opens``.

    Rows with equal coordinates always share a group, so each distinct coordinate is folded once, at the place of its
    earliest row (``_first``, ``_b``). Islands stream through the tasks one after another; across blocks of rows only the leaders
    of one island are kept, in cells of one radius, so a spot looks at the leaders beside it only.
    """
    spots = cut(df.groupBy(*keys, *coords).agg(
        F.min(F.struct(F.col(bucket).alias("b"), *[F.col(o) for o in order])).alias("_first")))
    owner = [*keys, "_island"]
    turn = F.row_number().over(Window.partitionBy(*owner).orderBy("_first"))
    ranked = islands(spots, keys, coords, radius).select(*owner, *coords, "_first", (turn == 1).alias("_start"))
    side, around = radius * MARGIN, list(itertools.product((-1, 0, 1), repeat=len(coords)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cells = 0, {}
        for batch in (b.slice(i, block_rows) for b in batches for i in range(0, b.num_rows, block_rows)):
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in coords], axis=1)
            places = np.floor(points / side).astype(np.int64).tolist()
            starts = batch.column("_start").to_numpy(zero_copy_only=False).tolist()
            labels, opened = [], []
            for point, place, start in zip(points.tolist(), places, starts):
                if start:
                    count, cells = 0, {}
                found = 0
                for step in around:
                    for number, other in cells.get(tuple(map(add, place, step)), ()):
                        gap = abs(point[0] - other[0]) if len(point) == 1 else math.sqrt(sum((a - b) * (a - b) for a, b in zip(point, other)))
                        if gap <= radius and not 0 < found < number:
                            found = number
                if not found:
                    count += 1
                    cells.setdefault(tuple(place), []).append((count, point))
                labels.append(found or count)
                opened.append(not found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.int64()), pa.array(opened, pa.bool_())],
                                             names=[*batch.schema.names[:-1], "local_no", "opens"])

    schema = StructType([*ranked.schema.fields[:-1], StructField("local_no", LongType()), StructField("opens", BooleanType())])
    return cut(ranked.mapInArrow(fold, schema).withColumn("_b", F.col("_first.b")))


def leader_groups(df: DataFrame, keys: list[str], coords: list[str], order: list[str], radius: float,
                  bucket: str, block_rows: int = 50_000) -> DataFrame:
    """First-fit groups: join the earliest group whose *first member* is within ``radius``.

    ``bucket`` names a column that does not decrease along ``order`` and spreads the ranking of a large key. Groups are
    numbered over the whole key in the order of their leaders. Returns the distinct coordinates with group_no (1-based, in
    creation order) and whether they open their group.
    """
    folded = leader_spots(df, keys, coords, order, radius, bucket, block_rows)
    numbered = positions(folded.filter("opens"), keys, ["_first"], F.col("_b"), "_no").select(
        *keys, "_island", "local_no", (F.col("_no") + 1).alias("group_no"))
    return folded.join(numbered, [*keys, "_island", "local_no"]).select(*keys, *coords, "group_no", "opens")


def _side_by_side(points: list[np.ndarray], group: np.ndarray, radius: float) -> np.ndarray:
    """First-fit numbers of spots that come by group and turn; every round settles one leader of each group.

    The first open spot of a group leads, and it takes all open spots within the radius: their earlier leaders are further off.
    """
    number, label, left = 0, np.zeros(len(group), np.int64), np.arange(len(group))
    while len(left):
        number += 1
        leads = np.append(True, group[1:] != group[:-1])
        leader = np.maximum.accumulate(np.where(leads, np.arange(len(group)), 0))
        gaps = [p - p[leader] for p in points]
        gap = np.abs(gaps[0]) if len(gaps) == 1 else np.sqrt(sum(g * g for g in gaps))
        taken = leads | (gap <= radius)
        label[left[taken]] = number
        left, group, points = left[~taken], group[~taken], [p[~taken] for p in points]
    return label


def leader_members(df: DataFrame, keys: list[str], coords: list[str], order: list[str], radius: float,
                   bucket: str, block_rows: int = 50_000, small: int = 20_000) -> DataFrame:
    """Rows of ``df`` with the ``group_no`` of ``leader_groups``; rows without key or coordinates have none and are left out.

    Keys of at most ``small`` rows go through one sort and one pass, many of them at a time; larger ones take ``leader_groups``.
    """
    known = df.filter(reduce(and_, [F.col(c).isNotNull() for c in (*keys, *coords)]))
    large = cut(known.groupBy(*keys).count().filter(F.col("count") > small).select(*keys))

    def settle(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        points = [table[c].to_numpy().astype(float) for c in coords]
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        alike = np.lexsort((*points[::-1], group))  # stable: of equal coordinates the earliest row comes first
        fresh = np.append(True, group[alike][1:] != group[alike][:-1])
        for p in points:
            ahead, back = p[alike][1:], p[alike][:-1]
            fresh[1:] |= (ahead != back) & ~(np.isnan(ahead) & np.isnan(back))
        first = alike[fresh]
        turn = np.argsort(first)
        spot = np.empty(len(group), np.int64)
        spot[alike] = np.argsort(turn)[np.cumsum(fresh) - 1]
        rows = first[turn]
        label = _side_by_side([p[rows] for p in points], group[rows], radius)
        return table.append_column("group_no", pa.array(label[spot]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    whole = lambda rows: map_groups(rows, keys, f"{fields}, group_no long", settle, [bucket, *order, *coords])
    if large.isEmpty():
        return whole(known)
    many = known.join(large, keys, "left_semi")
    groups = leader_groups(many, keys, coords, order, radius, bucket, block_rows)
    return whole(known.join(large, keys, "left_anti")).unionByName(
        many.join(groups.drop("opens"), [*keys, *coords]).select(*known.columns, "group_no"))
