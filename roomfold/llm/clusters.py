"""Centroid clustering with bounds that are loosened by total displacement.

Every vector remembers its distance to each centroid and the round in which that distance was measured. All earlier
centroids are kept, so a remembered distance is off by at most the norm of the one displacement between then and now,
which is never more than the summed drifts of the rounds between. A vector is measured anew only against centroids
that these bounds can't rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomfold.llm import vectors
from roomfold.llm.stages import stage

#: Components beyond this would overflow a squared distance of 64-bit integers.
LIMIT = 1 << 27
STATE = "id bigint, x array<int>, cluster int, distance bigint, radius array<float>, seen array<smallint>, measured int"
#: A remembered distance is a 32-bit float; this covers its rounding and that of the sums.
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    width: int = 64
    clusters: int = 16
    rounds: int = 3
    scale: float = 64.0
    seed: str = "1"


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centre."""
    off = x - centre
    return np.einsum("ij,ij->i", off, off)


def displacement(history: Sequence[np.ndarray]) -> np.ndarray:
    """[round, centroid]: how far each centroid is now from where it stood in that round."""
    now = history[-1].astype(np.float64)
    return np.stack([np.sqrt(((now - then) ** 2).sum(1)) for then in history])


def first_assignment(x: np.ndarray, centres: np.ndarray) -> dict[str, np.ndarray]:
    """Every vector is measured against every centroid; ties go to the smaller number."""
    gaps = np.stack([squared(x, c) for c in centres], 1)
    best = gaps.argmin(1)
    return {"cluster": best, "distance": gaps[np.arange(len(x)), best], "radius": np.sqrt(gaps).astype(np.float32),
            "seen": np.zeros(gaps.shape, np.int16), "measured": np.full(len(x), len(centres))}


def next_assignment(x: np.ndarray, state: dict[str, np.ndarray], history: Sequence[np.ndarray], last: bool) -> dict[str, np.ndarray]:
    """Nearest centroids of this round, the same as by measuring all.

    ``distance`` is only brought up to date where a vector was measured, and everywhere in the ``last`` round.
    """
    now, centres = len(history) - 1, history[-1]
    moved = displacement(history)
    own, radius, seen = state["cluster"].astype(np.int64), state["radius"].copy(), state["seen"].copy()
    row, number = np.arange(len(x)), np.arange(len(centres))
    nearest = radius * (1 - SLACK) - moved[seen, number] * (1 + SLACK)  # no centroid is nearer than this
    nearest[row, own] = np.inf
    farthest = radius[row, own] * (1 + SLACK) + moved[seen[row, own], own] * (1 + SLACK)
    loose = (nearest <= farthest[:, None]).any(1)
    distance, measured = state["distance"].copy(), np.zeros(len(x), np.int64)
    again = np.flatnonzero(loose | last)
    for j in np.unique(own[again]):
        at = again[own[again] == j]
        distance[at] = squared(x[at], centres[j])
    radius[again, own[again]] = np.sqrt(distance[again])
    seen[again, own[again]] = now
    measured[again] += 1
    # with the own distance exact, fewer centroids are left to measure
    close = np.flatnonzero(loose)
    open_ = nearest[close] <= (np.sqrt(distance[close]) * (1 + SLACK))[:, None]
    cluster = own.copy()
    for j in number:
        at = close[open_[:, j]]
        if not len(at):
            continue
        gap = squared(x[at], centres[j])
        radius[at, j], seen[at, j] = np.sqrt(gap), now
        measured[at] += 1
        wins = (gap < distance[at]) | ((gap == distance[at]) & (j < cluster[at]))
        distance[at[wins]], cluster[at[wins]] = gap[wins], j
    return {"cluster": cluster, "distance": distance, "radius": radius, "seen": seen, "measured": measured}


def _batch(ids: pa.Array, x: np.ndarray, state: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, vectors.lists(x.astype(np.int32), pa.int32()), pa.array(state["cluster"], pa.int32()), pa.array(state["distance"], pa.int64()),
         vectors.lists(state["radius"], pa.float32()), vectors.lists(state["seen"], pa.int16()), pa.array(state["measured"], pa.int32())],
        names=["id", "x", "cluster", "distance", "radius", "seen", "measured"])


def integer_vectors(df: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """``id`` and integer vector ``x`` of the rows whose vector has the wanted width and only finite components."""
    width, scale = settings.width, settings.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = vectors.ragged(batch.column(1), width)
            good = np.isfinite(values).all(1)
            x = vectors.whole(values[good], scale, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), vectors.lists(x, pa.int32())], names=["id", "x"])

    wide = df.where(F.size(vector) == width).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return wide.mapInArrow(run, "id bigint, x array<int>")


def first_centres(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; equal ids are told apart by their components."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = rows.select("x", F.sha2(name, 256).alias("h")).orderBy("h", "x").limit(settings.clusters).collect()
    return np.array([r["x"] for r in chosen], np.int64).reshape(-1, settings.width)


def moved_centres(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; a centroid without vectors stays where it is.

    A task adds up its vectors per cluster, so only (tasks x clusters) sums are shuffled, and one row per cluster and
    component comes back.
    """
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, own = vectors.fixed(batch.column(0), width), batch.column(1).to_numpy()
            for j in np.unique(own):
                total[j] += x[own == j].sum(0, dtype=np.int64)
            n += np.bincount(own, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), vectors.lists(total[used], pa.int64())],
                                         names=["cluster", "n", "total"])

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centres.copy()
    for r in sums.collect():  # at most clusters x width rows
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``cluster``, squared ``distance`` and ``measured`` of every kept row, and the final centroids.

    Rows take part whose vector has ``width`` components, none of them null or non-finite; components are
    floor(scale * x), held within plus or minus 2**27 so that distances are exact. A null id is hashed as the empty text.
    Repeated rows and equal vectors each count; ties go to the smaller centroid number. With fewer vectors than
    clusters there are fewer centroids, and an empty table gives an empty result. Other columns are not looked at.
    Each round is written to the shared folder; the state of a vector is its distance to each centroid and when it was
    measured (6 bytes a centroid).
    """
    spark = df.sparkSession
    rows = stage(integer_vectors(df, key, vector, settings))
    history = [first_centres(rows, settings)]
    if not len(history[0]):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint, measured int"), history[0]
    width, k, rounds = settings.width, len(history[0]), settings.rounds

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.fixed(batch.column(1), width).astype(np.int64)
            yield _batch(batch.column(0), x, first_assignment(x, history[0]))

    def advance(past: list[np.ndarray]):
        last = len(past) == rounds + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vectors.fixed(batch.column(1), width).astype(np.int64)
                state = {"cluster": batch.column(2).to_numpy(), "distance": batch.column(3).to_numpy(),
                         "radius": vectors.fixed(batch.column(4), k), "seen": vectors.fixed(batch.column(5), k)}
                yield _batch(batch.column(0), x, next_assignment(x, state, past, last))

        return run

    state = stage(rows.mapInArrow(start, STATE))
    for _ in range(rounds):
        history.append(moved_centres(state, history[-1]))
        state = stage(state.drop("measured").mapInArrow(advance(list(history)), STATE))
    return state.select("id", "cluster", "distance", "measured"), history[-1]


def inertia(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` and the hash of the row's centroid; one looked-up row per cluster."""
    spark = found.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    table = [(j, s, sum(sums.values()), name(centres[j])) for j, s in sums.items()]
    info = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(info), "cluster")
