"""Centroid clusters and hard negatives against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomfold.llm import clusters, negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, x int, n int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "other", 1, 2, 3) for i, v, c in rows], SCHEMA)


def cloud(n, width, seed, centres=4):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 0.3, (centres, width))
    return [[float(np.float32(x)) for x in middle[i % centres] + draw.normal(0, 0.15, width)] for i in range(n)]


def odd(rows, width):
    """The same with rows that take no part, and repeats."""
    bad = [(9001, None, 1), (9002, [None] * width, 1), (9003, [float("nan")] * width, 2), (9004, [float("inf")] * width, 2)]
    return rows + bad


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, np.array([math.floor(scale * c) for c in v], object)) for i, v, _ in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    centres = [v for _, v in kept[:k]]
    for t in range(rounds + 1):
        best = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres)) for _, v in kept]
        if t < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), b in zip(kept, best) if b[1] == j]
                centres[j] = sum(own) // len(own) if own else centres[j]
    return sorted((str(i), b[1], b[0]) for (i, _), b in zip(kept, best)), centres


@pytest.mark.parametrize("n, k", [(300, 16), (5, 16), (40, 1)])
def test_clusters_equal_plain_ones(spark, n, k):
    width = 8
    rows = odd([(i, v, 0) for i, v in enumerate(cloud(n, width, n))], width)
    rows += [rows[3]] * 60 + [(None, rows[4][1], None), (8000, [0.5] * 7, 1), (8001, [], 1), (8002, rows[2][1], 1)]
    settings = clusters.Settings(width=width, clusters=k, rounds=3)
    found, centres = clusters.cluster(table(spark, rows), settings=settings)
    want, middle = plain_clusters(rows, k, 3, width, 64)
    got = [tuple(r) for r in found.select("id", "cluster", "distance").collect()]
    assert sorted((str(i), c, d) for i, c, d in got) == want
    assert centres.tolist() == [list(c) for c in middle]
    full = clusters.inertia(found, centres).collect()
    assert {r["inertia"] for r in full} == {sum(d for _, _, d in want)}
    for r in full:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    found, centres = clusters.cluster(table(spark, []))
    assert found.count() == 0 and len(centres) == 0 and clusters.inertia(found, centres).count() == 0
    assert clusters.cluster(table(spark, [(1, None, 1), (2, [1.0], 1)]))[0].count() == 0


def test_bounds_spare_measurements_and_change_nothing():
    x = np.array([[math.floor(64 * c) for c in v] for v in cloud(4000, 16, 7, centres=12)], np.int64)
    history = [x[:12].copy()]
    state = clusters.first_assignment(x, history[0])
    spared = 0
    for t in range(8):
        history.append(np.stack([x[state["cluster"] == j].sum(0) // max((state["cluster"] == j).sum(), 1) for j in range(12)]))
        state = clusters.next_assignment(x, state, history, last=t == 7)
        gaps = np.stack([clusters.squared(x, c) for c in history[-1]], 1)
        assert (state["cluster"] == gaps.argmin(1)).all()
        spared += len(x) * 12 - state["measured"].sum()
    assert (state["distance"] == gaps.min(1)).all()
    assert spared > 0.8 * 8 * 12 * len(x)  # most are never measured


def test_one_displacement_is_a_closer_bound_than_summed_drifts():
    there, away = np.zeros((1, 2), np.int64), np.full((1, 2), 100)
    assert clusters.displacement([there, away, there])[0, 0] == 0
    assert clusters.displacement([there, away])[0, 0] == pytest.approx(math.hypot(100, 100))


def plain_negatives(rows, k, m, every, low=30, high=90):
    kept = [(i, [math.floor(256 * c) for c in v], c) for i, v, c in rows
            if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = set()
    for i, v, c in kept:
        if i is None or i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        best = sorted({(score(w), j) for j, w, d in kept if j != i and d == c}, key=order)[:k]
        for p, j in best:
            fits = sorted({(score(w), o) for o, w, d in kept if o != i and d != c and low * p <= 100 * score(w) <= high * p}, key=order)
            out |= {(i, j, rank + 1, o, p, s) for rank, (s, o) in enumerate(fits[:m])}
    return out


@pytest.mark.parametrize("block", [10_000, 3])
def test_negatives_equal_plain_ones(spark, block):
    width = 40
    rows = odd([(i, v, (i * 7) % 5) for i, v in enumerate(cloud(400, width, 3))], width)
    rows += [rows[7]] * 40 + [rows[0]] * 5  # repeated rows, one of them an anchor
    rows += [(500 + i, rows[9][1], 1) for i in range(30)]  # ties
    rows += [(None, rows[11][1], 2), (None, rows[12][1], 3), (700, [], 1), (720, [0.25, -1.5], 2), (740, [0.0] * width, 3), (760, rows[1][1], None)]
    found = negatives.mine(table(spark, rows), F.col("id") % 20 == 0, settings=negatives.Settings(block=block))
    got = [tuple(r) for r in found.collect()]
    want = plain_negatives(rows, 5, 10, 20)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_negatives_of_nothing(spark):
    for rows in ([], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, None, 1), (200, [1.0], None)]):
        assert negatives.mine(table(spark, rows), F.col("id") % 100 == 0).count() == 0


def test_summaries_bound_scores_and_spare_most():
    draw = np.random.default_rng(5)
    levels = (4, 16, 32)
    middle = draw.normal(0, 40, (20, 64))
    x = np.floor(np.repeat(middle, 100, 0) + draw.normal(0, 6, (2000, 64))).astype(np.int64)
    labels = np.arange(2000) % 2
    whole, last = negatives.Summary.of(x, levels), None
    for mean, deviation in zip(whole.mean, whole.deviation):
        middle, spread = mean @ mean[:50].T, deviation @ deviation[:50].T
        true = x @ x[:50].T
        assert (true <= middle + spread + 1e-3).all() and (true >= middle - spread - 1e-3).all()
        assert last is None or spread.sum() < last  # shorter segments bound closer
        last = spread.sum()
    n = 50
    asked = negatives.Questions(np.arange(n), labels[:n], x[:n], np.arange(n), np.full(n, negatives.NOTHING),
                                np.full(n, -negatives.NOTHING), True, 5)
    search = negatives.Search(asked, levels)
    for a in range(0, 2000, 250):
        rows = slice(a, a + 250)
        search.see(np.arange(2000)[rows], labels[rows], x[rows], negatives.Summary.of(x[rows], levels))
    assert search.scored < 0.4 * search.bounded
    for q in range(n):
        same = [i for i in range(2000) if i != q and labels[i] == labels[q]]
        assert search.ids[q].tolist() == sorted(same, key=lambda i: (-int(x[i] @ x[q]), i))[:5]


def test_large_components_stay_exact():
    x = np.array([[2**27, -2**27, 3]], np.int64)
    assert negatives.exact(x, x[0])[0] == 2 * 2**54 + 9
    assert clusters.squared(x, -x[0])[0] == 4 * (2 * 2**54 + 9)
