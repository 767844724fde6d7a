"""Measures of stacked ring pairs against those of single pairs."""

import numpy as np
import pandas as pd
import pytest

from roomfold.operators import polygons


def shapes(rng, n):
    """Rings of three to five vertices, turned and moved on a coarse grid so that many touch."""
    out = []
    for _ in range(n):
        k = rng.integers(3, 6)
        if rng.random() < 0.5:
            w, h = rng.integers(1, 5, 2).astype(float)
            ring = np.array([[0, 0], [w, 0], [w, h], [0, h]])
        else:
            angle = np.sort(rng.uniform(0, 2 * np.pi, k))
            ring = np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(1, 3)
        turn = np.pi / 2 * rng.integers(0, 4)
        c, s = np.cos(turn), np.sin(turn)
        out.append(ring @ np.array([[c, s], [-s, c]]) + rng.integers(-3, 4, 2))
    return out


@pytest.mark.parametrize("small", [64, 0])
def test_stacked_pairs_equal_single_ones(small):
    rng = np.random.default_rng(6)
    one, two = shapes(rng, 400), shapes(rng, 400)
    flat = lambda rings: pd.Series([r.ravel() for r in rings])
    for many, single in ((polygons.overlap_areas, polygons.overlap_area), (polygons.shared_lengths, polygons.shared_length), (polygons.boundary_gaps, polygons.boundary_gap)):
        got = polygons._stacked(flat(one), flat(two), many, single, small, work=2000)
        want = np.array([single(a, b) for a, b in zip(one, two)])
        assert np.abs(got - want).max() < 1e-9 and (want > 0).sum() > 30
