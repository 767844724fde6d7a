"""Plain morphology and labelling of one grid."""

from __future__ import annotations

import numpy as np


def _window(mask: np.ndarray, size: int, border: bool) -> np.ndarray:
    before = size // 2
    padded = np.pad(mask, (before, size - 1 - before), constant_values=border)
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size))


def dilate(mask: np.ndarray, size: int = 3, border: bool = False) -> np.ndarray:
    return _window(mask, size, border).any(axis=(2, 3))


def erode(mask: np.ndarray, size: int = 3, border: bool = True) -> np.ndarray:
    return _window(mask, size, border).all(axis=(2, 3))


def dilate_cross(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def label(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Connected regions numbered from one in raster order of their first cell.

    Runs of set cells are joined to touching runs of the row above.
    """
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, above = [], []
    reach = 1 if diagonal else 0
    for r, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for start, stop in zip(edges[::2], edges[1::2]):
            number = len(parent)
            parent.append(number)
            for s, e, other in above:
                if s < stop + reach and start < e + reach:
                    a, b = find(number), find(other)
                    parent[max(a, b)] = min(a, b)
            here.append((start, stop, number))
            runs.append((r, start, stop, number))
        above = here
    out = np.zeros(mask.shape, dtype=np.int64)
    names: dict[int, int] = {}
    for r, start, stop, number in runs:
        out[r, start:stop] = names.setdefault(find(number), len(names) + 1)
    return out
