"""Grey-image statistics inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

THUMB_WIDTH, THUMB_HEIGHT = 64, 48


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; borders mirror without repeating the edge."""
    pad = np.pad(grey, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4.0 * grey
    return float(lap.var())


def area_weights(source: int, target: int) -> np.ndarray:
    """Overlap of every target cell with every source pixel, rows summing to one."""
    edges = np.arange(target + 1) * (source / target)
    low = np.maximum(edges[:-1, None], np.arange(source)[None, :])
    high = np.minimum(edges[1:, None], np.arange(1, source + 1)[None, :])
    weights = np.clip(high - low, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def thumbnail(grey: np.ndarray, width: int = THUMB_WIDTH, height: int = THUMB_HEIGHT) -> np.ndarray:
    return area_weights(grey.shape[0], height) @ grey @ area_weights(grey.shape[1], width).T


STATISTICS = T.StructType([
    T.StructField("blur", T.DoubleType()), T.StructField("brightness", T.DoubleType()),
    T.StructField("contrast", T.DoubleType()), T.StructField("all_zero", T.BooleanType()),
    T.StructField("thumb", T.ArrayType(T.DoubleType()))])


#: Images whose results are held at once; a thumbnail takes far more room than a small image.
PIECE = 256


def statistics_of(images: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for grey, height, width in images:
        for start in range(0, len(grey), PIECE):
            rows = []
            for pixels, h, w in zip(*(c.iloc[start:start + PIECE] for c in (grey, height, width))):
                image = np.asarray(pixels, dtype=float).reshape(int(h), int(w))
                rows.append((laplacian_variance(image), float(image.mean()), float(image.std()), not image.any(), thumbnail(image).ravel()))
            yield pd.DataFrame(rows, columns=["blur", "brightness", "contrast", "all_zero", "thumb"])


@F.pandas_udf(STATISTICS)
def grey_statistics(images: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Sharpness, mean, spread, all-zero test and a 64 x 48 area thumbnail per image, returned in pieces of bounded size."""
    return statistics_of(images)
