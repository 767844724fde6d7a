"""Places where a user's model or capture format plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Grey = np.ndarray
DEPTH = "capture_id string, frame_id string, row int, col int, z double, error string"
MASKS = "capture_id string, frame_id string, kind string, row int, col int, probability double, error string"
DAMAGE = "capture_id string, frame_id string, candidate int, label string, score double, row int, col int, error string"


def _over_images(images: DataFrame, rows: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``rows`` on every image; a failing image becomes one row with its error text.

    ``images``: capture_id, frame_id, height, width, pixels. Images are independent, so
    nothing is shuffled and one image at a time is expanded.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                try:
                    out = rows(np.asarray(r.pixels, dtype=float).reshape(int(r.height), int(r.width)))
                    out["error"] = None
                except Exception as failure:  # noqa: BLE001 - any model failure skips only its frame
                    out = pd.DataFrame([{"error": str(failure)}])
                out["capture_id"], out["frame_id"] = r.capture_id, r.frame_id
                yield out.reindex(columns=names)

    return images.select("capture_id", "frame_id", "height", "width", "pixels").mapInPandas(run, schema)


def predict_depth(images: DataFrame, predict: Callable[[Grey], np.ndarray]) -> DataFrame:
    def rows(image: np.ndarray) -> pd.DataFrame:
        depth = np.asarray(predict(image), dtype=float)
        if depth.shape != image.shape:
            raise ValueError("depth shape differs from image")
        r, c = np.indices(depth.shape)
        return pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "z": depth.ravel()})
    return _over_images(images, rows, DEPTH)


def predict_surfaces(images: DataFrame, predict: Callable[[Grey], dict[str, np.ndarray]]) -> DataFrame:
    def rows(image: np.ndarray) -> pd.DataFrame:
        parts = []
        for kind, mask in predict(image).items():
            if mask.shape != image.shape:
                raise ValueError("mask shape differs from image")
            r, c = np.indices(mask.shape)
            parts.append(pd.DataFrame({"kind": kind, "row": r.ravel(), "col": c.ravel(), "probability": mask.ravel().astype(float)}))
        return pd.concat(parts, ignore_index=True)
    return _over_images(images, rows, MASKS)


def predict_damage(images: DataFrame, predict: Callable[[Grey], list[tuple[str, np.ndarray, float]]]) -> DataFrame:
    def rows(image: np.ndarray) -> pd.DataFrame:
        parts = [pd.DataFrame(columns=["candidate", "label", "score", "row", "col"])]
        for number, (label, mask, score) in enumerate(predict(image)):
            r, c = np.nonzero(mask)
            parts.append(pd.DataFrame({"candidate": number, "label": label, "score": float(score), "row": r, "col": c}))
        return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
    return _over_images(images, rows, DAMAGE)


def prediction_warnings(predicted: DataFrame, code: str) -> DataFrame:
    return predicted.filter("error IS NOT NULL").select("capture_id", F.lit(code).alias("code"), F.concat_ws(": ", "frame_id", "error").alias("message"))


@dataclass(frozen=True)
class SparseModel:
    """What a sparse-reconstruction provider supplies: three tables keyed by capture."""

    frames: DataFrame
    points: DataFrame
    observations: DataFrame


@dataclass(frozen=True)
class CaptureTables:
    """What a capture adapter supplies; any function returning this is an adapter."""

    frames: DataFrame
    poses: DataFrame
    intrinsics: DataFrame
    samples: DataFrame
