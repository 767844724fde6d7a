"""Quality blends and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roomfold.config import OpeningConfig


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def photo_quality(blur: Column, contrast: Column, features: Column, brightness: Column) -> Column:
    return (F.sqrt(blur) + contrast * 2.0 + F.least(features, F.lit(1000)) / 10.0
            - F.abs(brightness - 127.5) / 10.0)


def association(distance: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance / limit)


def opening_geometry_score(distance: Column, count: Column, cfg: OpeningConfig) -> Column:
    return (0.7 * association(distance, cfg.wall_distance)
            + 0.3 * F.least(F.lit(1.0), count / (cfg.min_points * 3.0)))


def opening_quality(kind: Column, semantic: Column, geometry: Column, v_min: Column,
                    cfg: OpeningConfig) -> Column:
    base = 0.45 * semantic + 0.55 * geometry
    return (F.when((kind == "door") & (v_min > cfg.floor_contact), base * 0.75)
            .when((kind == "window") & (v_min <= cfg.floor_contact), base * 0.5).otherwise(base))


def damage_quality(semantic: Column, residual: Column, views: Column, limit: float) -> Column:
    return F.least(F.lit(1.0), 0.45 * semantic + 0.30 * association(residual, limit)
                   + 0.25 * F.least(F.lit(1.0), views / 3.0))


def visual_score(inliers: Column, raw: Column, min_inliers: int) -> Column:
    return F.least(F.lit(1.0), inliers / float(min_inliers * 2)) * (inliers / F.greatest(raw, F.lit(1)))


def connection_score(visual: Column, geometry: Column) -> Column:
    return 0.45 * visual + 0.55 * geometry


def plane_quality(rmse: Column, threshold: float) -> Column:
    return F.exp(-rmse / threshold)


def scale_quality(mad: Column, scale: Column) -> Column:
    return 1.0 / (1.0 + mad / scale)


def lower_bound(value: Column, half: Column) -> Column:
    return F.greatest(F.lit(0.0), value - half)
