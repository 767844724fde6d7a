"""Pinhole camera expressions and wall-local coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roomfold.functions.rigid import apply_point, cell


def ray_point(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column,
              cy: Column) -> tuple[Column, Column, Column]:
    return (u - cx) / fx * z, (v - cy) / fy * z, z


def backproject(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column,
                pose: Column) -> tuple[Column, Column, Column]:
    """World point seen at pixel (u, v) with optical-axis depth z."""
    return apply_point(pose, *ray_point(u, v, z, fx, fy, cx, cy))


def to_camera(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    dx, dy, dz = x - cell(pose, 0, 3), y - cell(pose, 1, 3), z - cell(pose, 2, 3)
    return tuple(cell(pose, 0, c) * dx + cell(pose, 1, c) * dy + cell(pose, 2, c) * dz
                 for c in range(3))


def project(camera: tuple[Column, Column, Column], fx: Column, fy: Column, cx: Column,
            cy: Column) -> tuple[Column, Column]:
    depth = F.when(camera[2] > 0, camera[2])
    return fx * camera[0] / depth + cx, fy * camera[1] / depth + cy


def strided_centre(c: Column, stride: int) -> Column:
    """Principal point after keeping every ``stride``-th pixel (half-pixel rule)."""
    return (c + 0.5) / stride - 0.5


def clamped_centre(c: Column, size: Column) -> Column:
    """Image centre in place of a principal point that lies outside the image."""
    return F.when((c >= 0) & (c < size), c).otherwise(size / 2.0)


def wall_local(x: Column, y: Column, x0: Column, y0: Column, x1: Column,
               y1: Column) -> tuple[Column, Column, Column]:
    """Offset along a wall, unsigned distance from its line, and wall length."""
    dx, dy = x1 - x0, y1 - y0
    length = F.sqrt(dx * dx + dy * dy)
    safe = F.when(length > 0, length)
    ux, uy = dx / safe, dy / safe
    return (x - x0) * ux + (y - y0) * uy, F.abs((x - x0) * uy - (y - y0) * ux), length


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a bounded segment."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - x0) * dx + (py - y0) * dy) / F.when(square > 0, square)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)
