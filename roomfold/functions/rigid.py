"""Rigid transforms as column expressions.

A 4x4 pose is a row-major ``array<double>`` of 16 values and a planar transform
is a row-major array of 9. All functions take and return columns, so the work
stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPENGL_TO_OPENCV = (1.0, -1.0, -1.0, 1.0)


def cell(m: Column, row: int, col: int, width: int = 4) -> Column:
    return m[row * width + col]


def matrix(rows: list[list[Column]]) -> Column:
    return F.array(*[value for row in rows for value in row])


def identity(size: int = 4) -> Column:
    return F.array(*[F.lit(1.0 if r == c else 0.0) for r in range(size) for c in range(size)])


def compose(a: Column, b: Column, size: int = 4) -> Column:
    """Matrix product of two homogeneous rigid transforms."""
    last = size - 1
    rows = []
    for r in range(last):
        row = []
        for c in range(size):
            total = sum((cell(a, r, k, size) * cell(b, k, c, size) for k in range(1, last)),
                        cell(a, r, 0, size) * cell(b, 0, c, size))
            row.append(total + cell(a, r, last, size) if c == last else total)
        rows.append(row)
    rows.append([F.lit(1.0 if c == last else 0.0) for c in range(size)])
    return matrix(rows)


def invert(m: Column, size: int = 4) -> Column:
    """Inverse of a rigid transform: transposed rotation, rotated negative translation."""
    last = size - 1
    rows = []
    for r in range(last):
        shift = sum((cell(m, k, r, size) * cell(m, k, last, size) for k in range(1, last)),
                    cell(m, 0, r, size) * cell(m, 0, last, size))
        rows.append([cell(m, c, r, size) for c in range(last)] + [-shift])
    rows.append([F.lit(1.0 if c == last else 0.0) for c in range(size)])
    return matrix(rows)


def apply_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(cell(m, r, 0) * x + cell(m, r, 1) * y + cell(m, r, 2) * z + cell(m, r, 3)
                 for r in range(3))


def translation_norm(m: Column) -> Column:
    return F.sqrt(cell(m, 0, 3) * cell(m, 0, 3) + cell(m, 1, 3) * cell(m, 1, 3)
                  + cell(m, 2, 3) * cell(m, 2, 3))


def degrees_from_trace(trace: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))))


def rotation_degrees(m: Column) -> Column:
    return degrees_from_trace(cell(m, 0, 0) + cell(m, 1, 1) + cell(m, 2, 2))


def relative_rotation_degrees(a: Column, b: Column) -> Column:
    """Angle of transpose(R_a) R_b without forming the product."""
    trace = sum((cell(a, r, c) * cell(b, r, c) for r in range(3) for c in range(3)
                 if (r, c) != (0, 0)), cell(a, 0, 0) * cell(b, 0, 0))
    return degrees_from_trace(trace)


def quaternion_rows(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - z * w), 2.0 * (x * z + y * w)],
        [2.0 * (x * y + z * w), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - x * w)],
        [2.0 * (x * z - y * w), 2.0 * (y * z + x * w), 1.0 - 2.0 * (x * x + y * y)],
    ]


def quaternion_norm(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z + w * w)


def quaternion_pose(q: tuple[Column, Column, Column, Column], t: tuple[Column, Column, Column],
                    variant: str = "plain") -> Column:
    """Pose from quaternion (x, y, z, w) and translation.

    ``plain`` normalises; ``flip`` also converts an OpenGL camera basis and gives
    null outside norm [0.5, 1.5]; ``lenient`` maps a near-zero quaternion to identity.
    """
    norm = quaternion_norm(*q)
    safe = F.when(norm > 1e-12, norm)
    unit = [value / safe for value in q]
    rows = quaternion_rows(*unit)
    if variant == "flip":
        rows = [[row[c] * OPENGL_TO_OPENCV[c] for c in range(3)] for row in rows]
    pose = matrix([row + [shift] for row, shift in zip(rows, t)]
                  + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]])
    if variant == "flip":
        finite = norm.between(0.5, 1.5)
        return F.when(finite, pose)
    if variant == "lenient":
        flat = matrix([[F.lit(1.0 if r == c else 0.0) for c in range(3)] + [t[r]] for r in range(3)]
                      + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]])
        return F.when(norm > 1e-8, pose).otherwise(flat)
    return pose


def normalize_pose(m: Column, convention: Column, source_to_canonical: Column) -> Column:
    """Camera-to-world pose in the canonical frame whatever the stored convention."""
    forward = F.when(convention == "world_to_camera", invert(m)).otherwise(m)
    return compose(source_to_canonical, forward)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_rigid(m: Column, tolerance: float = 1e-3) -> Column:
    """Whether a stored pose is a finite 4x4 rotation plus translation."""
    checks = (F.size(m) == 16) & F.forall(m, is_finite)
    ok = F.abs(cell(m, 3, 3) - 1.0) <= tolerance
    for c in range(3):
        ok = ok & (F.abs(cell(m, 3, c)) <= tolerance)
    for i in range(3):
        for j in range(i, 3):
            dot = sum((cell(m, k, i) * cell(m, k, j) for k in (1, 2)), cell(m, 0, i) * cell(m, 0, j))
            ok = ok & (F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance)
    det = (cell(m, 0, 0) * (cell(m, 1, 1) * cell(m, 2, 2) - cell(m, 1, 2) * cell(m, 2, 1))
           - cell(m, 0, 1) * (cell(m, 1, 0) * cell(m, 2, 2) - cell(m, 1, 2) * cell(m, 2, 0))
           + cell(m, 0, 2) * (cell(m, 1, 0) * cell(m, 2, 1) - cell(m, 1, 1) * cell(m, 2, 0)))
    ok = ok & (F.abs(det - 1.0) <= tolerance)
    return F.coalesce(F.when(checks, ok).otherwise(F.lit(False)), F.lit(False))


def scale_translation(m: Column, scale: Column) -> Column:
    """Metric scale changes where a camera is, never where it points."""
    return F.transform(m, lambda v, i: F.when(i.isin(3, 7, 11), v * scale).otherwise(v))


def wrap_angle(value: Column) -> Column:
    import math
    turn = 2 * math.pi
    shifted = value + math.pi
    return shifted - turn * F.floor(shifted / turn) - math.pi


def se2(x: Column, y: Column, yaw: Column) -> Column:
    c, s = F.cos(yaw), F.sin(yaw)
    return matrix([[c, -s, x], [s, c, y], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]])


def se2_components(m: Column) -> tuple[Column, Column, Column]:
    return m[2], m[5], wrap_angle(F.atan2(m[3], m[0]))


def is_se2(m: Column) -> Column:
    finite = (F.size(m) == 9) & F.forall(m, is_finite)
    ok = ((F.abs(m[6]) <= 1e-6) & (F.abs(m[7]) <= 1e-6) & (F.abs(m[8] - 1.0) <= 1e-6)
          & (F.abs(m[0] * m[0] + m[3] * m[3] - 1.0) <= 1e-4)
          & (F.abs(m[1] * m[1] + m[4] * m[4] - 1.0) <= 1e-4)
          & (F.abs(m[0] * m[1] + m[3] * m[4]) <= 1e-4)
          & (F.abs(m[0] * m[4] - m[1] * m[3] - 1.0) <= 1e-4))
    return F.coalesce(F.when(finite, ok).otherwise(F.lit(False)), F.lit(False))


def move_xy(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def up_axis(axis: str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Right-handed rotation that sends the signed source axis to +Z."""
    sign = -1.0 if axis.startswith("-") else 1.0
    name = axis[-1]
    if name == "x":
        return y, sign * z, sign * x
    if name == "y":
        return x, -sign * z, sign * y
    return x, sign * y, sign * z
