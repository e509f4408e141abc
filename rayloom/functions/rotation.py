"""Rotations as column expressions. A matrix is a list of three rows of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def euler_to_matrix(roll: Column, pitch: Column, yaw: Column) -> Matrix:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def matrix_to_euler(m: Matrix) -> tuple[Column, Column, Column]:
    s = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    flat = s < 1e-6
    roll = F.when(flat, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2]))
    return roll, F.atan2(-m[2][0], s), F.when(flat, F.lit(0.0)).otherwise(F.atan2(m[1][0], m[0][0]))


def euler_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column, Column, Column]:
    cr, sr, cp, sp, cy, sy = (f(x / 2) for x in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(t), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matrix_to_axis_angle(m: Matrix) -> tuple[Column, Column, Column, Column]:
    """Unit axis and angle; no axis (nulls) where the matrix does not turn."""
    x, y, z = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    r = F.sqrt(x * x + y * y + z * z)
    angle = F.atan2(r, m[0][0] + m[1][1] + m[2][2] - 1)
    return (*(F.try_divide(c, r) for c in (x, y, z)), angle)


def axis_angle_to_matrix(x: Column, y: Column, z: Column, angle: Column) -> Matrix:
    c, s = F.cos(angle), F.sin(angle)
    v = 1 - c
    return [[x * x * v + c, x * y * v - z * s, x * z * v + y * s], [x * y * v + z * s, y * y * v + c, y * z * v - x * s], [x * z * v - y * s, y * z * v + x * s, z * z * v + c]]


def apply(m: Matrix, p: list[Column]) -> list[Column]:
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] for r in m]


def rodrigues(p: list[Column], v: list[Column]) -> list[Column]:
    """Points turned about the vector v by its length; unchanged where that is 0."""
    t = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = [F.coalesce(F.try_divide(c, t), F.lit(0.0)) for c in v]
    dot = k[0] * p[0] + k[1] * p[1] + k[2] * p[2]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    return [F.cos(t) * a + F.sin(t) * b + (1 - F.cos(t)) * dot * c for a, b, c in zip(p, cross, k, strict=True)]


def corrected(p: list[Column], euler: list[Column], t: list[Column], c: list[Column]) -> list[Column]:
    """R (p - t - c) + c."""
    moved = [a - b - d for a, b, d in zip(p, t, c, strict=True)]
    return [a + b for a, b in zip(apply(euler_to_matrix(*euler), moved), c, strict=True)]
