"""Camera poses and plane maps as column expressions. A matrix is a list of rows of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotation import Matrix, apply


def transposed(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m, strict=True)]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((x * y for x, y in zip(r, c, strict=True)), F.lit(0.0)) for c in zip(*b, strict=True)] for r in a]


def matrix_to_quaternion(m: Matrix) -> list[Column]:
    """(w, x, y, z) with w >= 0. The largest of the four is found first, so no division is by a small number."""
    (a, b, c), (d, e, f), (g, h, i) = m
    four = [1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i]  # 4 w², 4 x², 4 y², 4 z²
    largest, size = F.greatest(*four), F.sqrt(F.greatest(*four))
    rows = [[four[0], h - f, c - g, d - b], [h - f, four[1], b + d, c + g], [c - g, b + d, four[2], f + h], [d - b, c + g, f + h, four[3]]]
    pick = lambda k: F.coalesce(*[F.when(four[j] == largest, rows[j][k]) for j in range(4)]) / (2 * size)
    q = [pick(k) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [sign * v for v in q]


def relative_pose(r1: Matrix, t1: list[Column], r2: Matrix, t2: list[Column]) -> tuple[Matrix, list[Column]]:
    """Rotation and translation that lead from camera 2's frame to camera 1's: [r1 | t1] = [r2 | t2] [r | t]."""
    back = transposed(r2)
    return product(back, r1), apply(back, [a - b for a, b in zip(t1, t2, strict=True)])


def rescaled_matrix(p: Matrix, alpha: float) -> Matrix:
    """The matrix of the image zoomed by alpha."""
    return [[v * alpha for v in p[0]], [v * alpha for v in p[1]], p[2]]


def perspective_matrix(euler_matrix: Matrix, t: list[Column], k: list[Column]) -> Matrix:
    """3 x 4 with last entry 1; k: (fx, fy, skew, cx, cy)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    p = product([[k[0], k[2], k[3]], [zero, k[1], k[4]], [zero, zero, one]], [[*r, v] for r, v in zip(euler_matrix, t, strict=True)])
    return [[v / p[2][3] for v in r] for r in p]


def affine_matrix(euler_matrix: Matrix, t: list[Column], k: list[Column]) -> Matrix:
    """3 x 4 with last row (0, 0, 0, 1); k: (fx, fy, skew), two translations."""
    zero, one = F.lit(0.0), F.lit(1.0)
    p = product([[k[0], k[2]], [zero, k[1]]], [[*r, v] for r, v in zip(euler_matrix[:2], t, strict=True)])
    return [*p, [zero, zero, zero, one]]


def homography(h: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """A point moved by a 3 x 3 map of the plane."""
    u, v, w = (r[0] * x + r[1] * y + r[2] for r in h)
    return u / w, v / w


def inverse(h: Matrix) -> Matrix:
    """The inverse of a 3 x 3 matrix, by cofactors."""
    minor = lambda i, j: (lambda r, c: h[r[0]][c[0]] * h[r[1]][c[1]] - h[r[0]][c[1]] * h[r[1]][c[0]])([k for k in range(3) if k != i], [k for k in range(3) if k != j])
    cof = [[(-1) ** (i + j) * minor(i, j) for j in range(3)] for i in range(3)]
    det = sum((h[0][j] * cof[0][j] for j in range(1, 3)), h[0][0] * cof[0][0])
    return [[cof[j][i] / det for j in range(3)] for i in range(3)]


def rectifying(f: list[Column]) -> tuple[Matrix, Matrix]:
    """Similarities that make the epipolar lines of a x' + b y' + c x + d y + e = 0 equal rows; f: (a, b, c, d, e)."""
    a, b, c, d, e = f
    r, s = F.sqrt(c * c + d * d), F.sqrt(a * a + b * b)
    z, t, zero = F.sqrt(r / s), e / (2 * F.sqrt(r * s)), F.lit(0.0)
    one = [[z * d / r, -z * c / r, zero], [z * c / r, z * d / r, t], [zero, zero, F.lit(1.0)]]
    two = [[-b / (s * z), a / (s * z), zero], [-a / (s * z), -b / (s * z), -t], [zero, zero, F.lit(1.0)]]
    return one, two
