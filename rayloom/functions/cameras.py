"""Camera models as column expressions: projection matrices and rational polynomials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import from_ecef
from .rotation import apply, euler_to_matrix


def project_matrix(p: list[list[float]], x: list[Column]) -> tuple[Column, Column]:
    """Column and row of a point by a 3 x 4 matrix."""
    h = [r[0] * x[0] + r[1] * x[1] + r[2] * x[2] + r[3] for r in p]
    return h[0] / h[2], h[1] / h[2]


def project_affine(x: list[Column], euler: list[Column], t: list[Column], k: list[Column]) -> tuple[Column, Column]:
    """k: (fx, fy, skew); two translations."""
    r = apply(euler_to_matrix(*euler), x)
    u, v = r[0] + t[0], r[1] + t[1]
    return k[0] * u + k[2] * v, k[1] * v


def project_perspective(x: list[Column], euler: list[Column], t: list[Column], k: list[Column]) -> tuple[Column, Column]:
    """k: (fx, fy, skew, cx, cy); three translations."""
    u, v, w = (a + b for a, b in zip(apply(euler_to_matrix(*euler), x), t, strict=True))
    return k[0] * u / w + k[2] * v / w + k[3], k[1] * v / w + k[4]


#: Exponents of (x, y, z) in the order of the 20 coefficients (fixed by the file format).
BASIS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3))


def basis(x: Column, y: Column, z: Column) -> list[Column]:
    return [reduce(lambda a, b: a * b, [v for v, n in zip((x, y, z), e, strict=True) for _ in range(n)], F.lit(1.0)) for e in BASIS]


def project_rpc(rpc: dict, lon: Column, lat: Column, alt: Column) -> tuple[Column, Column]:
    """Column and row of a ground point by a rational polynomial model of literals."""
    terms = basis((lon - rpc["lon_off"]) / rpc["lon_scale"], (lat - rpc["lat_off"]) / rpc["lat_scale"], (alt - rpc["alt_off"]) / rpc["alt_scale"])
    poly = lambda c: reduce(lambda a, b: a + b, [float(k) * t for k, t in zip(c, terms, strict=True) if k])
    return tuple(poly(rpc[f"{a}_num"]) / poly(rpc[f"{a}_den"]) * rpc[f"{a}_scale"] + rpc[f"{a}_off"] for a in ("col", "row"))


def project_model(lon: Column, lat: Column, alt: Column) -> tuple[Column, Column]:
    """Column and row of a ground point by the rational polynomial model in the row's own columns. A term is its
    coefficient times the differences, each over its scale, from left to right; terms are added in their order."""
    place = [(v - F.col(f"{k}_off"), F.col(f"{k}_scale")) for k, v in (("lon", lon), ("lat", lat), ("alt", alt))]

    def poly(name: str) -> Column:
        term = lambda k, e: reduce(lambda a, d: a * d[0] / d[1], [d for d, n in zip(place, e, strict=True) for _ in range(n)], F.col(name)[k])
        return reduce(lambda a, b: a + b, [term(k, e) for k, e in enumerate(BASIS)])

    return tuple(poly(f"{a}_num") / poly(f"{a}_den") * F.col(f"{a}_scale") + F.col(f"{a}_off") for a in ("col", "row"))


def normalised(rpc: dict, axes: tuple[str, ...], v: list[Column]) -> list[Column]:
    """Coordinates less their offset, over their scale: (lon, lat, alt) of the world, (col, row) of an image."""
    return [(c - rpc[f"{a}_off"]) / rpc[f"{a}_scale"] for a, c in zip(axes, v, strict=True)]


def slope(coefficients: list[float], x: Column, y: Column, z: Column, axis: int) -> Column:
    """The polynomial's derivative by x (0), y (1) or z (2)."""
    out = F.lit(0.0)
    for c, powers in zip(coefficients, BASIS, strict=True):
        if powers[axis]:
            left = [n - (k == axis) for k, n in enumerate(powers)]
            out = out + reduce(lambda a, b: a * b, [v for v, n in zip((x, y, z), left, strict=True) for _ in range(n)], F.lit(float(c * powers[axis])))
    return out


def project(kind: str, model: dict | list, x: list[Column]) -> tuple[Column, Column]:
    """Column and row of an ECEF point by a model of the kind `rpc` (a dict), or by a matrix."""
    if kind == "rpc":
        lat, lon, alt = from_ecef(*x)
        return project_rpc(model, lon, lat, alt)
    if kind not in ("affine", "perspective"):
        raise ValueError(f"unknown camera model: {kind}")
    return project_matrix(model, x)
