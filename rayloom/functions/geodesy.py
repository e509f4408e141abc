"""Geodetic, geocentric and UTM coordinates on WGS 84 as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of WGS 84 and of UTM.
A, INVERSE_FLATTENING, K0, EAST0, NORTH0 = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
FLAT = 1 / INVERSE_FLATTENING
B, E2 = A * (1 - FLAT), FLAT * (2 - FLAT)


def to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, altitude by Bowring's closed form."""
    r = F.sqrt(x * x + y * y)
    t = F.atan2(A * z, B * r)
    ep2 = (A * A - B * B) / (B * B)
    lat = F.atan2(z + ep2 * B * F.pow(F.sin(t), 3), r - E2 * A * F.pow(F.cos(t), 3))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), r / F.cos(lat) - n


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and Krueger's coefficients to the fourth power of the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, back


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone, with the southern offset below the equator."""
    radius, forward, _ = _series()
    e = math.sqrt(E2)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    east, north = eta, xi
    for j, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + K0 * radius * east, K0 * radius * north + F.when(lat < 0, NORTH0).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    radius, _, back = _series()
    x, y = (east - EAST0) / (K0 * radius), (north - F.when(south, NORTH0).otherwise(0.0)) / (K0 * radius)
    xi, eta = y, x
    for j, b in enumerate(back, 1):
        xi = xi - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    n = FLAT / (2 - FLAT)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, c in enumerate((2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630), 1):
        lat = lat + c * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def raster_shape(x0: Column, x1: Column, y0: Column, y1: Column, res: float) -> tuple[Column, Column]:
    """Rows and columns of a box at a resolution."""
    return tuple((F.floor((b - a) / res) + 1).cast("int") for a, b in ((y0, y1), (x0, x1)))


def zone_string(lon: Column, lat: Column) -> Column:
    """Number and hemisphere of the zone, as in 31N."""
    return F.concat(utm_zone(lon).cast("string"), F.when(lat >= 0, "N").otherwise("S"))


def utm_pixel(east: Column, north: Column, x0: Column, y0: Column, y1: Column, res: float) -> tuple[Column, Column]:
    """Column and row of a UTM point in the raster of a box; a northing below 0 is a southern one."""
    north = F.when(north < 0, north + NORTH0).otherwise(north)
    height = F.floor((y1 - y0) / res) + 1
    return F.floor((east - x0) / res), height - F.floor((north - y0) / res)


def transform(p: list[Column], source: int, target: int) -> list[Column]:
    """(lon, lat, alt), (x, y, z) or (east, north, alt) from one EPSG code to another: 4326 and 4979
    (geodetic), 4978 (geocentric), 326zz and 327zz (UTM)."""

    def geodetic() -> list[Column]:
        if source in (4326, 4979):
            return list(p)
        if source == 4978:
            lat, lon, alt = from_ecef(*p)
            return [lon, lat, alt]
        _utm(source)
        lon, lat = from_utm(p[0], p[1], F.lit(source % 100), F.lit(source // 100 == 327))
        return [lon, lat, p[2]]

    lon, lat, alt = geodetic()
    if target in (4326, 4979):
        return [lon, lat, alt]
    if target == 4978:
        return list(to_ecef(lat, lon, alt))
    _utm(target)
    east, north = to_utm(lon, lat, F.lit(target % 100))
    shift = F.when(lat < 0, 0.0).otherwise(NORTH0) if target // 100 == 327 else F.when(lat < 0, -NORTH0).otherwise(0.0)
    return [east, north + shift, alt]


def _utm(epsg: int) -> None:
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} is none of 4326, 4979, 4978, 32601-32660, 32701-32760")
