"""Queries on camera models, footprints and coordinates, each with its SQL for DuckDB.

Sensor models that are linear in the ground coordinates are made from the suppliers, so that their
localisation has a closed form in SQL; rings are the customers of one UTM zone in order of their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cameras, geodesy, names, poses, rotation
from ..operators import footprints, geometry, matching, pairs, plane, summaries, tracks
from ..session import kept, table
from .catalog import FUND, LL, N_SQL, OBS, RPC, _lonlat, _poly, _r, _terms, cams, kps, obs, query

# SQL of UTM, with the series' numbers
_radius, _forward, _ = geodesy._series()
_e = geodesy.E2**0.5
UTM = f"""u0 AS (SELECT *, floor((zlon + 180) / 6) + 1 zone FROM g),
u1 AS (SELECT *, radians(lon - (zone * 6 - 183)) dl, sin(radians(lat)) s FROM u0), u2 AS (SELECT *, sinh(atanh(s) - {_e!r} * atanh({_e!r} * s)) t FROM u1),
u3 AS (SELECT *, atan2(t, cos(dl)) xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) eta FROM u2),
u AS (SELECT *, 500000 + 0.9996e0 * {_radius!r} * (eta + {" + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_forward, 1))}) east,
  0.9996e0 * {_radius!r} * (xi + {" + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_forward, 1))}) north FROM u3)"""
GZ = LL.replace("g AS (SELECT", "g AS (SELECT *, lon zlon FROM (SELECT", 1) + ")"
RING = "r0 AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) * 2 + CASE WHEN lat < 0 THEN 1 ELSE 0 END ring FROM g0), g AS (SELECT *, first_value(lon) OVER (PARTITION BY ring ORDER BY c_custkey) zlon FROM r0)"
RINGS = LL.replace("g AS", "g0 AS", 1) + ", " + RING + ", " + UTM


def _rings(spark, d) -> DataFrame:
    g = _lonlat(spark, d)
    return g.select((geodesy.utm_zone(F.col("lon")) * 2 + F.when(F.col("lat") < 0, 1).otherwise(0)).alias("ring"), F.col("c_custkey").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"))


@query(f"WITH {GZ}, {UTM} SELECT c_custkey, round(east, 3) + 0.0 east, round(north + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 3) + 0.0 north FROM u")
def utm_forward(spark, d):
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), geodesy.utm_zone(F.col("lon")))
    return _lonlat(spark, d).select("c_custkey", _r(e, 3).alias("east"), _r(n, 3).alias("north"))


@query(f"WITH {LL} SELECT c_custkey, concat(CAST(floor((lon + 180) / 6) + 1 AS INTEGER), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) \"zone\" FROM g")
def utm_zone_string(spark, d):
    return _lonlat(spark, d).select("c_custkey", geodesy.zone_string(F.col("lon"), F.col("lat")).alias("zone"))


@query(f"WITH {RINGS} SELECT ring, c_custkey i, round(east, 3) + 0.0 x, round(north, 3) + 0.0 y FROM u")
def utm_rings(spark, d):
    return footprints.utm_rings(_rings(spark, d), "ring").select("ring", "i", _r(F.col("x"), 3).alias("x"), _r(F.col("y"), 3).alias("y"))


@query(f"WITH {RINGS} SELECT ring, c_custkey i, round(lon, 6) + 0.0 x, round(lat, 6) + 0.0 y FROM u")
def degree_rings(spark, d):
    return footprints.degree_rings(footprints.utm_rings(_rings(spark, d), "ring"), "ring").select("ring", "i", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


BOXES = "b AS (SELECT ring, min(east) x0, max(east) x1, min(north + CASE WHEN north < 0 THEN 1e7 ELSE 0 END) y0, max(north + CASE WHEN north < 0 THEN 1e7 ELSE 0 END) y1 FROM u GROUP BY 1)"


@query(f"WITH {RINGS}, {BOXES} SELECT ring, round(x0, 3) x0, round(x1, 3) x1, round(y0, 3) y0, round(y1, 3) y1 FROM b")
def utm_boxes(spark, d):
    b = footprints.utm_boxes(_rings(spark, d), "ring")
    return b.select("ring", *[F.round(c, 3).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(f"WITH {RINGS}, {BOXES} SELECT c_custkey, CAST(floor((round(east, 3) - round(x0, 3)) / 1000.7) AS BIGINT) col, CAST(floor((round(y1, 3) - round(y0, 3)) / 1000.7) + 1 - floor((round(north + CASE WHEN north < 0 THEN 1e7 ELSE 0 END, 3) - round(y0, 3)) / 1000.7) AS BIGINT) \"row\" FROM u JOIN b USING (ring)")
def utm_pixels(spark, d):
    r = _rings(spark, d)
    u = footprints.utm_rings(r, "ring").join(utm_boxes(spark, d), "ring")
    north = F.round(F.when(F.col("y") < 0, F.col("y") + geodesy.NORTH0).otherwise(F.col("y")), 3)
    col, row = geodesy.utm_pixel(F.round("x", 3), north, F.col("x0"), F.col("y0"), F.col("y1"), 1000.7)
    return u.select(F.col("i").alias("c_custkey"), col.alias("col"), row.alias("row"))


@query(f"WITH {RINGS}, n AS (SELECT ring, east x, north y, coalesce(lead(east) OVER w, first_value(east) OVER w) nx, coalesce(lead(north) OVER w, first_value(north) OVER w) ny FROM u WINDOW w AS (PARTITION BY ring ORDER BY c_custkey)) SELECT ring, round(abs(sum(x * ny - nx * y)) / 2e6, 1) km2 FROM n GROUP BY 1")
def ring_areas(spark, d):
    return footprints.square_kilometres(_rings(spark, d), "ring").withColumn("km2", F.round("km2", 1))


@query(f"WITH {LL} SELECT c_custkey, round(({N_SQL} + alt) * cos(radians(lat)) * cos(radians(lon)), 4) + 0.0 x, round(({N_SQL} + alt) * cos(radians(lat)) * sin(radians(lon)), 4) + 0.0 y, round(({N_SQL} * (1 - 0.0066943799901413165) + alt) * sin(radians(lat)), 4) + 0.0 z, round(lon, 6) + 0.0 lon, round(lat, 6) + 0.0 lat FROM g")
def crs_transform(spark, d):
    g = _lonlat(spark, d)
    x = geodesy.transform([F.col("lon"), F.col("lat"), F.col("alt")], 4326, 4978)
    e = g.select("c_custkey", *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])
    b = geodesy.transform([F.col(k) for k in "xyz"], 4978, 4979)
    return e.select("c_custkey", *[_r(F.col(k), 4).alias(k) for k in "xyz"], _r(b[0]).alias("lon"), _r(b[1]).alias("lat"))


# rings of one label's points, which cross themselves
_PTS = "p AS (SELECT label, vec_id i, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM embeddings), e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) u, coalesce(lead(y) OVER w, first_value(y) OVER w) v FROM p WINDOW w AS (PARTITION BY label ORDER BY i))"
_side = lambda a, b, c, d, p, q: f"(({c} - {a}) * ({q} - {b}) - ({d} - {b}) * ({p} - {a}))"


@query(f"""WITH {_PTS}, c AS (SELECT label, sum((x + u) * (x * v - u * y)) / (3 * sum(x * v - u * y)) cx, sum((y + v) * (x * v - u * y)) / (3 * sum(x * v - u * y)) cy FROM e GROUP BY 1),
b AS (SELECT DISTINCT a.label FROM e a JOIN e b ON a.label = b.label AND a.i < b.i WHERE {_side("a.x", "a.y", "a.u", "a.v", "b.x", "b.y")} * {_side("a.x", "a.y", "a.u", "a.v", "b.u", "b.v")} < 0 AND {_side("b.x", "b.y", "b.u", "b.v", "a.x", "a.y")} * {_side("b.x", "b.y", "b.u", "b.v", "a.u", "a.v")} < 0)
SELECT p.label, row_number() OVER (PARTITION BY p.label ORDER BY CASE WHEN b.label IS NULL THEN i ELSE atan2(x - cx, y - cy) END, i) - 1 i, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y FROM p JOIN c ON p.label = c.label LEFT JOIN b ON p.label = b.label""")
def repaired_rings(spark, d):
    p = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("i"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")])
    return footprints.repaired(p, "label").select("label", F.col("i").cast("long").alias("i"), _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


# squares of the suppliers, by nation
_SQ = "q AS (SELECT s_nationkey g, s_suppkey m, (s_suppkey * 37 % 41) * 1e0 x0, (s_suppkey * 53 % 43) * 1e0 y0, (s_suppkey * 37 % 41) + 6e0 + s_suppkey % 7 x1, (s_suppkey * 53 % 43) + 5e0 + s_suppkey % 5 y1 FROM supplier)"
_CELLS = f"""{_SQ}, xs AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) nx FROM (SELECT g, x0 x FROM q UNION SELECT g, x1 FROM q)), ys AS (SELECT g, y, lead(y) OVER (PARTITION BY g ORDER BY y) ny FROM (SELECT g, y0 y FROM q UNION SELECT g, y1 FROM q)),
c AS (SELECT xs.g, x, y, (nx - x) * (ny - y) a, count(*) n FROM xs JOIN ys ON xs.g = ys.g JOIN q ON q.g = xs.g AND x0 <= x AND nx <= x1 AND y0 <= y AND ny <= y1 GROUP BY 1, 2, 3, nx, ny)"""


def _squares(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), k.alias("m"), (k * 37 % 41).cast("double").alias("x0"), (k * 53 % 43).cast("double").alias("y0"), (k * 37 % 41 + 6.0 + k % 7).alias("x1"), (k * 53 % 43 + 5.0 + k % 5).alias("y1"))
    corner = lambda i, x, y: F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    return s.select("g", "m", F.explode(F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1"))).alias("p")).select("g", "m", "p.*")


@query(f"WITH {_CELLS} SELECT g, round(sum(a), 6) area FROM c GROUP BY 1")
def union_areas(spark, d):
    return footprints.union_areas(_squares(spark, d), "g", "m").withColumn("area", F.round("area", 6))


@query(f"WITH {_CELLS} SELECT g, round(sum(a), 6) area FROM c WHERE n > 1 GROUP BY 1")
def seen_twice_areas(spark, d):
    b = footprints.seen_twice(_squares(spark, d), "g", "m")
    return b.groupBy("g").agg(F.round(F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2, 6).alias("area"))


# linear sensor models of the suppliers
LIN = """m AS (SELECT CAST(s_suppkey AS BIGINT) cam_id, (s_suppkey % 100) / 10.0 lon_off, 40 + s_nationkey / 5.0 lat_off, CAST(s_suppkey % 11 AS DOUBLE) col0, CAST(s_suppkey % 13 AS DOUBLE) row0, 3000.0 + s_suppkey % 17 width, 2000.0 + s_suppkey % 19 height, CAST(s_suppkey % 300 AS DOUBLE) alt FROM supplier)"""
_inv = lambda col, row, alt: (
    f"(lon_off + 0.1 * (-((({col}) - 2000) / 2000 - 0.05 * (({alt}) - 100) / 500) - 0.1 * ((({row}) - 2000) / 2000 - 0.03 * (({alt}) - 100) / 500)) / -1.02)",
    f"(lat_off + 0.1 * (((({row}) - 2000) / 2000 - 0.03 * (({alt}) - 100) / 500) - 0.2 * ((({col}) - 2000) / 2000 - 0.05 * (({alt}) - 100) / 500)) / -1.02)",
)
_fwd = lambda lon, lat, alt: (
    f"(2000 + 2000 * ((({lon}) - lon_off) / 0.1 + 0.1 * (({lat}) - lat_off) / 0.1 + 0.05 * (({alt}) - 100) / 500))",
    f"(2000 + 2000 * (0.2 * (({lon}) - lon_off) / 0.1 - (({lat}) - lat_off) / 0.1 + 0.03 * (({alt}) - 100) / 500))",
)


def _linear(spark, d) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    vector = lambda *v: F.array(*[F.lit(float(x)) for x in [*v, *[0.0] * (20 - len(v))]])
    lit = {"alt_off": 100.0, "lon_scale": 0.1, "lat_scale": 0.1, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0}
    return table(spark, d, "supplier").select(
        k.cast("long").alias("cam_id"), (k % 100 / 10.0).alias("lon_off"), (40 + n / 5.0).alias("lat_off"), *[F.lit(v).alias(c) for c, v in lit.items()],
        vector(0, 1, 0.1, 0.05).alias("col_num"), vector(1).alias("col_den"), vector(0, 0.2, -1, 0.03).alias("row_num"), vector(1).alias("row_den"),
    )


def _crops(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("long").alias("cam_id"), (k % 11).cast("double").alias("col0"), (k % 13).cast("double").alias("row0"), (3000.0 + k % 17).alias("width"), (2000.0 + k % 19).alias("height"), (k % 300).cast("double").alias("alt"))


_CORNER = "c(i, a, b) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0))"
_lon, _lat = _inv("col0 + width * a", "row0 + height * b", "alt")


@query(f"WITH {LIN}, {_CORNER} SELECT cam_id, i, round({_lon}, 9) x, round({_lat}, 9) y FROM m, c")
def image_footprints(spark, d):
    f = footprints.footprints(_crops(spark, d), _linear(spark, d))
    return f.select("cam_id", "i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_lon2, _lat2 = _inv("col0 + width * a", "row0 + height * b", "h")


@query(f"WITH {LIN}, {_CORNER}, h(h) AS (VALUES (-400), (600)) SELECT cam_id, round(min({_lon2}), 9) lon0, round(max({_lon2}), 9) lon1, round(min({_lat2}), 9) lat0, round(max({_lat2}), 9) lat1 FROM m, c, h GROUP BY 1")
def geodesic_boxes(spark, d):
    b = footprints.geodesic_boxes(_crops(spark, d), _linear(spark, d))
    return b.select("cam_id", *[F.round(c, 9).alias(c) for c in ("lon0", "lon1", "lat0", "lat1")])


@query("SELECT CAST(s_suppkey AS BIGINT) cam_id, CAST(-400 AS DOUBLE) low, CAST(600 AS DOUBLE) high FROM supplier")
def height_ranges(spark, d):
    return footprints.height_range(_linear(spark, d))


_lon3, _lat3 = _inv("col0 + width / 2", "row0 + height / 2", "100")


@query(f"WITH {LIN} SELECT cam_id, concat(CAST(floor(({_lon3} + 180) / 6) + 1 AS INTEGER), 'N') \"zone\" FROM m")
def crop_zones(spark, d):
    return footprints.crop_zones(_crops(spark, d), _linear(spark, d))


_lon4, _lat4 = _inv("col0 + width * (2 * a + 1) / 6.0", "row0 + height * (2 * b + 1) / 6.0", "-400 + 500 * k")


@query(f"WITH {LIN} SELECT cam_id, (a * 3 + b) * 3 + k id, round({_lon4}, 9) lon, round({_lat4}, 9) lat FROM m, range(3) r(a), range(3) s(b), range(3) t(k)")
def ground_control(spark, d):
    g = footprints.ground_control(_crops(spark, d), _linear(spark, d), 3)
    return g.select("cam_id", "id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


_A, _B = _inv("2000", "2000", "0"), _inv("2001", "2000", "0")
_xyz = lambda lon, lat: (lambda n: (f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))", f"{n} * (1 - 0.0066943799901413165) * sin(radians({lat}))"))(N_SQL.replace("(lat)", f"({lat})"))


@query(f"WITH {LIN}, q AS (SELECT cam_id, {_A[0]} lon1, {_A[1]} lat1, {_B[0]} lon2, {_B[1]} lat2 FROM m) SELECT cam_id, round(sqrt({' + '.join(f'power(({b}) - ({a}), 2)' for a, b in zip(_xyz('lon1', 'lat1'), _xyz('lon2', 'lat2'), strict=True))}), 5) gsd FROM q")
def ground_sampling(spark, d):
    return footprints.ground_sampling(_linear(spark, d)).withColumn("gsd", F.round("gsd", 5))


_lon5, _lat5 = _inv("1000.0 + l_quantity * 20 + col0", "500.0 + l_linenumber * 100 + row0", "alt")


@query(f"WITH {LIN}, g AS (SELECT cam_id, l_orderkey * 10 + l_linenumber kp_id, {_lon5} lon, {_lon5} zlon, {_lat5} lat FROM m JOIN lineitem ON l_suppkey = cam_id), {UTM} SELECT cam_id, kp_id, round(east, 2) east, round(north, 2) north FROM u")
def keypoints_to_utm(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("cam_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp_id"), (1000.0 + F.col("l_quantity") * 20).cast("double").alias("col"), (500.0 + F.col("l_linenumber") * 100).cast("double").alias("row"))
    u = footprints.keypoints_to_utm(k, _crops(spark, d), _linear(spark, d))
    return u.select("cam_id", "kp_id", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"))


_col, _row = _fwd("x", "y", "250")
_trunc = lambda c: f"CAST(trunc({c}) AS BIGINT)"


@query(f"WITH {LIN}, a(i, x, y) AS (VALUES (0, 4.9, 42.1), (1, 5.3, 42.07), (2, 5.21, 42.43)), b AS (SELECT cam_id, min({_col}) c0, max({_col}) c1, min({_row}) r0, max({_row}) r1 FROM m, a GROUP BY 1) SELECT cam_id, {_trunc('c0')} col0, {_trunc('r0')} row0, {_trunc('c1 - c0')} width, {_trunc('r1 - r0')} height FROM b")
def area_crops(spark, d):
    ring = spark.createDataFrame([(0, 4.9, 42.1), (1, 5.3, 42.07), (2, 5.21, 42.43)], "i int, x double, y double")
    return footprints.crops_of(ring, _linear(spark, d), 250.0)


_lon6, _lat6 = _inv("l_quantity * 70", "l_linenumber * 300", "l_tax * 1000")
_col6, _row6 = _fwd("p.lon", "p.lat", "p.h")


@query(f"WITH {LIN}, p AS (SELECT l_orderkey * 10 + l_linenumber id, l_tax * 1000 h, {_lon6} lon, {_lat6} lat, l_suppkey FROM lineitem JOIN m ON cam_id = l_suppkey), n AS (SELECT s_suppkey a, s_suppkey % (SELECT max(s_suppkey) FROM supplier) + 1 b FROM supplier) SELECT id, round({_col6}, 5) col, round({_row6}, 5) \"row\" FROM p JOIN n ON a = l_suppkey JOIN m ON cam_id = b")
def point_transfer(spark, d):
    li = table(spark, d, "lineitem")
    last = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("last"))
    p = li.crossJoin(F.broadcast(last)).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").cast("long").alias("cam_i"), (F.col("l_suppkey") % F.col("last") + 1).cast("long").alias("cam_j"), (F.col("l_quantity") * 70).cast("double").alias("col"), (F.col("l_linenumber") * 300).cast("double").alias("row"), (F.col("l_tax") * 1000).cast("double").alias("alt"))
    t = geometry.transfer(p, _linear(spark, d))
    return t.select("id", F.round("col", 5).alias("col"), F.round("row", 5).alias("row"))


@query(f"WITH {LIN} SELECT cam_id, round({_fwd('lon_off + 0.01', 'lat_off + 0.02', '150')[0]} / 2, 6) col, round({_fwd('lon_off + 0.01', 'lat_off + 0.02', '150')[1]} / 2, 6) \"row\" FROM m")
def rescaled_models(spark, d):
    m = geometry.rescaled(_linear(spark, d), 0.5)
    p = m.select("cam_id", F.lit(0).cast("long").alias("id"), (F.col("lon_off") + 0.01).alias("lon"), (F.col("lat_off") + 0.02).alias("lat"), F.lit(150.0).alias("alt"))
    return geometry.project(p, m).select("cam_id", F.round("col", 6).alias("col"), F.round("row", 6).alias("row"))


# derivatives of the polynomials, written out
_DX = ["0", "1", "0", "0", "y", "z", "0", "2*x", "0", "0", "y*z", "3*x*x", "y*y", "z*z", "2*x*y", "0", "0", "2*x*z", "0", "0"]
_DY = ["0", "0", "1", "0", "x", "0", "z", "0", "2*y", "0", "x*z", "0", "2*x*y", "0", "x*x", "3*y*y", "z*z", "0", "2*y*z", "0"]
_DZ = ["0", "0", "0", "1", "0", "x", "y", "0", "0", "2*z", "x*y", "0", "0", "2*x*z", "0", "0", "2*y*z", "x*x", "y*y", "3*z*z"]
_dpoly = lambda c, t: " + ".join(f"{k!r} * ({x})" for k, x in zip(c, t, strict=True))
_NORM = f"{LL}, n AS (SELECT c_custkey, lon / 180.0 x, lat / 90.0 y, alt / 10000.0 z FROM g)"


def _normalised(spark, d) -> DataFrame:
    x = cameras.normalised(RPC, ("lon", "lat", "alt"), [F.col("lon"), F.col("lat"), F.col("alt")])
    return _lonlat(spark, d).select("c_custkey", *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])


@query(f"WITH {_NORM} SELECT c_custkey, " + ", ".join(f"round({_dpoly(RPC['col_num'], t)}, 9) + 0.0 {n}" for n, t in (("dx", _DX), ("dy", _DY), ("dz", _DZ))) + " FROM n")
def polynomial_slopes(spark, d):
    v = [F.col(k) for k in "xyz"]
    return _normalised(spark, d).select("c_custkey", *[_r(cameras.slope(RPC["col_num"], *v, axis=k), 9).alias(f"d{n}") for k, n in enumerate("xyz")])


@query(f"WITH {_NORM} SELECT c_custkey, " + ", ".join(f"round(({t}) * 0.7853981633974483e0, 9) + 0.0 t{k}" for k, t in enumerate(_terms)) + " FROM n")
def polynomial_terms(spark, d):
    """Scaled, so that no decimal fraction stands on the edge of rounding."""
    return _normalised(spark, d).select("c_custkey", *[_r(c * 0.7853981633974483, 9).alias(f"t{k}") for k, c in enumerate(cameras.basis(*[F.col(k) for k in "xyz"]))])


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) - 500) / 510, 9) col, round((CAST(embedding[2] AS DOUBLE) - 400) / 410, 9) \"row\" FROM embeddings")
def normalised_pixels(spark, d):
    e = table(spark, d, "embeddings")
    c = cameras.normalised(RPC, ("col", "row"), [F.col("embedding")[k].cast("double") for k in (0, 1)])
    return e.select("vec_id", *[F.round(v, 9).alias(k) for v, k in zip(c, ("col", "row"), strict=True)])


# poses from the numbers of a vector: angles 1-3 and 4-6, translations 7-9 and 10-12
_E12 = "e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) e{k}" for k in range(14)) + " FROM embeddings)"


def _rot(k: int) -> list[list[str]]:
    """Rotation of the angles e[k], e[k + 1], e[k + 2] as SQL, term by term of the product of the three turns."""
    c, s = [f"cos(e{k + i})" for i in range(3)], [f"sin(e{k + i})" for i in range(3)]
    return [
        [f"({c[2]} * {c[1]})", f"({c[2]} * {s[1]} * {s[0]} - {s[2]} * {c[0]})", f"({c[2]} * {s[1]} * {c[0]} + {s[2]} * {s[0]})"],
        [f"({s[2]} * {c[1]})", f"({s[2]} * {s[1]} * {s[0]} + {c[2]} * {c[0]})", f"({s[2]} * {s[1]} * {c[0]} - {c[2]} * {s[0]})"],
        [f"(-{s[1]})", f"({c[1]} * {s[0]})", f"({c[1]} * {c[0]})"],
    ]


_dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
_col3 = lambda m, j: [r[j] for r in m]
_R1, _R2, _T1, _T2 = _rot(0), _rot(3), ["e6", "e7", "e8"], ["e9", "e10", "e11"]


def _poses(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(14)])
    c = lambda *k: [F.col(f"e{i}") for i in k]
    return e, rotation.euler_to_matrix(*c(0, 1, 2)), c(6, 7, 8), rotation.euler_to_matrix(*c(3, 4, 5)), c(9, 10, 11)


@query(f"WITH {_E12} SELECT vec_id, " + ", ".join(f"round({_dot(_col3(_R2, i), _col3(_R1, j))}, 6) + 0.0 r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round({_dot(_col3(_R2, i), [f'({a} - {b})' for a, b in zip(_T1, _T2, strict=True)])}, 6) + 0.0 t{i}" for i in range(3)) + " FROM e")
def relative_poses(spark, d):
    e, r1, t1, r2, t2 = _poses(spark, d)
    r, t = poses.relative_pose(r1, t1, r2, t2)
    return e.select("vec_id", *[_r(r[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[_r(t[i]).alias(f"t{i}") for i in range(3)])


@query(f"WITH {_E12}, q AS (SELECT vec_id, cos(e0/2)*cos(e1/2)*cos(e2/2)+sin(e0/2)*sin(e1/2)*sin(e2/2) w, sin(e0/2)*cos(e1/2)*cos(e2/2)-cos(e0/2)*sin(e1/2)*sin(e2/2) x, cos(e0/2)*sin(e1/2)*cos(e2/2)+sin(e0/2)*cos(e1/2)*sin(e2/2) y, cos(e0/2)*cos(e1/2)*sin(e2/2)-sin(e0/2)*sin(e1/2)*cos(e2/2) z FROM (SELECT vec_id, e0 * 6 e0, e1 * 3 e1, e2 * 6 e2 FROM e)) SELECT vec_id, " + ", ".join(f"round({k} * CASE WHEN w < 0 THEN -1 ELSE 1 END, 6) + 0.0 {k}" for k in "wxyz") + " FROM q")
def matrix_to_quaternion(spark, d):
    e, *_ = _poses(spark, d)
    m = rotation.euler_to_matrix(F.col("e0") * 6, F.col("e1") * 3, F.col("e2") * 6)
    return e.select("vec_id", *[_r(c).alias(k) for c, k in zip(poses.matrix_to_quaternion(m), "wxyz", strict=True)])


_U = ["e0 / sqrt(e0*e0 + e1*e1 + e2*e2)", "e1 / sqrt(e0*e0 + e1*e1 + e2*e2)", "e2 / sqrt(e0*e0 + e1*e1 + e2*e2)"]
_AX = f"{_E12}, a AS (SELECT vec_id, {_U[0]} ux, {_U[1]} uy, {_U[2]} uz, sqrt(e0*e0 + e1*e1 + e2*e2) t, e3, e4, e5 FROM e)"
_K = [["0", "(-uz)", "uy"], ["uz", "0", "(-ux)"], ["(-uy)", "ux", "0"]]
_turned = lambda i, j: f"({int(i == j)} + sin(t) * {_K[i][j]} + (1 - cos(t)) * {_dot(_K[i], _col3(_K, j))})"  # noqa: E731  I + sin K + (1 - cos) K²


@query(f"WITH {_AX} SELECT vec_id, " + ", ".join(f"round({_turned(i, j)}, 6) + 0.0 m{i}{j}" for i in range(3) for j in range(3)) + " FROM a")
def axis_angle_to_matrix(spark, d):
    e, *_ = _poses(spark, d)
    t = F.sqrt(sum((F.col(f"e{k}") * F.col(f"e{k}") for k in (1, 2)), F.col("e0") * F.col("e0")))
    m = rotation.axis_angle_to_matrix(*[F.col(f"e{k}") / t for k in range(3)], t)
    return e.select("vec_id", *[_r(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


@query(f"WITH {_AX} SELECT vec_id, " + ", ".join(f"round({_dot([_turned(i, j) for j in range(3)], ['e3', 'e4', 'e5'])}, 6) + 0.0 {k}" for i, k in enumerate("xyz")) + " FROM a")
def rodrigues_points(spark, d):
    e, *_ = _poses(spark, d)
    x = rotation.rodrigues([F.col(f"e{k}") for k in (3, 4, 5)], [F.col(f"e{k}") for k in range(3)])
    return e.select("vec_id", *[_r(c).alias(k) for c, k in zip(x, "xyz", strict=True)])


@query(f"WITH {_E12} SELECT vec_id, " + ", ".join(f"round({_dot(_R1[i], ['e3', 'e4', 'e5'])}, 6) + 0.0 {k}" for i, k in enumerate("xyz")) + " FROM e")
def euler_points(spark, d):
    e, r, *_ = _poses(spark, d)
    return e.select("vec_id", *[_r(c).alias(k) for c, k in zip(rotation.apply(r, [F.col(f"e{k}") for k in (3, 4, 5)]), "xyz", strict=True)])


@query(f"WITH {_E12} SELECT vec_id, " + ", ".join(f"round({_dot(_R1[i], ['(e3 - e6 - e9)', '(e4 - e7 - e10)', '(e5 - e8 - e11)'])} + e{9 + i}, 6) + 0.0 {k}" for i, k in enumerate("xyz")) + " FROM e")
def corrected_points(spark, d):
    e, *_ = _poses(spark, d)
    c = lambda *k: [F.col(f"e{i}") for i in k]
    return e.select("vec_id", *[_r(v).alias(k) for v, k in zip(rotation.corrected(c(3, 4, 5), c(0, 1, 2), c(6, 7, 8), c(9, 10, 11)), "xyz", strict=True)])


_X = ["e3", "e4", "e5"]
_CAM = [f"({_dot(_R1[i], _X)} + e{6 + i})" for i in range(2)] + [f"({_dot(_R1[2], _X)} + e8 + 5)"]
_KK = "(900 + e9), (910 + e10), e11, (500 + e12), (400 + e13)".split(", ")


@query(f"WITH {_E12} SELECT vec_id, round({_KK[0]} * {_CAM[0]} / {_CAM[2]} + {_KK[2]} * {_CAM[1]} / {_CAM[2]} + {_KK[3]}, 6) col, round({_KK[1]} * {_CAM[1]} / {_CAM[2]} + {_KK[4]}, 6) \"row\", round({_KK[0]} * {_CAM[0]} + {_KK[2]} * {_CAM[1]}, 6) + 0.0 col_affine, round({_KK[1]} * {_CAM[1]}, 6) + 0.0 row_affine FROM e")
def parametric_cameras(spark, d):
    """Points seen by a perspective and by an affine camera of angles, translation and calibration."""
    e, *_ = _poses(spark, d)
    c = lambda *k: [F.col(f"e{i}") for i in k]
    k = [F.col("e9") + 900, F.col("e10") + 910, F.col("e11"), F.col("e12") + 500, F.col("e13") + 400]
    p = cameras.project_perspective(c(3, 4, 5), c(0, 1, 2), [F.col("e6"), F.col("e7"), F.col("e8") + 5], k)
    a = cameras.project_affine(c(3, 4, 5), c(0, 1, 2), c(6, 7), k[:3])
    return e.select("vec_id", F.round(p[0], 6).alias("col"), F.round(p[1], 6).alias("row"), _r(a[0]).alias("col_affine"), _r(a[1]).alias("row_affine"))


_P34 = [[f"({_dot([_KK[0], _KK[2], _KK[3]], [_R1[i][j] for i in range(3)] if j < 3 else ['e6', 'e7', '(e8 + 5)'])})" for j in range(4)], [f"({_dot([_KK[1], _KK[4]], [_R1[i][j] for i in (1, 2)] if j < 3 else ['e7', '(e8 + 5)'])})" for j in range(4)], [*_R1[2], "(e8 + 5)"]]


def _matrices(spark, d):
    e, r, *_ = _poses(spark, d)
    k = [F.col("e9") + 900, F.col("e10") + 910, F.col("e11"), F.col("e12") + 500, F.col("e13") + 400]
    return e, poses.perspective_matrix(r, [F.col("e6"), F.col("e7"), F.col("e8") + 5], k), poses.affine_matrix(r, [F.col("e6"), F.col("e7")], k[:3])


@query(f"WITH {_E12} SELECT vec_id, " + ", ".join(f"round({_P34[i][j]} / (e8 + 5){' * 2' if i < 2 else ''}, 6) + 0.0 p{i}{j}" for i in range(3) for j in range(4)) + " FROM e")
def composed_matrices(spark, d):
    """Perspective matrices of images that are zoomed by two."""
    e, p, _ = _matrices(spark, d)
    p = poses.rescaled_matrix(p, 2.0)
    return e.select("vec_id", *[_r(p[i][j]).alias(f"p{i}{j}") for i in range(3) for j in range(4)])


@query(f"WITH {_E12} SELECT vec_id, round(e0, 5) + 0.0 roll, round(e1, 5) + 0.0 pitch, round(e2, 5) + 0.0 yaw, round(900 + e9, 3) fx, round(910 + e10, 3) fy, round(e11, 3) + 0.0 skew, round(500 + e12, 3) cx, round(400 + e13, 3) cy, " + ", ".join(f"round(-{_dot(_col3(_R1, i), ['e6', 'e7', '(e8 + 5)'])}, 4) + 0.0 c{k}_" for i, k in enumerate("xyz")) + " FROM e")
def decomposed_cameras(spark, d):
    """Angles, calibration and centre that perspective matrices are made of."""
    e, p, _ = _matrices(spark, d)
    m = e.select(F.col("vec_id").alias("cam_id"), F.array(*[F.array(*r) for r in p]).alias("p"))
    c = geometry.decomposed(m, "perspective")
    return c.select(F.col("cam_id").alias("vec_id"), *[_r(F.col(k), 5).alias(k) for k in ("roll", "pitch", "yaw")], *[_r(F.col(k), 3).alias(k) for k in ("fx", "fy", "skew", "cx", "cy")], *[_r(F.col(f"c{k}_ecef"), 4).alias(f"c{k}_") for k in "xyz"])


@query(f"WITH {_E12} SELECT vec_id, round(e0, 5) + 0.0 roll, round(e1, 5) + 0.0 pitch, round(e2, 5) + 0.0 yaw, round(900 + e9, 3) fx, round(910 + e10, 3) fy, round(e11, 3) + 0.0 skew, round(e6, 5) + 0.0 t0, round(e7, 5) + 0.0 t1 FROM e")
def decomposed_affine(spark, d):
    e, _, p = _matrices(spark, d)
    c = geometry.decomposed(e.select(F.col("vec_id").alias("cam_id"), F.array(*[F.array(*r) for r in p]).alias("p")), "affine")
    return c.select(F.col("cam_id").alias("vec_id"), *[_r(F.col(k), 5).alias(k) for k in ("roll", "pitch", "yaw")], *[_r(F.col(k), 3).alias(k) for k in ("fx", "fy", "skew")], *[_r(F.col(f"t{k}"), 5).alias(f"t{k}") for k in range(2)])


_H = [[1.1, 0.02, 3.0], [-0.01, 0.95, -2.0], [0.001, -0.002, 1.0]]
_hom = lambda x, y: tuple(f"(({r[0]!r} * {x} + {r[1]!r} * {y} + {r[2]!r}) / ({_H[2][0]!r} * {x} + {_H[2][1]!r} * {y} + {_H[2][2]!r}))" for r in _H[:2])


@query(f"WITH {_E12} SELECT vec_id, round({_hom('e0', 'e1')[0]}, 9) x, round({_hom('e0', 'e1')[1]}, 9) y, round(e0, 9) + 0.0 bx, round(e1, 9) + 0.0 \"by\" FROM e")
def homographies(spark, d):
    """Points moved by a map of the plane, and moved back by its inverse."""
    e, *_ = _poses(spark, d)
    h = [[F.lit(v) for v in r] for r in _H]
    x, y = poses.homography(h, F.col("e0"), F.col("e1"))
    m = e.select("vec_id", x.alias("x"), y.alias("y"))
    bx, by = poses.homography(poses.inverse(h), F.col("x"), F.col("y"))
    return m.select("vec_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), _r(bx, 9).alias("bx"), _r(by, 9).alias("by"))


_MAT = "t AS (SELECT label cam_i, label + 1 cam_j, CAST(embedding[1] AS DOUBLE) x1, CAST(embedding[2] AS DOUBLE) y1, CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[3] AS DOUBLE) x2, CAST(embedding[2] AS DOUBLE) - CAST(embedding[4] AS DOUBLE) y2 FROM embeddings)"


def _plane_matches(spark, d) -> DataFrame:
    c = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, d, "embeddings").select(F.col("label").alias("cam_i"), (F.col("label") + 1).alias("cam_j"), c(0).alias("x1"), c(1).alias("y1"), (c(0) * 2 + c(2)).alias("x2"), (c(1) - c(3)).alias("y2"))


@query(f"WITH {_MAT} SELECT cam_i, cam_j, round(avg(x2 - x1), 9) dx, round(avg(y2 - y1), 9) dy FROM t GROUP BY 1, 2")
def plane_translations(spark, d):
    return plane.translations(_plane_matches(spark, d)).select("cam_i", "cam_j", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"))


@query(f"WITH {_MAT}, a AS (SELECT cam_i, cam_j, 2.0 x, -0.5 y, 1.5 u, 0.25 v, 3.0 w, -0.75 z FROM t GROUP BY 1, 2) SELECT cam_i, cam_j, x h00, y h01, w h02, v h10, u h11, z h12 FROM a")
def affine_maps(spark, d):
    """Maps of matches that one affine map makes exactly."""
    m = _plane_matches(spark, d)
    m = m.withColumns({"x2": 2.0 * F.col("x1") - 0.5 * F.col("y1") + 3.0, "y2": 0.25 * F.col("x1") + 1.5 * F.col("y1") - 0.75})
    return plane.affine_maps(m).select("cam_i", "cam_j", *[_r(F.col(f"h{i}{j}")).alias(f"h{i}{j}") for i in range(2) for j in range(3)])


@query(f"WITH {_MAT}, n AS (SELECT sqrt(0.3 * 0.3 + 0.8 * 0.8 + 0.5 * 0.5 + 0.4 * 0.4) s) SELECT DISTINCT cam_i, cam_j, round(0.5 / s, 6) a, round(0.4 / s, 6) b, round(-0.3 / s, 6) c, round(0.8 / s, 6) d, round(0.25 / s, 6) e FROM t, n")
def affine_fundamentals(spark, d):
    """Epipolar geometry of matches that hold it exactly: 0.5 x2 + 0.4 y2 - 0.3 x1 + 0.8 y1 + 0.25 = 0."""
    m = _plane_matches(spark, d).withColumn("y2", (0.3 * F.col("x1") - 0.8 * F.col("y1") - 0.5 * F.col("x2") - 0.25) / 0.4)
    return plane.affine_fundamentals(m).select("cam_i", "cam_j", *[F.round(c, 6).alias(c) for c in "abcde"])


@query(f"WITH {_E12} SELECT vec_id, round((e1 * e2 + 2 * e3 * e3 + 1) * 0, 6) + 0.0 off FROM e")
def rectified_rows(spark, d):
    """Row difference of matches on one epipolar line after both images are rectified: none."""
    e, *_ = _poses(spark, d)
    a, b, c, f = F.lit(0.5), F.lit(0.4), F.lit(-0.3), F.lit(0.8)
    one, two = poses.rectifying([a, b, c, f, F.lit(0.25)])
    y2 = (-0.25 - c * F.col("e0") - f * F.col("e1") - a * F.col("e2")) / b
    (_, r1), (_, r2) = poses.homography(one, F.col("e0"), F.col("e1")), poses.homography(two, F.col("e2"), y2)
    return e.select("vec_id", _r(r1 - r2).alias("off"))


@query("WITH p AS (SELECT vec_id, CAST(vec_id % 40 AS BIGINT) c, CAST(vec_id // 40 AS BIGINT) r, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings) SELECT a.vec_id, count(*) near FROM p a JOIN p b ON abs(a.c - b.c) <= 2 AND abs(a.r - b.r) <= 2 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < 0.2 * 0.2 GROUP BY 1")
def near_in_window(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 40).cast("long").alias("col"), F.floor(F.col("vec_id") / 40).alias("row"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return plane.neighbours_in_window(p, 2, 0.2).select("vec_id", "near")


_PATH = "'/scenes/a.b/' || strftime(DATE '2020-01-01' + CAST(s_suppkey % 700 AS INTEGER), '%Y%m%d') || '_' || lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || '1530_img' || s_suppkey || '.v1.tif'"


@query(f"WITH p AS (SELECT s_suppkey, {_PATH} path, s_acctbal FROM supplier) SELECT s_suppkey, regexp_extract(path, '([^/]*)\\.tif$', 1) image_id, replace(path, '.tif', '_adj.tif') adjusted, strptime(substr(regexp_extract(path, '([^/]*)$', 1), 1, 15), '%Y%m%d_%H%M%S') ts, printf('%02d:%02d:%05.2f', CAST(floor(abs(s_acctbal) * 10 / 3600) AS INTEGER), CAST(floor((abs(s_acctbal) * 10 % 3600) / 60) AS INTEGER), abs(s_acctbal) * 10 % 60) took FROM p")
def image_names(spark, d):
    k = F.col("s_suppkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")), "yyyyMMdd")
    path = F.concat(F.lit("/scenes/a.b/"), day, F.lit("_"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("1530_img"), k.cast("string"), F.lit(".v1.tif"))
    p = table(spark, d, "supplier").select("s_suppkey", path.alias("path"), (F.abs("s_acctbal") * 10).alias("s"))
    return p.select("s_suppkey", names.image_id(F.col("path")).alias("image_id"), names.with_suffix(F.col("path"), "_adj").alias("adjusted"), names.acquired(F.lit(None).cast("string"), F.col("path")).cast("timestamp_ntz").alias("ts"), names.clock(F.col("s")).alias("took"))


# what a refinement changed
_BA = "b AS (SELECT CAST(l_suppkey AS BIGINT) cam_id, l_quantity / 10.0 \"before\", l_discount * 10 \"after\" FROM lineitem)"


@query(f"WITH {_BA} SELECT cam_id, count(*) n, round(avg(\"before\"), 6) mean_before, round(median(\"before\"), 6) median_before, round(avg(\"after\"), 6) mean_after, round(median(\"after\"), 6) median_after FROM b GROUP BY ROLLUP (cam_id)")
def before_after(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("cam_id"), (F.col("l_quantity") / 10.0).alias("before"), (F.col("l_discount") * 10).alias("after"))
    return summaries.before_after(b).select("cam_id", "n", *[F.round(f"{m}_{c}", 6).alias(f"{m}_{c}") for m in ("mean", "median") for c in ("before", "after")])


@query("SELECT l_orderkey, l_linenumber, round(sqrt(power(l_quantity - 25, 2) + power(l_tax * 100 - 4, 2)), 6) err_before, round(sqrt(power(l_discount * 100 - 25, 2) + power(l_linenumber - 4, 2)), 6) err_after, round((abs(l_discount * 100 - 25) + abs(l_linenumber - 4)) / 2, 6) avg_residual FROM lineitem")
def camera_residuals(spark, d):
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(25.0).alias("col"), F.lit(4.0).alias("row"), F.col("l_quantity").alias("c0"), (F.col("l_tax") * 100).alias("r0"), (F.col("l_discount") * 100).alias("c1"), F.col("l_linenumber").alias("r1"))
    return summaries.camera_residuals(o).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("err_before", "err_after", "avg_residual")])


@query(f"WITH o AS ({OBS}), l AS (SELECT * FROM o WHERE err <= 0.06) SELECT track_id, cam_id FROM l WHERE track_id IN (SELECT track_id FROM l GROUP BY 1 HAVING count(*) >= 2)")
def absolute_rejection(spark, d):
    return summaries.reject_above(obs(spark, d), 0.06).select("track_id", "cam_id")


@query(f"WITH o AS ({OBS}), l0 AS (SELECT * FROM o WHERE err <= 0.06), l AS (SELECT * FROM l0 WHERE track_id IN (SELECT track_id FROM l0 GROUP BY 1 HAVING count(*) >= 2)), c AS (SELECT (SELECT count(*) FROM o) o0, (SELECT count(*) FROM l) o1, (SELECT count(DISTINCT track_id) FROM o) t0, (SELECT count(DISTINCT track_id) FROM l) t1) SELECT o0 - o1 n_obs, round(100.0 * (o0 - o1) / o0, 6) obs_percent, t0 - t1 n_tracks, round(100.0 * (t0 - t1) / t0, 6) tracks_percent FROM c")
def rejected_share(spark, d):
    o = obs(spark, d)
    r = summaries.rejected(o, summaries.reject_above(o, 0.06))
    return r.select("n_obs", F.round("obs_percent", 6).alias("obs_percent"), "n_tracks", F.round("tracks_percent", 6).alias("tracks_percent"))


@query("WITH c AS (SELECT s_nationkey % 5 scene, s_nationkey date_idx, count(*) n_images FROM supplier GROUP BY 1, 2) SELECT CAST(scene AS BIGINT) scene, CAST(date_idx AS BIGINT) date_idx, n_images, CAST(coalesce(sum(n_images) OVER (PARTITION BY scene ORDER BY date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) \"first\" FROM c")
def cameras_before_date(spark, d):
    c = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 5).cast("long").alias("scene"), F.col("s_nationkey").cast("long").alias("date_idx")).agg(F.count("*").alias("n_images"))
    return summaries.cameras_before(c)


_DATES = "t AS (SELECT DISTINCT CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) date_idx, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') date_id FROM orders), x AS (SELECT DISTINCT strftime(CAST(l_shipdate AS DATE), '%Y%m%d') date_id FROM lineitem WHERE l_quantity = 50)"


def _timeline(spark, d):
    o = F.to_date("o_orderdate")
    t = table(spark, d, "orders").select(F.datediff(o, F.lit("1990-01-01").cast("date")).cast("long").alias("date_idx"), F.date_format(o, "yyyyMMdd").alias("date_id")).distinct()
    x = table(spark, d, "lineitem").where("l_quantity = 50").select(F.date_format(F.to_date("l_shipdate"), "yyyyMMdd").alias("date_id"))
    return t, x


@query(f"WITH {_DATES} SELECT date_idx, t.date_id, x.date_id IS NOT NULL AND date_idx < 2000 adjusted FROM t LEFT JOIN x ON t.date_id = x.date_id")
def adjusted_dates(spark, d):
    t, x = _timeline(spark, d)
    return summaries.adjusted_before(t, x, 2000).select("date_idx", "date_id", "adjusted")


@query(f"WITH {_DATES}, a AS (SELECT date_idx, t.date_id, x.date_id IS NOT NULL AND date_idx < 2000 adjusted FROM t LEFT JOIN x ON t.date_id = x.date_id WHERE date_idx BETWEEN 1500 AND 2500), i AS (SELECT o_orderkey image_id, date_idx, adjusted FROM orders JOIN a ON a.date_id = strftime(CAST(o_orderdate AS DATE), '%Y%m%d')) SELECT *, row_number() OVER (ORDER BY adjusted DESC, date_idx, image_id) - 1 cam_id FROM i")
def images_of_dates(spark, d):
    t, x = _timeline(spark, d)
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.date_format(F.to_date("o_orderdate"), "yyyyMMdd").alias("date_id"))
    a = summaries.adjusted_before(t, x, 2000)
    return summaries.images_of_dates(images, a, a.where("date_idx between 1500 and 2500").select("date_idx")).select("image_id", "date_idx", "adjusted", "cam_id")


@query(f"WITH o AS ({OBS}) SELECT track_id, cam_id FROM o WHERE track_id IN (SELECT track_id FROM o JOIN supplier ON s_suppkey = cam_id WHERE s_nationkey = 7)")
def new_camera_tracks(spark, d):
    return tracks.tracks_of(obs(spark, d), cams(spark, d).where("s_nationkey = 7").select("cam_id")).select("track_id", "cam_id")


@query()
def sensor_selected_tracks(spark, d):
    o = obs(spark, d)
    return tracks.select_by_sensor(o, cams(spark, d).select("cam_id", (F.col("s_nationkey") % 3).cast("string").alias("sensor")), 1, kept)


_BOX = "b AS (SELECT label, min(CAST(embedding[1] AS DOUBLE)) x0, max(CAST(embedding[1] AS DOUBLE)) x1, min(CAST(embedding[2] AS DOUBLE)) y0, max(CAST(embedding[2] AS DOUBLE)) y1 FROM embeddings GROUP BY 1)"


@query(f"WITH {_BOX}, r AS (SELECT i.label cam_i, j.label cam_j, greatest(i.x0, j.x0) x0, least(i.x1, j.x1) x1, greatest(i.y0, j.y0) y0, least(i.y1, j.y1) y1 FROM b i JOIN b j ON i.label < j.label) SELECT cam_i, cam_j, label cam_id, vec_id kp_id FROM r JOIN embeddings ON label IN (cam_i, cam_j) WHERE embedding[1] > x0 AND embedding[1] < x1 AND embedding[2] > y0 AND embedding[2] < y1")
def overlap_keypoints(spark, d):
    k = kps(spark, d).withColumns({"x": F.col("desc")[0].cast("double"), "y": F.col("desc")[1].cast("double")})
    boxes = k.groupBy("cam_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return matching.overlap_keypoints(k, pairs.all_pairs(boxes), boxes)


_F9 = [x for r in FUND for x in r]


@query(f"""WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding AS DOUBLE[]) e FROM embeddings), l AS (SELECT *, {_F9[0]!r}*x+{_F9[1]!r}*y+({_F9[2]!r}) a, {_F9[3]!r}*x+{_F9[4]!r}*y+{_F9[5]!r} b, {_F9[6]!r}*x+({_F9[7]!r})*y+{_F9[8]!r} c FROM p),
d AS (SELECT i.label cam_i, j.label cam_j, i.vec_id kp_i, j.vec_id kp_j, round(list_distance(i.e, j.e), 9) dist FROM l i JOIN p j ON i.label < j.label AND abs(a * j.x + b * j.y + c) <= 0.05 * sqrt(a * a + b * b)),
r AS (SELECT *, row_number() OVER w k, lead(dist) OVER w nxt FROM d WINDOW w AS (PARTITION BY cam_i, cam_j, kp_i ORDER BY dist, kp_j)) SELECT cam_i, cam_j, kp_i, kp_j, round(dist, 6) dist FROM r WHERE k = 1 AND (nxt IS NULL OR dist < 0.95 * nxt)""")
def epipolar_match(spark, d):
    k = kps(spark, d).withColumns({"x": F.col("desc")[0].cast("double"), "y": F.col("desc")[1].cast("double")})
    both = pairs.all_pairs(k.select("cam_id").distinct()).withColumn("f", F.array(*[F.lit(v) for v in _F9]))
    return matching.epipolar_match(k, both, 0.05, 0.95).withColumn("dist", F.round("dist", 6))


@query(f"WITH {LL}, n AS (SELECT c_custkey, lon / 180.0 x, lat / 90.0 y, alt / 10000.0 z FROM g) SELECT c_custkey, round({_poly(RPC['col_num'])} / {_poly(RPC['col_den'])} * 510.0 + 500.0, 4) col, round({_poly(RPC['row_num'])} / {_poly(RPC['row_den'])} * 410.0 + 400.0, 4) \"row\" FROM n")
def projected_points(spark, d):
    """Geocentric points seen by a camera whose kind is a parameter."""
    x = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    p = _lonlat(spark, d).select("c_custkey", *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])
    col, row = cameras.project("rpc", RPC, [F.col(k) for k in "xyz"])
    return p.select("c_custkey", F.round(col, 4).alias("col"), F.round(row, 4).alias("row"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(power(l_quantity - l_tax * 100, 2) + power(l_linenumber - l_discount * 10, 2)), 6) err FROM lineitem")
def fit_errors(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 100).alias("col"), (F.col("l_discount") * 10).alias("row"), F.col("l_quantity").alias("col_fit"), F.col("l_linenumber").alias("row_fit"))
    return summaries.fit_errors(s).select("l_orderkey", "l_linenumber", F.round("err", 6).alias("err"))
