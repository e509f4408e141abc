"""Queries on height grids, dense points and the forest of descriptors, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import poses
from ..operators import forest, geometry, heights, surface
from ..operators.pairs import all_pairs
from ..session import table
from . import scene
from .catalog import LL, _lonlat, _r, kps, query

GRID = f"""WITH {LL}, n AS (SELECT c_custkey % 36 ix, c_custkey % 17 iy, max(c_acctbal) h FROM customer GROUP BY 1, 2),
p0 AS (SELECT *, (lon + 180.0) / 10.0 x0, (lat + 80.0) / 10.0 y FROM g), p AS (SELECT *, x0 - floor(x0 / 36) * 36 x FROM p0),
w AS (SELECT c_custkey, alt, (CAST(floor(x) AS BIGINT) + i) % 36 ix, CAST(floor(y) AS BIGINT) + k iy, (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE k WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) w FROM p, range(2) a(i), range(2) b(k)),
s AS (SELECT c_custkey, any_value(alt) alt, CASE WHEN count(*) FILTER (w <> 0 AND h IS NULL) = 0 THEN sum(CASE WHEN w = 0 THEN 0 ELSE w * h END) END height FROM w LEFT JOIN n USING (ix, iy) GROUP BY 1)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return heights.tiled(table(spark, d, "customer").groupBy((k % 36).alias("ix"), (k % 17).alias("iy")).agg(F.max("c_acctbal").alias("h")), 8, 36)


@query(f"{GRID} SELECT c_custkey, round(height, 4) + 0.0 height FROM s")
def grid_heights(spark, d):
    h = heights.heights_at(_lonlat(spark, d), _grid(spark, d), -180.0, -80.0, 10.0, 8, 36)
    return h.select("c_custkey", _r(F.col("height"), 4).alias("height"))


@query(f"{GRID} SELECT c_custkey, round(alt + height, 4) + 0.0 ellipsoid FROM s")
def ellipsoidal_heights(spark, d):
    h = heights.ellipsoidal(_lonlat(spark, d), _grid(spark, d), -180.0, -80.0, 10.0, 8, 36)
    return h.select("c_custkey", _r(F.col("ellipsoid"), 4).alias("ellipsoid"))


@query("""WITH RECURSIVE p AS (SELECT vec_id id, CAST(vec_id % 40 AS BIGINT) c, CAST(vec_id // 40 AS BIGINT) r, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings),
e AS (SELECT a.id a, b.id b, greatest(abs(a.c - b.c), abs(a.r - b.r)) far FROM p a JOIN p b ON abs(a.c - b.c) <= 3 AND abs(a.r - b.r) <= 3 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < 0.12 * 0.12),
s AS (SELECT a id FROM e WHERE far <= 2 GROUP BY 1 HAVING count(*) >= 3 UNION SELECT e.b FROM s JOIN e ON s.id = e.a)
SELECT id vec_id FROM s""")
def without_isolated(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 40).cast("long").alias("col"), F.floor(F.col("vec_id") / 40).alias("row"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return surface.without_isolated(p, 0.12, 2, 3, 3).select(F.col("id").alias("vec_id"))


# rectifying maps of the two images
HA, HB = [[0.9, 0.1, 5.0], [-0.1, 1.1, -3.0], [1e-6, 2e-6, 1.0]], [[1.05, -0.05, 2.0], [0.02, 0.95, 7.0], [-2e-6, 1e-6, 1.0]]


@query(f"SELECT id, lon, lat, alt FROM ({scene.GROUND})")
def disparity_points(spark, d):
    p, m = scene.ground(spark, d), scene.models(spark)
    lit = lambda h: [[F.lit(v) for v in r] for r in h]

    def seen(k: int, h: list) -> DataFrame:
        x, y = poses.homography(lit(h), F.col("col"), F.col("row"))
        return geometry.project(p.withColumn("cam_id", F.lit(k).cast("long")), m).select("id", x.alias(f"x{k}"), y.alias(f"y{k}"))

    s = seen(0, HA).join(seen(1, HB), "id")
    at = s.select("id", F.col("x0").alias("col"), F.col("y0").alias("row"), (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))
    found = surface.disparity_points(at, HA, HB, m, 0, 1, (-1e9, 1e9, -1e9, 1e9))
    return found.select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("alt", 1).alias("alt"))


@query()
def forest_match(spark, d):
    k = kps(spark, d)
    m = forest.forest_match(k, all_pairs(k.select("cam_id").distinct()), 0.9)
    return m.select("cam_i", "cam_j", "kp_i", "kp_j", F.round("dist", 6).alias("dist"))
