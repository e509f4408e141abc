"""Queries on masks, boxes and overlays of rings of any shape, each with its SQL for DuckDB.

Rings are made from the tables: ragged rings with holes from the customers of a nation in order of
their keys, and shapes with a notch and a hole from the suppliers. In SQL, pixels and unit squares are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import regions
from ..session import kept, table
from .catalog import _r, query

# a band from left to right and back, with ragged borders; half as high it is the hole
RAGGED = """c AS (SELECT c_nationkey area, c_custkey c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 k, count(*) OVER (PARTITION BY c_nationkey) n FROM customer),
p AS (SELECT area, r.ring, k, CASE WHEN k < n // 2 THEN k * 6 + c % 5 ELSE (n - 1 - k) * 6 + c % 3 END * 1e0 x, CASE WHEN k < n // 2 THEN 52 + (c * 13 % 40) // (r.ring + 1) ELSE 48 - (c * 17 % 40) // (r.ring + 1) END * 1e0 y FROM c, (VALUES (0), (1)) r(ring) WHERE n >= 3),
e AS (SELECT area, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) u, coalesce(lead(y) OVER w, first_value(y) OVER w) v FROM p WINDOW w AS (PARTITION BY area, ring ORDER BY k)),
s AS (SELECT area, CASE WHEN y <= v THEN x ELSE u END x, CASE WHEN y <= v THEN y ELSE v END y, CASE WHEN y <= v THEN u ELSE x END u, CASE WHEN y <= v THEN v ELSE y END v FROM e WHERE y <> v)"""
_cross = "x + (\"row\" - y) * (u - x) / (v - y)"


def _ragged(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("c_nationkey")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("c"), (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    p = c.where("n >= 3").withColumn("ring", F.explode(F.array(F.lit(0), F.lit(1))))
    there = F.col("i") < F.floor(F.col("n") / 2)
    x = F.when(there, F.col("i") * 6 + F.col("c") % 5).otherwise((F.col("n") - 1 - F.col("i")) * 6 + F.col("c") % 3)
    y = F.when(there, 52 + F.floor(F.col("c") * 13 % 40 / (F.col("ring") + 1))).otherwise(48 - F.floor(F.col("c") * 17 % 40 / (F.col("ring") + 1)))
    return p.select("area", "ring", "i", x.cast("double").alias("x"), y.cast("double").alias("y"))


POINTS = "k AS (SELECT l_orderkey o, l_linenumber l, l_suppkey % 25 area, (l_partkey % 2000) / 8.0 col, l_quantity * 2 + l_discount AS pos FROM lineitem)"


@query(f"""WITH {RAGGED}, {POINTS}, q AS (SELECT DISTINCT area, CAST(floor(col) AS BIGINT) c, CAST(floor(pos) AS BIGINT) "row" FROM k),
t AS (SELECT q.area, c, "row" FROM q JOIN s ON s.area = q.area AND "row" >= y AND "row" < v GROUP BY 1, 2, 3 HAVING count(*) FILTER ({_cross} <= c) % 2 = 1 OR count(*) FILTER ({_cross} = c) > 0)
SELECT o, l, k.area FROM k JOIN t ON k.area = t.area AND floor(col) = t.c AND floor(pos) = t."row\"""")
def area_keypoints(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), (F.col("l_suppkey") % 25).alias("area"), (F.col("l_partkey") % 2000 / 8.0).alias("col"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("row"))
    return regions.masked(k, regions.fill_runs(_ragged(spark, d), "area"), "area").select("o", "l", "area")


@query(f"""WITH {RAGGED}, g AS (SELECT area, CAST(min(x) AS BIGINT) a, CAST(max(x) AS BIGINT) b FROM p GROUP BY 1), h AS (SELECT area, r "row", unnest(range(a, b + 1)) c FROM g, range(0, 101) r(r)),
t AS (SELECT h.area, c, "row" FROM h JOIN s ON s.area = h.area AND "row" >= y AND "row" < v GROUP BY 1, 2, 3 HAVING count(*) FILTER ({_cross} <= c) % 2 = 1 OR count(*) FILTER ({_cross} = c) > 0)
SELECT area, CAST("row" AS BIGINT) "row", count(*) n FROM t GROUP BY 1, 2""")
def area_mask_rows(spark, d):
    r = regions.fill_runs(_ragged(spark, d), "area")
    return r.groupBy("area", "row").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))


BOXES = "b AS (SELECT s_nationkey g, s_suppkey m, (s_suppkey * 37 % 97) * 1e0 x0, (s_suppkey * 53 % 89) * 1e0 y0, (s_suppkey * 37 % 97) + pow(2e0, s_suppkey % 7) x1, (s_suppkey * 53 % 89) + 1e0 * (s_suppkey % 13) y1 FROM supplier)"


@query(f"WITH {BOXES} SELECT a.g, CAST(a.m AS BIGINT) a, CAST(b.m AS BIGINT) b FROM b a JOIN b ON a.g = b.g AND a.m < b.m AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def box_pairs(spark, d):
    k = F.col("s_suppkey").cast("long")
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), k.alias("m"), (k * 37 % 97).alias("x0"), (k * 53 % 89).alias("y0"), (k * 37 % 97 + F.pow(F.lit(2.0), k % 7)).alias("x1"), (k * 53 % 89 + k % 13).alias("y1"))
    return regions.box_pairs(b, ["g"], "m")


NOTCHED = """q AS (SELECT s_nationkey g, s_suppkey m, s_suppkey * 37 % 41 x0, s_suppkey * 53 % 43 y0, s_suppkey * 37 % 41 + 12 + s_suppkey % 5 x1, s_suppkey * 53 % 43 + 10 + s_suppkey % 4 y1 FROM supplier),
u AS (SELECT g, m, x, unnest(range(y0, y1)) y, x0, y0 FROM (SELECT *, unnest(range(x0, x1)) x FROM q)),
f AS (SELECT g, x, y, count(*) n FROM u WHERE NOT (x >= x0 + 3 AND x < x0 + 6 AND y >= y0 + 4) AND NOT (x >= x0 + 8 AND x < x0 + 10 AND y >= y0 + 3 AND y < y0 + 6) GROUP BY 1, 2, 3)"""


def _notched(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), k.alias("m"), (k * 37 % 41).alias("x0"), (k * 53 % 43).alias("y0"), (12 + k % 5).alias("w"), (10 + k % 4).alias("h"))
    at = lambda ring, i, x, y: F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("i"), (F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    w, h = F.col("w"), F.col("h")
    outer = [(0, 0), (w, 0), (w, h), (6, h), (6, 4), (3, 4), (3, h), (0, h)]
    hole = [(8, 3), (8, 6), (10, 6), (10, 3)]
    points = [at(r, i, x, y) for r, ring in enumerate((outer, hole)) for i, (x, y) in enumerate(ring)]
    return s.select("g", "m", F.explode(F.array(*points)).alias("p")).select("g", "m", "p.*")


@query(f"WITH {NOTCHED} SELECT g, n, CAST(count(*) AS DOUBLE) area FROM f GROUP BY 1, 2")
def covered_areas(spark, d):
    return regions.covered_areas(_notched(spark, d), "g", "m").select("g", "n", F.round("area", 6).alias("area")).where("area > 0")


@query(f"WITH {NOTCHED} SELECT g, CAST(count(*) AS DOUBLE) once, CAST(count(*) FILTER (n >= 2) AS DOUBLE) twice FROM f GROUP BY 1")
def border_areas(spark, d):
    pieces = kept(regions.overlay(_notched(spark, d), "g", "m"), "pieces")
    one, two = (regions.border_areas(regions.above(pieces, "g", k), "g").select("g", _r(F.col("area")).alias(n)) for k, n in ((1, "once"), (2, "twice")))
    return one.join(two, "g", "left").select("g", "once", F.coalesce("twice", F.lit(0.0)).alias("twice"))


@query(f"""WITH {NOTCHED}, v AS (SELECT m, g, x, y FROM u WHERE NOT (x >= x0 + 3 AND x < x0 + 6 AND y >= y0 + 4) AND NOT (x >= x0 + 8 AND x < x0 + 10 AND y >= y0 + 3 AND y < y0 + 6))
SELECT a.g, CAST(a.m AS BIGINT) a, CAST(b.m AS BIGINT) b, CAST(count(*) AS DOUBLE) shared FROM v a JOIN v b ON a.g = b.g AND a.m < b.m AND a.x = b.x AND a.y = b.y GROUP BY 1, 2, 3""")
def shared_areas(spark, d):
    return regions.pair_areas(_notched(spark, d), "g", "m", border=False).select("g", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("shared", 6).alias("shared")).where("shared > 0")


@query(f"""WITH RECURSIVE {NOTCHED}, v AS (SELECT m, g, x, y FROM u WHERE NOT (x >= x0 + 3 AND x < x0 + 6 AND y >= y0 + 4) AND NOT (x >= x0 + 8 AND x < x0 + 10 AND y >= y0 + 3 AND y < y0 + 6)),
w AS (SELECT g, x, y, m lo FROM v), e AS (SELECT DISTINCT a.g, a.m a, b.m b FROM v a JOIN v b ON a.g = b.g AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r AS (SELECT DISTINCT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON r.g = e.g AND r.b = e.a)
SELECT g, count(DISTINCT c) parts FROM (SELECT g, a, min(b) c FROM r GROUP BY 1, 2) GROUP BY 1""")
def union_parts(spark, d):
    return regions.union_parts(_notched(spark, d), "g", "m")
