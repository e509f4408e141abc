"""Points of a dense match of two images, and the removal of those that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, poses
from ..session import kept
from . import geometry, graph


def disparity_points(disparities: DataFrame, ha: list[list[float]], hb: list[list[float]], models: DataFrame, cam_a: int, cam_b: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(col, row, lon, lat, alt, miss) of the pixels of a rectified image (col, row, dx, dy), and their other columns, such
    as an id where several rows stand for one pixel: each pixel and the one that
    its disparity leads to are taken back to their images by the rectifying maps `ha` and `hb`, and meet
    in space. Pixels without a disparity, and those whose whole place in the first image is outside of
    `box` (first and last column, first and last row), have no point."""
    lit = lambda h: [[F.lit(float(v)) for v in r] for r in h]
    back_a, back_b = poses.inverse(lit(ha)), poses.inverse(lit(hb))
    d = disparities.where("dx IS NOT NULL AND dy IS NOT NULL AND NOT isnan(dx) AND NOT isnan(dy)")
    ci, ri = poses.homography(back_a, F.col("col"), F.col("row"))
    cj, rj = poses.homography(back_b, F.col("col") + F.col("dx"), F.col("row") + F.col("dy"))
    at = d.select(F.struct(*[c for c in d.columns if c not in ("dx", "dy")]).alias("pixel"), ci.alias("ci"), ri.alias("ri"), cj.alias("cj"), rj.alias("rj"))
    near = lambda c, lo, hi: F.round(c).between(lo, hi)
    at = at.where(near("ci", *box[:2]) & near("ri", *box[2:]))
    at = kept(at.withColumn("track_id", F.monotonically_increasing_id()))
    t = geometry.triangulate(at.select("track_id", F.lit(cam_a).cast("long").alias("cam_i"), F.lit(cam_b).cast("long").alias("cam_j"), "ci", "ri", "cj", "rj"), models)
    lat, lon, alt = geodesy.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return at.select("track_id", "pixel.*").join(t.select("track_id", lon.alias("lon"), lat.alias("lat"), alt.alias("alt"), "miss"), "track_id").drop("track_id")


def near_pairs(points: DataFrame, window: int, radius: float) -> DataFrame:
    """(a, b): points (id, col, row, x, y, z) of a raster that stand at most `window` columns and rows and less than
    `radius` in space apart, each pair once. Null and not-a-number places are near nothing."""
    p = points.select("id", "col", "row", "x", "y", "z")
    step = F.sequence(F.lit(-window), F.lit(window))
    # half of the window: the pixels behind in the order of rows and columns
    asked = p.select(F.col("id").alias("a"), *[F.col(k).alias(f"{k}0") for k in "xyz"], F.col("col").alias("c0"), F.col("row").alias("r0"), F.explode(step).alias("i")).select("*", F.explode(step).alias("j"))
    asked = asked.where("j > 0 OR (j = 0 AND i > 0)").select("a", "x0", "y0", "z0", (F.col("c0") + F.col("i")).alias("col"), (F.col("r0") + F.col("j")).alias("row"))
    d2 = sum((F.pow(F.col(f"{k}0") - F.col(k), 2) for k in "xyz"), F.lit(0.0))
    return asked.join(p.withColumnRenamed("id", "b"), ["col", "row"]).where(d2 < radius * radius).select("a", "b")


def without_isolated(points: DataFrame, radius: float, window: int, least: int, rescue: int) -> DataFrame:
    """The points (id, col, row, x, y, z) of a raster that are not alone: those with `least` points (themselves
    included) nearer than `radius` among the (2 window + 1)² pixels around, and all that these save: a point is saved by
    one that stays and stands nearer than `radius` among the (2 rescue + 1)² pixels around it, and so on.

    What is saved in the end is all of a component of such neighbours that holds one point with enough
    of them; the components come from rounds of halving ways, not from a scan that is repeated.
    """
    p = points.select("id", "col", "row", "x", "y", "z")
    ends = near_pairs(p, window, radius).select(F.explode(F.array("a", "b")).alias("id"))
    full = ends.groupBy("id").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= least).select("id")
    if least <= 1:
        number = lambda k: F.col(k).isNotNull() & ~F.isnan(k)
        full = p.where(number("x") & number("y") & number("z")).select("id")
    full = kept(full)
    labels = graph.connected_components(near_pairs(p, rescue, radius))
    saved = labels.join(labels.join(full, labels["node"] == full["id"], "left_semi").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("id"))
    return points.join(full.union(saved).distinct(), "id", "left_semi")
