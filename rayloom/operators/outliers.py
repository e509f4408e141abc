"""Outlier thresholds from the elbow of sorted errors, and error distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import placed, quantile


def elbows(err: DataFrame, percent: int = 20) -> DataFrame:
    """(grp, n, elbow, high, found) for errors (grp, err).

    The elbow is the value farthest from the chord of the sorted curve (places on one axis, values
    on the other, the first of equals); it is `found` where it reaches the (100 - percent)th
    percentile.
    """
    r = placed(err.select("grp", "err"), "grp", "err")
    # twice the triangle's area over the chord: the chord's length is the same for all places
    off = F.abs((F.col("hi") - F.col("lo")) * F.col("i") - (F.col("n") - 1) * (F.col("err") - F.col("lo")))
    r = r.withColumn("off", F.round(off, 6))
    s = r.groupBy("grp").agg(F.count("*").alias("n"), F.max_by("err", F.struct("off", -F.col("i"))).alias("elbow"), quantile(1 - percent / 100, "err").alias("cut"), F.max("err").alias("high"))
    return s.select("grp", "n", "elbow", "high", (F.col("elbow") >= F.col("cut")).alias("found"))


def thresholds(err: DataFrame, least: float = 1.0, percent: int = 20) -> DataFrame:
    """(grp, thr): the elbow, at least `least`, or the maximum where there is none; two places."""
    e = elbows(err, percent)
    return e.select("grp", F.bround(F.when(F.col("found"), F.greatest("elbow", F.lit(least))).otherwise(F.col("high")), 2).alias("thr"))


def inliers(err: DataFrame, least: float = 1.0, percent: int = 20) -> DataFrame:
    """The rows whose error is not above their group's threshold. One row a group is joined."""
    return err.join(thresholds(err, least, percent), "grp").where(F.col("err") <= F.col("thr"))


def histogram(err: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, n): equal bins between the extremes, the last one closed."""
    ends = err.agg(F.min("err").alias("lo"), F.max("err").alias("hi"))
    b = err.crossJoin(F.broadcast(ends))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("err") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return b.select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def equalize(values: DataFrame, percent: float = 5) -> DataFrame:
    """`v` clipped to the outer percentiles of its group and scaled to 0..255."""
    q = placed(values.select("grp", "v"), "grp", "v").groupBy("grp").agg(quantile(percent / 100, "v").alias("q0"), quantile(1 - percent / 100, "v").alias("q1")).toDF("grp", "lo", "hi")
    v = values.join(q, "grp").withColumn("c", F.least(F.greatest("v", "lo"), "hi"))
    return v.withColumn("scaled", F.when(F.col("hi") > F.col("lo"), 255 * (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("c", "lo", "hi")


def reprojection_error(residuals: DataFrame) -> DataFrame:
    """Length of the residual (dx, dy) without its weight w."""
    return residuals.withColumn("err", F.sqrt(F.pow(F.col("dx") / F.col("w"), 2) + F.pow(F.col("dy") / F.col("w"), 2)))


def drift(before_after: DataFrame) -> DataFrame:
    """Mean shift of points (x, y, z) to (x1, y1, z1)."""
    return before_after.agg(*[F.avg(F.col(f"{c}1") - F.col(c)).alias(f"d{c}") for c in "xyz"])


def error_grid(points: DataFrame, res: float) -> DataFrame:
    """(gx, gy, n, mean_err): errors of points (x, y, err) on a grid, the data of a heat map."""
    cell = lambda c: F.floor(F.col(c) / res)
    return points.groupBy(cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count("*").alias("n"), F.avg("err").alias("mean_err"))
