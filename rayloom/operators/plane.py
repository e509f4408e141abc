"""Plane geometry of image pairs, from sums over their matches.

A pair's matches are summed where they are (means, then products about the means), so a pair of any
size is one small row when its fit is made; only these rows, one a pair, meet numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x1", "y1", "x2", "y2")
PAIR = ("cam_i", "cam_j")


def moments(matches: DataFrame) -> DataFrame:
    """(cam_i, cam_j, n, mean, cov): means and products about them, 4 and 4 x 4, of matches (x1, y1, x2, y2)."""
    m = matches.groupBy(*PAIR).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in AXES]).alias("mean"))
    c = matches.join(m, list(PAIR)).select(*PAIR, "n", "mean", *[(F.col(c) - F.col("mean")[k]).alias(c) for k, c in enumerate(AXES)])
    return c.groupBy(*PAIR).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in AXES for b in AXES]).alias("cov"))


def translations(matches: DataFrame) -> DataFrame:
    """(cam_i, cam_j, dx, dy): the mean way from the first image's points to the second's."""
    return matches.groupBy(*PAIR).agg(F.avg(F.col("x2") - F.col("x1")).alias("dx"), F.avg(F.col("y2") - F.col("y1")).alias("dy"))


def _fits(m: DataFrame, fit, columns: list[str]) -> DataFrame:
    kind = {c: m.schema[c].dataType.simpleString() for c in PAIR}

    def run(parts):
        for pdf in parts:
            out = [fit(np.array(a, float), np.array(c, float).reshape(4, 4)) for a, c in zip(pdf["mean"], pdf["cov"], strict=True)]
            yield pd.concat([pdf[list(PAIR)].reset_index(drop=True), pd.DataFrame(np.array(out, float).reshape(-1, len(columns)), columns=columns)], axis=1)

    return m.mapInPandas(run, ", ".join([*(f"{c} {k}" for c, k in kind.items()), *(f"{c} double" for c in columns)]))


def affine_fundamentals(matches: DataFrame) -> DataFrame:
    """(cam_i, cam_j, a, b, c, d, e): a x2 + b y2 + c x1 + d y1 + e = 0 with a² + b² + c² + d² = 1, the
    plane of least squared distances to a pair's matches; a pair of fewer than four has none."""

    def fit(mean: np.ndarray, cov: np.ndarray) -> list[float]:
        n = np.linalg.eigh(cov)[1][:, 0]
        n = n * (1 if n[np.argmax(np.abs(n))] > 0 else -1)
        return [n[2], n[3], n[0], n[1], -n @ mean]

    return _fits(moments(matches).where("n >= 4"), fit, list("abcde"))


def affine_maps(matches: DataFrame) -> DataFrame:
    """(cam_i, cam_j, h00, h01, h02, h10, h11, h12): the affine map of the first image's points to the
    second's with least squared distances in both images; a pair of fewer than three has none."""

    def fit(mean: np.ndarray, cov: np.ndarray) -> list[float]:
        v = np.linalg.eigh(cov)[1][:, 2:]  # the two main directions span the matches
        h = v[2:] @ np.linalg.pinv(v[:2])
        return [*h[0], mean[2] - h[0] @ mean[:2], *h[1], mean[3] - h[1] @ mean[:2]]

    return _fits(moments(matches).where("n >= 3"), fit, [f"h{i}{j}" for i in range(2) for j in range(3)])


def neighbours_in_window(points: DataFrame, window: int, radius: float) -> DataFrame:
    """`points` (col, row, x, y, z) of a raster with `near`: how many points of the (2 window + 1)²
    pixels around, itself included, stand less than `radius` away in space."""
    step = F.sequence(F.lit(-window), F.lit(window))
    asked = points.select("col", "row", "x", "y", "z", F.explode(step).alias("i")).select("*", F.explode(step).alias("j"))
    asked = asked.select(F.col("col").alias("c0"), F.col("row").alias("r0"), *[F.col(k).alias(f"{k}0") for k in "xyz"], (F.col("col") + F.col("i")).alias("col"), (F.col("row") + F.col("j")).alias("row"))
    met = asked.join(points.select("col", "row", "x", "y", "z"), ["col", "row"]).where(sum((F.pow(F.col(f"{k}0") - F.col(k), 2) for k in "xyz"), F.lit(0.0)) < radius * radius)
    n = met.groupBy(F.col("c0").alias("col"), F.col("r0").alias("row")).agg(F.count("*").alias("near"))
    return points.join(n, ["col", "row"])
