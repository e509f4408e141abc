"""Refinement date by date: each date's cameras are free, those of the dates before it fixed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outliers, solve, tracks


def robust(spark: SparkSession, obs: DataFrame, points: DataFrame, models: DataFrame, centres: DataFrame, keep: Callable[[DataFrame], DataFrame], fixed: set[int] = frozenset(), settings: solve.Settings | None = None):
    """Soft L1 first, then outliers by each camera's elbow go, then squared loss on what is left:
    tracks that keep two observations."""
    s = settings or solve.Settings()
    angles, moved, _ = solve.adjust(spark, obs, points, models, centres, keep, fixed, replace(s, soft=True))
    err = keep(solve.errors(solve._state(spark, obs, moved, models, angles, centres, s), s))
    good = outliers.inliers(err.withColumnRenamed("cam_id", "grp")).select("track_id", F.col("grp").alias("cam_id"))
    left = obs.join(good, ["track_id", "cam_id"], "left_semi")
    left = keep(left.join(tracks.valid_tracks(left), "track_id", "left_semi"))
    return solve.adjust(spark, left, points, models, centres, keep, fixed, s), left


def by_date(spark: SparkSession, dates: dict[int, set[int]], obs: DataFrame, points: DataFrame, models: DataFrame, centres: DataFrame, keep: Callable[[DataFrame], DataFrame], back: int = 1) -> dict:
    """Angles of all cameras, taking the dates in order with `back` dates before each as fixed."""
    done, angles = [], {}
    for date in sorted(dates):
        old = set().union(*[dates[x] for x in done[-back:]]) if done else set()
        cams = dates[date] | old
        here = obs.where(F.col("cam_id").isin(sorted(cams)))
        here = keep(here.join(tracks.valid_tracks(here), "track_id", "left_semi"))
        found, _, _ = solve.adjust(spark, here, points, models.where(F.col("cam_id").isin(sorted(cams))), centres, keep, old)
        angles |= {c: found[c] for c in dates[date] if c in found}
        done.append(date)
    return angles
