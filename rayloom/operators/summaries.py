"""What a refinement changed, and which dates and images it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tracks
from .ranges import placed, quantile, ranked


def before_after(errors: DataFrame, by: str = "cam_id") -> DataFrame:
    """Mean and median error before and after, for each group of errors (by, before, after) and, under
    a null group, for all. Means come from one aggregation by grouping sets; medians from places among
    all errors in order (`ranges.placed`), so that no task holds those of a large group, or all."""
    names = ("before", "after")
    total = F.grouping(by).cast("int").alias("__all")
    means = errors.rollup(by).agg(total, F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names])
    label = lambda everything: F.when(everything, F.lit("*")).otherwise(F.concat(F.lit("="), F.coalesce(F.col(by).cast("string"), F.lit(""))))
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("value"), F.lit(a).alias("all")) for c in names for a in (False, True)])).alias("e")
    long = errors.select(by, sides).select(F.concat_ws("", "e.side", label(F.col("e.all"))).alias("grp"), F.col("e.value").alias("value"))
    medians = placed(long, "grp", "value").groupBy("grp").agg(quantile(0.5, "value").alias("median"))
    out = means.withColumn("__name", label(F.col("__all") == 1))
    for c in names:
        m = medians.where(F.startswith("grp", F.lit(c))).select(F.substring("grp", len(c) + 1, 1 << 30).alias("__name"), F.col("median").alias(f"median_{c}"))
        out = out.join(m, "__name", "left")
    return out.select(by, "n", *[f"{k}_{c}" for c in names for k in ("mean", "median")])


def camera_residuals(obs: DataFrame) -> DataFrame:
    """`obs` (col, row and the reprojections c0, r0 before and c1, r1 after) with err_before, err_after
    and avg_residual, the mean of the two absolute residuals after."""
    far = lambda c, r: F.sqrt(F.pow(F.col(c) - F.col("col"), 2) + F.pow(F.col(r) - F.col("row"), 2))
    return obs.withColumns({"err_before": far("c0", "r0"), "err_after": far("c1", "r1"), "avg_residual": (F.abs(F.col("c1") - F.col("col")) + F.abs(F.col("r1") - F.col("row"))) / 2})


def reject_above(obs: DataFrame, thr: float) -> DataFrame:
    """Observations (track_id, cam_id, err) whose error is not above `thr`, of tracks that keep two or more."""
    left = obs.where(F.col("err") <= thr)
    return left.join(tracks.valid_tracks(left), "track_id", "left_semi")


def rejected(obs: DataFrame, left: DataFrame) -> DataFrame:
    """One row: observations and tracks that went, and their shares."""
    count = lambda d, s: d.agg(F.count("*").alias(f"o{s}"), F.countDistinct("track_id").alias(f"t{s}"))
    both = count(obs, 0).crossJoin(count(left, 1))  # one row each
    gone = lambda k: F.col(f"{k}0") - F.col(f"{k}1")
    return both.select(gone("o").alias("n_obs"), F.try_divide(100.0 * gone("o"), F.col("o0")).alias("obs_percent"), gone("t").alias("n_tracks"), F.try_divide(100.0 * gone("t"), F.col("t0")).alias("tracks_percent"))


def fit_errors(samples: DataFrame) -> DataFrame:
    """`samples` (col, row and the fitted model's col_fit, row_fit) with `err`."""
    return samples.withColumn("err", F.sqrt(F.pow(F.col("col_fit") - F.col("col"), 2) + F.pow(F.col("row_fit") - F.col("row"), 2)))


def cameras_before(dates: DataFrame) -> DataFrame:
    """Dates (scene, date_idx, n_images) with `first`: the number of the date's first camera where cameras
    are counted date by date."""
    w = W.partitionBy("scene").orderBy("date_idx").rowsBetween(W.unboundedPreceding, -1)
    return dates.withColumn("first", F.coalesce(F.sum("n_images").over(w), F.lit(0)))


def adjusted_before(timeline: DataFrame, outputs: DataFrame, at: int) -> DataFrame:
    """`timeline` (date_idx, date_id) with `adjusted`: the date has outputs (date_id) and stands before `at`."""
    made = outputs.select("date_id").distinct().withColumn("made", F.lit(True))
    return timeline.join(made, "date_id", "left").withColumn("adjusted", F.coalesce("made", F.lit(False)) & (F.col("date_idx") < at)).drop("made")


def images_of_dates(images: DataFrame, timeline: DataFrame, chosen: DataFrame) -> DataFrame:
    """Images (image_id, date_id) of the chosen dates (date_idx), numbered date by date, those of dates
    that are adjusted first; timeline (date_idx, date_id, adjusted)."""
    t = timeline.join(chosen, "date_idx", "left_semi")
    own = images.join(t, "date_id")
    return ranked(own, [F.desc("adjusted"), F.asc("date_idx"), F.asc("image_id")]).withColumn("cam_id", F.col("rank") - 1).drop("rank")


def selected_dates(timeline: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The dates (date_idx, ts) from `first` to `last`, both included; no bound takes all."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col("ts") >= F.lit(first).cast("timestamp"))
    if last is not None:
        keep = keep & (F.col("ts") <= F.lit(last).cast("timestamp"))
    return timeline.where(keep)
