"""The whole refinement: from matches and sensor models to corrected models.

Stages, each a table in and a table out: pairs are qualified by the caller, matches are linked
into tracks, tracks are triangulated, cameras and points are refined robustly, and each camera's
correction is fitted into a new sensor model over the ground that its own grid covers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, poses, rotation
from ..operators import geometry, graph, outliers, solve, summaries, tracks
from ..session import kept
from .incremental import robust


@dataclass(frozen=True)
class Config:
    """What a run may set; the defaults are the method's."""

    select: int = 0  # spanning trees of tracks to keep, 0: all tracks
    priority: tuple[str, ...] = ("length", "scale", "cost")  # what makes a track better
    clean_outliers: bool = True
    fixed: frozenset[int] = frozenset()
    fix_reference: bool = False  # hold the camera that most others have tracks in common with
    reference_weight: float = 1.0  # and let its observations count so much
    most_first_error: float | None = None  # observations above it at the start go
    fit_grid: int = 10
    solver: solve.Settings = field(default_factory=solve.Settings)


def starting(models: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """What the solver starts from: the sensor models, or the parameters of the matrices nearest to them."""
    if kind == "rpc":
        return models
    p = geometry.affine_approximated(models) if kind == "affine" else geometry.approximated(models, n)
    names = ("roll", "pitch", "yaw", "t0", "t1", "fx", "fy", "skew") if kind == "affine" else geometry.PARAMS
    return geometry.decomposed(p, kind).select("cam_id", F.array(*names).alias("theta"))


def camera_centres(models: DataFrame, n: int = 10) -> DataFrame:
    """(cam_id, cx, cy, cz): where the perspective cameras nearest to the models stand."""
    c = geometry.decomposed(geometry.approximated(models, n), "perspective")
    return c.select("cam_id", *[F.col(f"c{k}_ecef").alias(f"c{k}") for k in "xyz"])


def track_table(matches: DataFrame, keypoints: DataFrame) -> DataFrame:
    """(track_id, cam_id, kp_id, col, row, scale) for matches (cam_i, cam_j, kp_i, kp_j)."""
    t = tracks.tracks_from_matches(matches, graph.connected_components)
    return t.join(keypoints.select("cam_id", "kp_id", "col", "row", "scale"), ["cam_id", "kp_id"])


def matrices(spark: SparkSession, images: DataFrame, params: dict[int, np.ndarray], kind: str) -> DataFrame:
    """(image_id, p, col0, row0, width, height) for `files.matrix_json`: the matrices of perspective or affine
    parameters by camera; images (cam_id, image_id, col0, row0, width, height)."""
    rows = [(int(k), [float(x) for x in v]) for k, v in params.items()]
    t = spark.createDataFrame(rows, "cam_id long, theta array<double>").select("cam_id", *[F.col("theta")[i].alias(f"t{i}") for i in range(solve.Settings(kind=kind).size)])
    c = [F.col(f"t{i}") for i in range(solve.Settings(kind=kind).size)]
    r = rotation.euler_to_matrix(*c[:3])
    p = poses.affine_matrix(r, c[3:5], c[5:8]) if kind == "affine" else poses.perspective_matrix(r, c[3:6], c[6:11])
    p = t.select("cam_id", F.array(*[F.array(*row) for row in p]).alias("p"))
    return p.join(images.select("cam_id", "image_id", "col0", "row0", "width", "height"), "cam_id").drop("cam_id")


def first_points(obs: DataFrame, pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Triangulated tracks: the mean over the track's pairs that `pairs` (cam_i, cam_j) holds."""
    i, j = (obs.select("track_id", F.col("cam_id").alias(f"cam_{k}"), F.col("col").alias(f"c{k}"), F.col("row").alias(f"r{k}")) for k in "ij")
    m = i.join(j, "track_id").where("cam_i < cam_j").join(pairs, ["cam_i", "cam_j"], "left_semi")
    return geometry.triangulate(m.select("track_id", "cam_i", "cam_j", "ci", "ri", "cj", "rj"), models)


def corrected_models(models: DataFrame, centres: DataFrame | None, params: dict[int, np.ndarray], n: int = 10, kind: str = "rpc", drift: tuple[float, float, float] | None = None) -> DataFrame:
    """Models fitted to what the corrected cameras see of their own ground grids, less the `drift` that the
    refinement gave all points; `margin` is how far a grid had to reach beyond its image until its
    points covered the whole of it."""
    spark = models.sparkSession
    theta = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in params.items()], "cam_id long, theta array<double>")
    crops = models.select("cam_id", *[(F.col(f"{k}_off") - F.col(f"{k}_scale")).alias(f"{k}0") for k in ("col", "row")], (2 * F.col("col_scale")).alias("width"), (2 * F.col("row_scale")).alias("height"))
    shift = np.zeros(3) if drift is None else np.array(drift, float)

    def see(parts):
        for pdf in parts:
            for _, g in pdf.groupby("cam_id"):
                one = g.iloc[0]
                x = kernels.ecef(g["lon"].to_numpy(), g["lat"].to_numpy(), g["alt"].to_numpy()).T + shift
                at = solve._see(geometry._model(one), x, np.array(one["theta"], float), np.array([one["cx"], one["cy"], one["cz"]]) if kind == "rpc" else None, kind)
                yield pd.DataFrame({"cam_id": g["cam_id"], "lon": g["lon"], "lat": g["lat"], "alt": g["alt"], "col": at[:, 0], "row": at[:, 1]})

    left, done, margin = models, None, 10.0
    while True:
        ground = geometry.localize(geometry.grid(left, n, margin), left)
        rows = geometry._with_models(ground.select("cam_id", "id", "lon", "lat", "alt"), left).join(theta, "cam_id")
        rows = rows.join(centres, "cam_id") if kind == "rpc" else rows.withColumns({c: F.lit(0.0) for c in ("cx", "cy", "cz")})
        samples = kept(rows.mapInPandas(see, "cam_id long, lon double, lat double, alt double, col double, row double"))
        fits = geometry.fit_models(samples).withColumn("margin", F.lit(margin))
        good = geometry.covered(samples, crops).where(F.col("covered") | F.lit(margin > 1000)).select("cam_id")
        fits = kept(fits.join(good, "cam_id", "left_semi"))
        done = fits if done is None else done.unionByName(fits)
        left = left.join(fits, "cam_id", "left_anti").join(theta, "cam_id", "left_semi")
        if left.isEmpty():
            return done
        margin *= 2


def refine(spark: SparkSession, matches: DataFrame, keypoints: DataFrame, pairs: DataFrame, models: DataFrame, centres: DataFrame, config: Config | None = None, new: DataFrame | None = None, sensors: DataFrame | None = None) -> dict:
    """Tables `models`, `points`, `obs`, the cameras' parameters `angles` and the errors before and after.

    `new` (cam_id): the cameras that are not refined yet. Tracks that none of them sees keep the points that
    the other cameras give them; they count in the errors and are not moved or selected. `sensors` (cam_id,
    sensor): tracks are selected for each sensor and for all. Without any match the models come out as
    they went in, and the errors are an empty table.
    """
    c = config or Config()
    obs = kept(track_table(matches, keypoints))
    still = None  # tracks of cameras that are refined already
    if new is not None:
        moving = kept(tracks.tracks_of(obs, new))
        still = kept(obs.join(moving, "track_id", "left_anti"))
        obs = moving
    if c.select:
        o = obs.withColumn("err", F.lit(0.0))
        chosen = tracks.select_by_sensor(o, sensors, c.select, kept, c.priority) if sensors is not None else tracks.select_tracks(obs, tracks.rank_tracks(o, c.priority), c.select, kept)
        obs = kept(obs.join(chosen, "track_id", "left_semi"))
    if still is not None:
        obs = kept(obs.unionByName(still))
    points = first_points(obs, pairs, models).where("miss IS NOT NULL AND NOT isnan(x)")
    if still is not None:
        points = points.join(still.select("track_id", F.lit(True).alias("is_fixed")).distinct(), "track_id", "left").withColumn("is_fixed", F.coalesce("is_fixed", F.lit(False)))
    points = kept(points)
    obs = kept(obs.join(points, "track_id", "left_semi").select("track_id", "cam_id", "col", "row"))
    s = c.solver
    start = starting(models, s.kind, c.fit_grid)
    start = start if s.kind == "rpc" else kept(start)
    first = {int(r.cam_id): np.zeros(s.size) if s.kind == "rpc" else np.array(r.theta, float) for r in start.select("cam_id", *(() if s.kind == "rpc" else ("theta",))).collect()}
    before = kept(solve.errors(solve._state(spark, obs, points, start, first, centres, s), s))
    if c.most_first_error is not None:
        obs = kept(summaries.reject_above(before, c.most_first_error).select("track_id", "cam_id").join(obs, ["track_id", "cam_id"]))
    fixed = set(c.fixed)
    if c.fix_reference:
        reference = tracks.reference_camera(obs.withColumn("err", F.lit(0.0)), 1).first()
        if reference is not None:
            fixed.add(int(reference.cam_id))
            obs = obs.withColumn("weight", F.when(F.col("cam_id") == reference.cam_id, float(c.reference_weight)).otherwise(1.0))
    if c.clean_outliers:
        (params, moved, _), obs = robust(spark, obs, points, start, centres, kept, fixed, s)
    else:
        params, moved, _ = solve.adjust(spark, obs, points, start, centres, kept, fixed, s)
    after = solve.errors(solve._state(spark, obs, moved, start, params, centres, s), s)
    both = before.withColumnRenamed("err", "before").join(after.withColumnRenamed("err", "after"), ["track_id", "cam_id"])
    drift = points.join(moved.select("track_id", *[F.col(k).alias(f"{k}1") for k in "xyz"]), "track_id")
    shift = outliers.drift(drift).first()
    d = None if fixed or shift["dx"] is None else (shift["dx"], shift["dy"], shift["dz"])
    return {"angles": params, "points": moved, "obs": obs, "drift": d, "errors": summaries.before_after(both), "first": first, "models": corrected_models(models, centres, params, c.fit_grid, s.kind, d)}
