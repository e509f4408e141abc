"""Camera geometry over tables: localisation, triangulation, model fits.

Numpy runs inside Arrow batches; Spark deals out the rows. Models (cam_id and the columns of a
sensor model) are rows like others and are joined by camera.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cameras, kernels

FIELDS = [f"{k}_{s}" for k in ("row", "col", "lat", "lon", "alt") for s in ("off", "scale")] + [f"{k}_{s}" for k in ("row", "col") for s in ("num", "den")]


def _model(row: pd.Series, prefix: str = "") -> dict:
    return {f: np.asarray(row[prefix + f], float) if f.endswith(("num", "den")) else float(row[prefix + f]) for f in FIELDS}


def _models(rows: pa.RecordBatch, prefix: str = "") -> dict:
    """A model for each row, for the kernels: an Arrow batch may hold as many cameras as rows."""
    own = lambda f: rows.column(prefix + f)
    return {f: own(f).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(cameras.BASIS)) if f.endswith(("num", "den")) else _numbers(rows, prefix + f) for f in FIELDS}


def _numbers(rows: pa.RecordBatch, column: str) -> np.ndarray:
    return rows.column(column).to_numpy(zero_copy_only=False).astype(float)


def _with_models(rows: DataFrame, models: DataFrame, cam: str = "cam_id", prefix: str = "") -> DataFrame:
    return rows.join(models.select(F.col("cam_id").alias(cam), *[F.col(f).alias(prefix + f) for f in FIELDS]), cam)


def localize(points: DataFrame, models: DataFrame) -> DataFrame:
    """Points (cam_id, id, col, row, alt) with their lon and lat."""

    def run(parts):
        for rows in parts:
            at = [_numbers(rows, c) for c in ("col", "row", "alt")]
            lon, lat = kernels.localize(_models(rows), *at)
            yield pa.RecordBatch.from_arrays([rows.column("cam_id"), rows.column("id"), *map(pa.array, (*at, lon, lat))], names=["cam_id", "id", "col", "row", "alt", "lon", "lat"])

    own = points.select(*[F.col(c).cast("long").alias(c) for c in ("cam_id", "id")], "col", "row", "alt")
    return _with_models(own, models).mapInArrow(run, "cam_id long, id long, col double, row double, alt double, lon double, lat double")


def project(points: DataFrame, models: DataFrame) -> DataFrame:
    """Points (cam_id, id, lon, lat, alt) with col and row."""

    def run(parts):
        for rows in parts:
            seen = kernels.project(_models(rows), *[_numbers(rows, c) for c in ("lon", "lat", "alt")])
            yield pa.RecordBatch.from_arrays([rows.column("cam_id"), rows.column("id"), *map(pa.array, seen)], names=["cam_id", "id", "col", "row"])

    own = points.select(*[F.col(c).cast("long").alias(c) for c in ("cam_id", "id")], "lon", "lat", "alt")
    return _with_models(own, models).mapInArrow(run, "cam_id long, id long, col double, row double")


def triangulate(matches: DataFrame, models: DataFrame) -> DataFrame:
    """Matches (track_id, cam_i, cam_j, ci, ri, cj, rj) as ECEF points with their miss in pixels;
    a track's point is the mean over its pairs."""

    def run(parts):
        for pdf in parts:
            out = []
            for _, g in pdf.groupby(["cam_i", "cam_j"]):
                a, b = _model(g.iloc[0], "i_"), _model(g.iloc[0], "j_")
                h, miss = kernels.height(a, b, g["ci"].to_numpy(), g["ri"].to_numpy(), g["cj"].to_numpy(), g["rj"].to_numpy())
                x, y, z = kernels.ecef(*kernels.localize(a, g["ci"], g["ri"], h), h)
                out.append(pd.DataFrame({"track_id": g["track_id"], "x": x, "y": y, "z": z, "miss": miss}))
            if out:
                yield pd.concat(out)

    rows = _with_models(_with_models(matches, models, "cam_i", "i_"), models, "cam_j", "j_")
    points = rows.mapInPandas(run, "track_id long, x double, y double, z double, miss double")
    return points.groupBy("track_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.avg("miss").alias("miss"), F.count("*").alias("pairs"))


def _fit_schema() -> str:
    return "cam_id long, " + ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in FIELDS) + ", rmse double"


def fit_models(samples: DataFrame) -> DataFrame:
    """Sensor models from samples (cam_id, lon, lat, alt, col, row); a camera's samples are a grid
    of fixed size (10 x 10 x 10 by default), so a camera is one small group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = kernels.fit_rpc(*(pdf[c] for c in ("lon", "lat", "alt", "col", "row")))
        e = kernels.project(m, pdf["lon"], pdf["lat"], pdf["alt"]) - pdf[["col", "row"]].to_numpy().T
        return pd.DataFrame([{"cam_id": pdf["cam_id"].iloc[0], **{f: m[f].tolist() if f.endswith(("num", "den")) else float(m[f]) for f in FIELDS}, "rmse": float(np.sqrt((e**2).mean()))}])

    return samples.groupBy("cam_id").applyInPandas(fit, _fit_schema())


def grid(models: DataFrame, n: int = 10, margin: float = 0.0) -> DataFrame:
    """(cam_id, id, col, row, alt): an n x n x n grid over each model's image, `margin` pixels beyond it on
    all sides, and its heights."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = models.select("cam_id", *[f"{k}_{s}" for k in ("col", "row", "alt") for s in ("off", "scale")], at.alias("a"))
    g = g.select("*", at.alias("b")).select("*", at.alias("c"))
    place = lambda k, i: F.col(f"{k}_off") + (F.col(f"{k}_scale") + (0.0 if k == "alt" else float(margin))) * (2 * F.col(i) / (n - 1) - 1)
    return g.select("cam_id", ((F.col("a") * n + F.col("b")) * n + F.col("c")).cast("long").alias("id"), place("col", "a").alias("col"), place("row", "b").alias("row"), place("alt", "c").alias("alt"))


def refit(models: DataFrame, n: int = 10) -> DataFrame:
    """Each model fitted again to its own grid: samples by localisation, then the fit."""
    return fit_models(localize(grid(models, n), models))


def transfer(points: DataFrame, models: DataFrame) -> DataFrame:
    """Points (id, cam_i, cam_j, col, row, alt) of image i as (id, cam_j, col, row) where j sees the same
    ground; a batch goes through numpy at once, whatever its pairs."""

    def run(parts):
        for rows in parts:
            col, row, alt = (_numbers(rows, c) for c in ("col", "row", "alt"))
            seen = kernels.project(_models(rows, "j_"), *kernels.localize(_models(rows, "i_"), col, row, alt), alt)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("cam_j"), *map(pa.array, seen)], names=["id", "cam_j", "col", "row"])

    own = points.select(*[F.col(c).cast("long").alias(c) for c in ("id", "cam_i", "cam_j")], "col", "row", "alt")
    rows = _with_models(_with_models(own, models, "cam_i", "i_"), models, "cam_j", "j_")
    return rows.mapInArrow(run, "id long, cam_j long, col double, row double")


def rescaled(models: DataFrame, alpha: float) -> DataFrame:
    """The models of images that are zoomed by alpha."""
    return models.withColumns({f"{k}_{s}": F.col(f"{k}_{s}") * alpha for k in ("row", "col") for s in ("off", "scale")})


PARAMS = ("roll", "pitch", "yaw", "t0", "t1", "t2", "fx", "fy", "skew", "cx", "cy")


def decomposed(matrices: DataFrame, kind: str) -> DataFrame:
    """What matrices (cam_id, p: 3 rows of 4) are made of: angles, translation, calibration, and the
    camera's centre (ECEF). An affine one has no t2, cx, cy and no centre (nulls)."""
    if kind not in ("affine", "perspective"):
        raise ValueError(f"unknown camera model: {kind}")

    def angles(r: np.ndarray) -> list[float]:
        s = np.hypot(r[0, 0], r[1, 0])
        roll, yaw = (np.arctan2(-r[1, 2], r[1, 1]), 0.0) if s < 1e-6 else (np.arctan2(r[2, 1], r[2, 2]), np.arctan2(r[1, 0], r[0, 0]))
        return [roll, np.arctan2(-r[2, 0], s), yaw]

    def one(p: np.ndarray) -> list[float]:
        if kind == "affine":
            k, r, t = kernels.decompose_affine(p)
            return [*angles(r), *t, np.nan, k[0, 0], k[1, 1], k[0, 1], *[np.nan] * 5]
        k, r, t, c = kernels.decompose_perspective(p)
        k = k / k[2, 2]
        return [*angles(r), *t, k[0, 0], k[1, 1], k[0, 1], k[0, 2], k[1, 2], *c]

    names = [*PARAMS, "cx_", "cy_", "cz_"]

    def run(parts):
        for pdf in parts:
            rows = [one(np.array([list(r) for r in p], float)) for p in pdf["p"]]
            out = pd.DataFrame(np.array(rows, float).reshape(-1, len(names)), columns=names)
            yield pd.concat([pdf[["cam_id"]].reset_index(drop=True), out], axis=1)

    kind_ = matrices.schema["cam_id"].dataType.simpleString()
    found = matrices.select("cam_id", "p").mapInPandas(run, f"cam_id {kind_}, " + ", ".join(f"{c} double" for c in names))
    return found.select("cam_id", *PARAMS, F.col("cx_").alias("cx_ecef"), F.col("cy_").alias("cy_ecef"), F.col("cz_").alias("cz_ecef"))


def approximated(models: DataFrame, n: int = 10) -> DataFrame:
    """(cam_id, p, worst): the perspective matrix nearest to each model over its own grid of n x n x n
    points, and its largest miss in pixels. With `decomposed` it gives the camera's centre."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = kernels.ecef(pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), pdf["alt"].to_numpy()).T
        p = kernels.camera_matrix(x, pdf[["col", "row"]].to_numpy())
        h = np.c_[x, np.ones(len(x))] @ p.T
        worst = np.linalg.norm(h[:, :2] / h[:, 2:] - pdf[["col", "row"]].to_numpy(), axis=1).max()
        return pd.DataFrame([{"cam_id": pdf["cam_id"].iloc[0], "p": p.tolist(), "worst": float(worst)}])

    return localize(grid(models, n), models).groupBy("cam_id").applyInPandas(fit, "cam_id long, p array<array<double>>, worst double")


def covered(samples: DataFrame, crops: DataFrame) -> DataFrame:
    """(cam_id, covered): whether the hull of each camera's image points (cam_id, col, row) holds its whole
    crop: a convex area holds a rectangle where it holds the four corners."""
    from .polygons import hulls

    h = hulls(samples.select("cam_id", F.col("col").alias("x"), F.col("row").alias("y")), "cam_id")
    ring = h.groupBy("cam_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"))  # a hull of one grid
    c = ring.join(crops, "cam_id")
    side = lambda a, b, p, q: (b["x"] - a["x"]) * (q - a["y"]) - (b["y"] - a["y"]) * (p - a["x"])
    inside = lambda p, q: F.forall(F.zip_with("r", F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)), lambda a, b: side(a, b, p, q) >= 0), lambda v: v)
    ends = [(F.col("col0") + a * F.col("width"), F.col("row0") + b * F.col("height")) for a in (0, 1) for b in (0, 1)]
    all_in = inside(*ends[0])
    for e in ends[1:]:
        all_in = all_in & inside(*e)
    return c.select("cam_id", (all_in & (F.size("r") > 2)).alias("covered"))


def affine_approximated(models: DataFrame) -> DataFrame:
    """(cam_id, p): the affine matrix with each model's value and derivatives at the middle of its ground."""

    def run(parts):
        for pdf in parts:
            p = [kernels.affine_approximation(_model(r), r["lon_off"], r["lat_off"], r["alt_off"])[:3] for _, r in pdf.iterrows()]
            yield pd.DataFrame({"cam_id": pdf["cam_id"], "p": [[list(map(float, v)) for v in m] for m in p]})

    return models.select("cam_id", *FIELDS).mapInPandas(run, "cam_id long, p array<array<double>>")


def epipolar_lines(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Pairs (cam_i, cam_j) with `f`: the nine numbers of x_j' F x_i = 0, of both models' affine
    approximations at the middle of image i's ground."""

    def run(parts):
        for pdf in parts:
            out = []
            for _, r in pdf.iterrows():
                a, b = _model(r, "i_"), _model(r, "j_")
                p = [kernels.affine_approximation(m, a["lon_off"], a["lat_off"], a["alt_off"]) for m in (a, b)]
                # about that ground point, so that the numbers stay small
                x = kernels.ecef(a["lon_off"], a["lat_off"], a["alt_off"])
                two = [np.vstack([np.c_[m[:2, :3], m[:2, :3] @ x + m[:2, 3]], [0, 0, 0, 1]]) for m in p]
                f = kernels.fundamental(*two)
                out.append((f / np.abs(f).max()).ravel().tolist())
            yield pdf[["cam_i", "cam_j"]].assign(f=out)

    rows = _with_models(_with_models(pairs.select("cam_i", "cam_j"), models, "cam_i", "i_"), models, "cam_j", "j_")
    return rows.mapInPandas(run, "cam_i long, cam_j long, f array<double>")
