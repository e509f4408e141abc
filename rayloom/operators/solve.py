"""Robust least squares over cameras and points, one Schur complement a step.

Unknowns are the points and, of each free camera, what the settings name: its rotation R, its
translation T, its calibration K, or one calibration for all (COMMON_K). A camera is a sensor model
whose world is turned about the camera's centre and moved (rpc), or a perspective or an affine
projection. A step eliminates every point where its observations are: sorted tracks stream through
numpy, camera by camera and then in segments, and each batch returns its share of the reduced camera
system, summed by camera pair before it is shuffled. Up to `DENSE` unknowns the driver solves it
densely; a larger one stays a table of blocks, as many as pairs of cameras with a track in
common, and is solved by conjugate gradients with joins and aggregations (`solve_in_spark`): then
the driver sees a few numbers an iteration, and of each camera its own step. Damping is that of
Levenberg and Marquardt, or follows from a trust radius with bounds on parameters (`Settings.trust`); the loss is
squared or soft L1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from .geometry import FIELDS, _model

#: Places of R, T and K in a camera's parameters, by kind.
LAYOUT = {
    "rpc": {"R": range(3), "T": range(3, 6), "K": range(0)},
    "perspective": {"R": range(3), "T": range(3, 6), "K": range(6, 11)},
    "affine": {"R": range(3), "T": range(3, 5), "K": range(5, 8)},
}
COMMON, DENSE, SMALL = -2, 6000, 64 << 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 30
    ftol: float = 1e-4
    soft: bool = False
    f_scale: float = 1.0
    first_damping: float = 1e-3
    kind: str = "rpc"
    correct: tuple[str, ...] = ("R",)
    dense: int = DENSE  # more unknowns of cameras than this are solved for by Spark
    trust: bool = False  # steps by a trust radius in place of a damping that follows success
    first_radius: float | None = None  # None: the length of the first step
    evaluations: int = 300  # of the cost, at most
    bounds: tuple[tuple[int, float, float], ...] = ()  # (place in a camera's parameters, least, most), with `trust`

    def __post_init__(self):
        if self.kind not in LAYOUT:
            raise ValueError(f"unknown camera model: {self.kind}")
        if not self.correct or set(self.correct) - {"R", "T", "K", "COMMON_K"} or {"K", "COMMON_K"} <= set(self.correct):
            raise ValueError(f"cannot correct {self.correct}")
        if self.bounds and not self.trust or any(not (0 <= k < self.size and lo < hi) for k, lo, hi in self.bounds):
            raise ValueError("bounds need steps by a trust radius, and are (place, least, most)")

    @property
    def own(self) -> list[int]:
        """Places of a camera's own unknowns."""
        return [i for c in ("R", "T", "K") if c in self.correct for i in LAYOUT[self.kind][c]]

    @property
    def common(self) -> list[int]:
        """Places of the unknowns that all cameras share."""
        return list(LAYOUT[self.kind]["K"]) if "COMMON_K" in self.correct else []

    @property
    def size(self) -> int:
        return max(max(r, default=-1) for r in LAYOUT[self.kind].values()) + 1


def _turn(e: np.ndarray) -> np.ndarray:
    (cr, cp, cy), (sr, sp, sy) = np.cos(e), np.sin(e)
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])


def _see(model: dict | None, x: np.ndarray, theta: np.ndarray, centre: np.ndarray | None, kind: str = "rpc") -> np.ndarray:
    """(n, 2) images of points (n, 3) by a camera of parameters theta; angles alone move nothing."""
    r = _turn(theta[:3])
    if kind == "rpc":
        t = theta[3:6] if len(theta) > 3 else 0.0
        return kernels.project(model, *kernels.geodetic(*((x - t - centre) @ r.T + centre).T)).T
    y = x @ r.T
    if kind == "affine":
        (t0, t1), (fx, fy, skew) = theta[3:5], theta[5:8]
        return np.stack([fx * (y[:, 0] + t0) + skew * (y[:, 1] + t1), fy * (y[:, 1] + t1)], axis=1)
    fx, fy, skew, cx, cy = theta[6:11]
    u, v, w = (y + theta[3:6]).T
    return np.stack([fx * u / w + skew * v / w + cx, fy * v / w + cy], axis=1)


def _blocks(pdf: pd.DataFrame, s: Settings) -> tuple[np.ndarray, ...]:
    """Residuals (n, 2), weighted, their derivatives by the camera's parameters (n, 2, size) and by points
    (n, 2, 3; none where the point is fixed), and the weights: camera by camera."""
    n = len(pdf)
    r, jc, jx = np.zeros((n, 2)), np.zeros((n, 2, s.size)), np.zeros((n, 2, 3))
    weight = pdf["weight"].to_numpy(float)
    wanted = sorted({*s.own, *s.common})
    for _, rows in pdf.reset_index(drop=True).groupby("cam_id"):
        i, one = rows.index.to_numpy(), rows.iloc[0]
        m, c = (_model(one), np.array([one["cx"], one["cy"], one["cz"]])) if s.kind == "rpc" else (None, None)
        th = np.array(one["theta"], float)
        x = rows[["x", "y", "z"]].to_numpy(float)
        see = lambda x, th, m=m, c=c: _see(m, x, th, c, s.kind)
        f = see(x, th)
        r[i] = f - rows[["col", "row"]].to_numpy(float)
        for k in wanted:
            step = (1e-8 if s.kind == "rpc" else 1e-7) if k < 3 else (0.1 if s.kind == "rpc" else 1e-6 * max(1.0, abs(th[k])))
            jc[i, :, k] = (see(x, th + step * np.eye(s.size)[k]) - f) / step
        for k in range(3):
            step = 0.1 if s.kind == "rpc" else 1e-6 * max(1.0, np.abs(x).max())
            jx[i, :, k] = (see(x + step * np.eye(3)[k], th) - f) / step
    jx[pdf["is_fixed"].to_numpy(bool)] = 0.0
    return r * weight[:, None], jc * weight[:, None, None], jx * weight[:, None, None], weight


def _state(spark: SparkSession, obs: DataFrame, points: DataFrame, models: DataFrame, params: dict[int, np.ndarray], centres: DataFrame | None, s: Settings | None = None, dealt: bool = False) -> DataFrame:
    """Observations with their points, weights, models and parameters; `dealt`: whole tracks stand together, in
    order. A model is as wide as 80 observations: where all models fit in `SMALL` bytes they are joined by
    broadcast behind the exchange, so that none of them is shuffled with the observations."""
    s = s or Settings()
    full = lambda v: [float(x) for x in np.r_[v, np.zeros(s.size - len(v))]]
    a = spark.createDataFrame([(int(k), full(v)) for k, v in params.items()], "cam_id long, theta array<double>")
    weight = F.col("weight").cast("double") if "weight" in obs.columns else F.lit(1.0)
    still = F.col("is_fixed") if "is_fixed" in points.columns else F.lit(False)
    rows = obs.select("track_id", "cam_id", "col", "row", weight.alias("weight")).join(points.select("track_id", "x", "y", "z", still.alias("is_fixed")), "track_id")
    small = len(params) * 1000 <= SMALL  # a camera's model, centre and parameters
    rows = rows.repartition("track_id") if dealt and small else rows
    at_hand = F.broadcast if small else lambda d: d
    if s.kind == "rpc":
        own = models.select("cam_id", *FIELDS).join(a.select("cam_id"), "cam_id", "left_semi")
        rows = rows.join(at_hand(own), "cam_id").join(at_hand(centres.join(a.select("cam_id"), "cam_id", "left_semi")), "cam_id")
    rows = rows.join(at_hand(a), "cam_id")
    if dealt and not small:
        rows = rows.repartition("track_id")
    return rows.sortWithinPartitions("track_id") if dealt else rows


def _loss(r2: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The loss of squared residuals, and the weight that it gives them."""
    if not s.soft:
        return r2, np.ones_like(r2)
    z = r2 / s.f_scale**2
    return 2 * s.f_scale**2 * (np.sqrt(1 + z) - 1), 1 / np.sqrt(1 + z)


def _whole_tracks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut between tracks."""
    rest = None
    for pdf in parts:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["track_id"].ne(pdf["track_id"].iloc[-1]).to_numpy() if len(pdf) else np.zeros(0, bool)
        if last.any():
            yield pdf[last].reset_index(drop=True)
        rest = pdf[~last]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _eliminated(pdf: pd.DataFrame, s: Settings, damping: float):
    """(starts of the tracks, each row's track, r, jc, jx, w, V^-1, g) of sorted rows."""
    r, jc, jx, _ = _blocks(pdf, s)
    cost, w = _loss((r**2).sum(1), s)
    track = pdf["track_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, track[1:] != track[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(track)]))
    v = np.add.reduceat(np.einsum("n,nki,nkj->nij", w, jx, jx), starts)
    v = v + damping * v * np.eye(3) + 1e-12 * np.eye(3)
    return starts, of, r, jc, jx, w, np.linalg.inv(v), cost


def _reduced(state: DataFrame, free: set[int], damping: float, s: Settings) -> DataFrame:
    """(ci, cj, block, rhs, cost) of a dealt state: the tracks' shares of the reduced system, summed by pairs of owners of
    unknowns: cameras, and COMMON. The sum of costs stands under -1."""
    width = max(len(s.own), len(s.common), 1)

    def run(parts):
        for pdf in _whole_tracks(parts):
            starts, of, r, jc, jx, w, vi, cost = _eliminated(pdf, s, damping)
            cams = pdf["cam_id"].to_numpy()
            g = np.add.reduceat(np.einsum("n,nki,nk->ni", w, jx, r), starts)
            # entries: a row's unknowns of one owner, padded with zeros
            mine = np.flatnonzero(np.isin(cams, list(free)))
            entry, owner, j = [mine], [cams[mine]], [np.pad(jc[mine][:, :, s.own], ((0, 0), (0, 0), (0, width - len(s.own))))]
            if s.common:
                entry.append(np.arange(len(cams)))
                owner.append(np.full(len(cams), COMMON))
                j.append(np.pad(jc[:, :, s.common], ((0, 0), (0, 0), (0, width - len(s.common)))))
            entry, owner, j = np.concatenate(entry), np.concatenate(owner), np.concatenate(j)
            order = np.argsort(of[entry], kind="stable")
            entry, owner, j = entry[order], owner[order], j[order]
            we = w[entry]
            wx = np.einsum("n,nki,nkj->nij", we, j, jx[entry])
            rhs = np.einsum("n,nki,nk->ni", we, j, r[entry]) - np.einsum("nij,njk,nk->ni", wx, vi[of[entry]], g[of[entry]])
            # pairs of entries of one track
            size = np.bincount(of[entry], minlength=len(starts))
            first = np.cumsum(size) - size
            a = np.repeat(np.arange(len(entry)), size[of[entry]])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[of[entry]]) - size[of[entry]], size[of[entry]]) + first[of[entry]][a]
            block = -np.einsum("nij,njk,nlk->nil", wx[a], vi[of[entry[a]]], wx[b])
            same = entry[a] == entry[b]
            u = np.einsum("n,nki,nkj->nij", we[a[same]], j[a[same]], j[b[same]])
            u = u + damping * np.where((owner[a] == owner[b])[same, None, None], u * np.eye(width), 0.0)
            block[same] += u
            pairs, at = np.unique(np.stack([owner[a], owner[b]], axis=1), axis=0, return_inverse=True)
            total = np.zeros((len(pairs), width, width))
            np.add.at(total, at.ravel(), block)
            owners, at = np.unique(owner, return_inverse=True)
            right = np.zeros((len(owners), width))
            np.add.at(right, at, rhs)
            right = dict(zip(owners.tolist(), right, strict=True))
            rows = [(-1, -1, [0.0] * width**2, [0.0] * width, float(cost.sum()))]
            rows += [(int(p), int(q), m.ravel().tolist(), right[p].tolist() if p == q else [0.0] * width, 0.0) for (p, q), m in zip(pairs.tolist(), total, strict=True)]
            yield pd.DataFrame(rows, columns=["ci", "cj", "block", "rhs", "cost"])

    parts = state.mapInPandas(run, "ci long, cj long, block array<double>, rhs array<double>, cost double")
    return parts.groupBy("ci", "cj").agg(F.array(*[F.sum(F.col("block")[i]) for i in range(width**2)]).alias("block"), F.array(*[F.sum(F.col("rhs")[i]) for i in range(width)]).alias("rhs"), F.sum("cost").alias("cost"))


def _moved(state: DataFrame, steps: dict[int, np.ndarray], damping: float, s: Settings) -> DataFrame:
    """Points of a dealt state after the cameras' step: back substitution in segments. Beside them the track's
    shares of the step's product with the gradient (`slope`) and of its squared length, each unknown
    scaled by its column of the Jacobian (`length`)."""

    def run(parts):
        for pdf in _whole_tracks(parts):
            starts, of, r, jc, jx, w, vi, _ = _eliminated(pdf, s, damping)
            d = np.array([steps.get(int(c), np.zeros(len(s.own))) for c in pdf["cam_id"]]).reshape(len(pdf), len(s.own))
            left = r + np.einsum("nki,ni->nk", jc[:, :, s.own], d)
            if s.common:
                left = left + jc[:, :, s.common] @ steps[COMMON]
            g = np.add.reduceat(np.einsum("n,nki,nk->ni", w, jx, left), starts)
            move = -np.einsum("nij,nj->ni", vi, g)
            x = pdf[["x", "y", "z"]].to_numpy(float)[starts] + move
            # what each unknown of a residual changes in it
            parts_ = [jc[:, :, s.own] * d[:, None, :], jx * move[of][:, None, :]] + ([jc[:, :, s.common] * steps[COMMON]] if s.common else [])
            change = np.concatenate(parts_, axis=2)
            slope = np.add.reduceat(w * (r * change.sum(axis=2)).sum(axis=1), starts)
            length = np.add.reduceat(w * (change**2).sum(axis=(1, 2)), starts)
            yield pd.DataFrame({"track_id": pdf["track_id"].to_numpy()[starts], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "is_fixed": pdf["is_fixed"].to_numpy(bool)[starts], "slope": slope, "length": length})

    return state.mapInPandas(run, "track_id long, x double, y double, z double, is_fixed boolean, slope double, length double")


def errors(state: DataFrame, s: Settings | None = None) -> DataFrame:
    """(track_id, cam_id, err): the reprojection error of each observation, without its weight."""
    s = s or Settings()

    def run(parts):
        for pdf in parts:
            if len(pdf):
                r, _, _, weight = _blocks(pdf, Settings(kind=s.kind))
                yield pdf[["track_id", "cam_id"]].assign(err=np.sqrt((r**2).sum(1)) / weight)

    return state.mapInPandas(run, "track_id long, cam_id long, err double")


def _cost(state: DataFrame, s: Settings) -> float:
    def run(parts):
        for pdf in parts:
            if len(pdf):
                yield pd.DataFrame({"cost": [float(_loss((_blocks(pdf, Settings(kind=s.kind))[0] ** 2).sum(1), s)[0].sum())]})

    return float(state.mapInPandas(run, "cost double").agg(F.sum("cost")).first()[0] or 0.0)


def _without(reduced: DataFrame, still: dict[int, np.ndarray], width: int) -> DataFrame:
    """The reduced system with marked unknowns held at zero."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(width, bool)
        for pdf in parts:
            blocks, rhs = [], []
            for i, j, m, b in zip(pdf["ci"], pdf["cj"], pdf["block"], pdf["rhs"], strict=True):
                r, c = still.get(int(i), none), still.get(int(j), none)
                m = np.array(m, float).reshape(width, width)
                m[r], m[:, c] = 0.0, 0.0
                if i == j:
                    m[r, r] = 1.0
                blocks.append(m.ravel().tolist())
                rhs.append(np.where(r, 0.0, np.array(b, float)).tolist())
            yield pdf.assign(block=blocks, rhs=rhs)

    return reduced.mapInPandas(run, reduced.schema)


def solve_blocks(blocks: dict[tuple[int, int], np.ndarray], rhs: dict[int, np.ndarray], sizes: dict[int, int], dense: int = DENSE) -> dict[int, np.ndarray]:
    """The step of each owner of unknowns: the system's blocks (i, j) and right sides by owner."""
    if not sizes:
        return {}
    first, n = {}, 0
    for k in sorted(sizes):
        first[k], n = n, n + sizes[k]
    b = np.zeros(n)
    for k, v in rhs.items():
        b[first[k] : first[k] + sizes[k]] += v[: sizes[k]]
    if n <= dense:
        a = np.zeros((n, n))
        for (i, j), m in blocks.items():
            a[first[i] : first[i] + sizes[i], first[j] : first[j] + sizes[j]] += m[: sizes[i], : sizes[j]]
        x = -np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        w = max(sizes.values())
        rows = np.array([[first[i] + (r if r < sizes[i] else 0) for r in range(w)] for i, _ in blocks])
        cols = np.array([[first[j] + (r if r < sizes[j] else 0) for r in range(w)] for _, j in blocks])
        m = np.stack([np.pad(v[: sizes[i], : sizes[j]], ((0, w - sizes[i]), (0, w - sizes[j]))) for (i, j), v in blocks.items()])
        scale = np.zeros(n)
        for (i, j), v in blocks.items():
            if i == j:
                scale[first[i] : first[i] + sizes[i]] = 1 / np.maximum(np.diag(v)[: sizes[i]], 1e-300)

        def times(v: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            np.add.at(out, rows, np.einsum("nij,nj->ni", m, v[cols]))
            return out

        x, r = np.zeros(n), -b
        z = scale * r
        p, rz = z, r @ z
        for _ in range(2 * n):
            ap = times(p)
            alpha = rz / max(p @ ap, 1e-300)
            x, r = x + alpha * p, r - alpha * ap
            if np.linalg.norm(r) <= 1e-10 * np.linalg.norm(b):
                break
            z = scale * r
            p, rz = z + (r @ z) / rz * p, r @ z
    return {k: x[first[k] : first[k] + sizes[k]] for k in sizes}


def solve_in_spark(reduced: DataFrame, sizes: dict[int, int], keep: Callable[[DataFrame], DataFrame], exact: float = 1e-10, most: int | None = None) -> dict[int, np.ndarray]:
    """The steps of `solve_blocks` for blocks (ci, cj, block, rhs) that stay in a table: preconditioned conjugate
    gradients. A product with the matrix is a join of the blocks with the vector on their column and a
    sum by their row; the preconditioner is the inverse of each owner's own block. Vectors are tables of
    a row an owner; each iteration brings back two scalar products. It ends at a residual of `exact` times
    the right side's, or after `most` iterations (twice the unknowns)."""
    width = max(sizes.values(), default=0)
    owners = sorted(sizes)
    if not owners:
        return {}
    spark = reduced.sparkSession
    own = spark.createDataFrame([(k, sizes[k]) for k in owners], "o long, size int")
    blocks = reduced.where("ci <> -1").join(own.select(F.col("o").alias("ci"), F.col("size").alias("si")), "ci").join(own.select(F.col("o").alias("cj"), F.col("size").alias("sj")), "cj")

    def inverted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for m, n in zip(pdf["block"], pdf["si"], strict=True):
                a = np.array(m, float).reshape(width, width)
                a = a * (np.arange(width)[:, None] < n) * (np.arange(width)[None] < n)
                out.append(np.linalg.pinv(a, hermitian=True).ravel().tolist())
            yield pd.DataFrame({"o": pdf["ci"], "inv": out})

    def times(matrix: str, vector: str, kind: str):
        """(o, v) of rows with a matrix and a vector."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    a = np.stack(pdf[matrix]).astype(float).reshape(len(pdf), width, width)
                    v = np.einsum("nij,nj->ni", a, np.stack(pdf[vector]).astype(float))
                    yield pd.DataFrame({"o": pdf[kind].to_numpy(), "v": v.tolist()})

        return run

    blocks = keep(blocks.select("ci", "cj", "block", "rhs", "si", "sj"))
    inverse = keep(blocks.where("ci = cj").select("ci", "si", "block").mapInPandas(inverted, "o long, inv array<double>"))
    zeros = F.array(*[F.lit(0.0)] * width)
    total = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(width)])
    # what stands past an owner's size is no unknown
    mask = lambda c: F.transform(c, lambda x, i: F.when(i < F.col("size"), x).otherwise(0.0))
    b = blocks.where("ci = cj").select(F.col("ci").alias("o"), "rhs").join(own, "o").select("o", F.transform(mask("rhs"), lambda x: -x).alias("r"))
    state = b.join(inverse, "o")
    z = state.select("o", "r", "inv").mapInPandas(times("inv", "r", "o"), "o long, v array<double>").withColumnRenamed("v", "z")
    state = keep(b.join(z, "o").select("o", zeros.alias("x"), "r", "z", F.col("z").alias("p")))
    dot = lambda s, u, v: F.sum(F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)).alias(s)
    rz, first = state.agg(dot("rz", "r", "z"), dot("rr", "r", "r")).first()
    add = lambda u, k, v: F.zip_with(u, v, lambda x, y: x + F.lit(k) * y)
    for _ in range(2 * sum(sizes.values()) if most is None else most):
        if not first or not rz:
            break
        ap = blocks.select("ci", "cj", "block").join(state.select(F.col("o").alias("cj"), "p"), "cj").mapInPandas(times("block", "p", "ci"), "o long, v array<double>")
        ap = ap.groupBy("o").agg(total("v").alias("v")).join(own, "o").select("o", mask("v").alias("ap"))
        step = keep(state.join(ap, "o", "left").withColumn("ap", F.coalesce("ap", zeros)))
        alpha = float(rz / max(step.agg(dot("pap", "p", "ap")).first()[0], 1e-300))
        step = step.select("o", add("x", alpha, "p").alias("x"), add("r", -alpha, "ap").alias("r"), "p")
        z = step.select("o", "r").join(inverse, "o").mapInPandas(times("inv", "r", "o"), "o long, v array<double>").withColumnRenamed("v", "z")
        step = keep(step.join(z, "o"))
        new, rr = step.agg(dot("rz", "r", "z"), dot("rr", "r", "r")).first()
        state = step.select("o", "x", "r", "z", add("z", float(new / rz), "p").alias("p"))
        rz = new
        if rr <= exact**2 * first:
            break
    return {int(r.o): np.array(r.x, float)[: sizes[r.o]] for r in state.select("o", "x").collect()}


def adjust(spark: SparkSession, obs: DataFrame, points: DataFrame, models: DataFrame, centres: DataFrame | None, keep, fixed: set[int] = frozenset(), settings: Settings | None = None):
    """(parameters by camera, points, costs): the refined scene.

    obs (track_id, cam_id, col, row, and weight where observations count unequally), points (track_id, x,
    y, z), centres (cam_id, cx, cy, cz). models: sensor models, whose parameters start from zero, or, for
    the other kinds, (cam_id, theta), the parameters to start from. `keep(df)` writes a table to the shared
    folder and reads it back, which ends each round's lineage. `fixed` cameras keep their parameters; so do
    points whose track has `is_fixed` in `points`.
    """
    s = settings or Settings()
    if s.kind == "rpc":
        params = {int(r.cam_id): np.zeros(s.size) for r in models.select("cam_id").distinct().collect()}
    else:
        params = {int(r.cam_id): np.array(r.theta, float) for r in models.select("cam_id", "theta").collect()}
    if s.common and params:
        shared = np.mean([v[s.common] for v in params.values()], axis=0)
        params = {c: _put(v, s.common, shared) for c, v in params.items()}
    damping, costs = s.first_damping, []
    free = {c for c in params if c not in fixed} if s.own else set()
    still = F.coalesce("is_fixed", F.lit(False)) if "is_fixed" in points.columns else F.lit(False)
    points = keep(points.select("track_id", "x", "y", "z", still.alias("is_fixed")))
    sizes = {c: len(s.own) for c in free} | ({COMMON: len(s.common)} if s.common else {})
    width = max(len(s.own), len(s.common), 1)

    def step(state: DataFrame, damping: float, still: dict[int, np.ndarray] | None = None) -> tuple[dict[int, np.ndarray], float] | None:
        """The step of each owner, and the cost before it; None without an observation. `still` marks
        unknowns of owners that are not to move."""
        reduced = _reduced(state, free, damping, s)
        if still:
            reduced = _without(reduced, still, width)
        if sum(sizes.values()) > s.dense:
            reduced = keep(reduced)
            cost = reduced.where("ci = -1").agg(F.sum("cost")).first()[0]
            owners = {r.ci for r in reduced.where("ci = cj AND ci <> -1").select("ci").collect()}
            steps = solve_in_spark(reduced, {k: n for k, n in sizes.items() if k in owners}, keep)
        else:
            rows = reduced.collect()  # at most `dense` squared numbers
            cost = sum(r.cost for r in rows) if rows else None
            blocks = {(r.ci, r.cj): np.array(r.block).reshape(width, width) for r in rows if r.ci != -1}
            rhs = {r.ci: np.array(r.rhs) for r in rows if r.ci == r.cj != -1}
            steps = solve_blocks(blocks, rhs, {k: n for k, n in sizes.items() if (k, k) in blocks}, s.dense)
        if s.common:
            steps.setdefault(COMMON, np.zeros(len(s.common)))
        return None if cost is None else (steps, cost)

    def taken(steps: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        out = {c: _put(v, s.own, v[s.own] + steps[c]) if c in steps else v for c, v in params.items()}
        return {c: _put(v, s.common, v[s.common] + steps[COMMON]) for c, v in out.items()} if s.common else out

    def after(state: DataFrame, steps: dict[int, np.ndarray], damping: float) -> tuple[DataFrame, float, float]:
        """The points behind the cameras' step, and the whole step's slope and squared length."""
        moved = keep(_moved(state, steps, damping, s))
        slope, length = moved.agg(F.sum("slope"), F.sum("length")).first()
        return moved.drop("slope", "length"), slope or 0.0, length or 0.0

    def cost_of(tried: dict[int, np.ndarray], moved: DataFrame) -> float:
        return _cost(_state(spark, obs, moved, models, tried, centres, s), s)

    if s.trust:
        return _by_trust(s, params, points, step, after, cost_of, lambda p, x: _state(spark, obs, x, models, p, centres, s, dealt=True))
    for _ in range(s.rounds):
        state = _state(spark, obs, points, models, params, centres, s, dealt=True)
        found = step(state, damping)
        if found is None:
            return params, points, [0.0]
        steps, costs = found[0], costs or [found[1]]
        tried = taken(steps)
        moved, _, _ = after(state, steps, damping)
        cost = cost_of(tried, moved)
        if cost < costs[-1]:
            done = (costs[-1] - cost) < s.ftol * costs[-1]
            params, points, damping = tried, moved, damping / 3
            costs.append(cost)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    return params, points, costs


def within(value: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Steps from `value` (inside its bounds) that stay inside: the step itself where it does, else three to
    choose from: as far as the first bound, turned back at each bound that it passes, and cut off there."""
    to = value + step
    if ((to >= low) & (to <= high)).all():
        return [step]
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(step > 0, (high - value) / step, np.where(step < 0, (low - value) / step, np.inf))
    inner = np.clip(0.995 * np.min(far), 0.0, 1.0)
    back = np.where(to > high, 2 * high - to, np.where(to < low, 2 * low - to, to))
    return [inner * step, np.clip(back, low, high) - value, np.clip(to, low, high) - value]


def _by_trust(s: Settings, params: dict[int, np.ndarray], points: DataFrame, step, after, cost_of, state_of) -> tuple[dict[int, np.ndarray], DataFrame, list[float]]:
    """The loop of `adjust` by a trust radius.

    A step is the least squares' one where its length (scaled by the Jacobian's columns) is inside the radius, else the one of the
    damping whose length meets it, found by Hebden's rule, a pass a trial. The radius follows
    the ratio of the cost's change to what the linear model says; steps past the bounds of a
    camera's parameters are turned back there, and the best of `within` counts; parameters that stand on a
    bound and press on it are held for the step. At most `evaluations` costs are taken.
    """
    low, high = np.full(s.size, -np.inf), np.full(s.size, np.inf)
    for k, lo, hi in s.bounds:
        low[k], high[k] = lo, hi
    own, common, zero = s.own, s.common, np.zeros(s.size)
    width = max(len(own), len(common), 1)
    costs: list[float] = []
    radius, used, damping = s.first_radius, 0, s.first_damping
    params = {c: np.clip(v, low, high) for c, v in params.items()}
    while used < s.evaluations and len(costs) <= s.rounds:
        state = state_of(params, points)
        best, tries, seen, still = None, 1e-12, [], {}
        for _ in range(8):
            found = step(state, tries, still)
            if found is not None and s.bounds:
                # what stands on a bound and would pass it is held while the others move on
                pressed = {c: _pad(((params[c] <= low) & (_put(zero, own, d) < 0) | (params[c] >= high) & (_put(zero, own, d) > 0))[own], width) for c, d in found[0].items() if c != COMMON}
                more = {c: m | still.get(c, m) for c, m in pressed.items() if (m & ~still.get(c, np.zeros(width, bool))).any()}
                if more:
                    still |= more
                    continue
            if found is None:
                return params, points, [0.0]
            moved, slope, length = after(state, found[0], tries)
            size = float(np.sqrt(length))
            best = (found[0], moved, slope, size, tries)
            costs = costs or [found[1]]
            if radius is None:
                radius = size
            if size <= 1.1 * radius and (tries <= 1e-12 or size >= 0.75 * radius):
                break
            seen.append((tries, size))
            if len(seen) == 1:
                tries = max(damping, 1e-6)
                continue
            (l1, f1), (l2, f2) = seen[-2:]
            shift = (f2 * l2 - f1 * l1) / (f1 - f2) if f1 != f2 else 1.0  # length = const / (damping + shift)
            tries = float(np.clip((l2 + max(shift, 0.0)) * f2 / radius - max(shift, 0.0), l2 / 100, max(l2, 1e-8) * 100))
        if best is None:
            break
        steps, moved, slope, size, damping = best
        # bounds: the choice of all cameras is made at once, by the cost
        choices, free = [{}, {}, {}], False
        for c, v in params.items():
            d = np.zeros(s.size)
            if c in steps:
                d[own] = steps[c]
            if common:
                d[common] = steps[COMMON]
            some = within(v, d, low, high)
            free |= len(some) > 1
            for k in range(3):
                choices[k][c] = v + some[min(k, len(some) - 1)]
        tried = []
        if not free:
            tried = [(choices[0], moved)]
        else:
            for choice in choices:
                part = {c: (choice[c] - params[c])[own] for c in steps if c != COMMON}
                if common:
                    part[COMMON] = next(iter(choice.values()))[common] - next(iter(params.values()))[common]
                    choice = {c: _put(v, common, params[c][common] + part[COMMON]) for c, v in choice.items()}
                tried.append((choice, after(state, part, damping)[0]))
        found = min(((cost_of(p, x), k) for k, (p, x) in enumerate(tried)), key=lambda f: f)
        used += len(tried)
        cost, k = found
        gain = costs[-1] - cost
        expected = damping * size**2 - slope  # of squared residuals: -2 g'p - p'Hp, where Hp = -g - damping Dp
        ratio = gain / expected if expected > 0 and not free else float(gain > 0)
        if ratio < 0.25:
            radius = 0.25 * min(size, radius)
        elif ratio > 0.75 and size >= 0.75 * radius:
            radius = 2 * radius
        if gain > 0:
            params, points = tried[k]
            costs.append(cost)
            if gain < s.ftol * costs[-2] and ratio > 0.25:
                break
        elif radius <= 1e-14 * max(size, 1e-300) or size == 0:
            break
    return params, points, costs


def _pad(mask: np.ndarray, width: int) -> np.ndarray:
    return np.pad(mask, (0, width - len(mask)))


def _put(v: np.ndarray, at: list[int], values: np.ndarray) -> np.ndarray:
    out = v.copy()
    out[at] = values
    return out

