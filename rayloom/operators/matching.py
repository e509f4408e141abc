"""Matching of keypoint descriptors between two images, and neighbours in space."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept
from .outliers import elbows


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


#: Keypoints of an image that a task holds as an array, and how many rows of them are compared at once.
BLOCK, ROWS = 16_384, 512
#: How many keypoints of a window's tile are compared at once.
TILE = 128


def _candidates(x: np.ndarray, y: np.ndarray, k: int, ok: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y) of all that can be among the `k` nearest: squared distances by one product of matrices are
    off by their rounding, so everything stays that is no farther than the k-th and twice that and nine places' rounding."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most = yy.max(initial=0.0)
    if not np.isfinite(4 * (xx + most)).all():  # numbers too large, or none
        return np.nonzero(np.ones((len(x), len(y)), bool) if ok is None else ok)
    turned, out = np.ascontiguousarray(-2.0 * y.T), []
    for lo in range(0, len(x), 64):  # what a core's cache holds
        part = slice(lo, lo + 64)
        d = x[part] @ turned
        d += yy
        d += xx[part, None]
        if ok is not None:
            d[~ok[part]] = np.inf
        rows, last = np.arange(len(d)), d.min(axis=1, initial=np.inf)
        if k == 2 and len(y):
            first = d.argmin(axis=1)
            d[rows, first] = np.inf
            last, d[rows, first] = d.min(axis=1), last
        off = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (xx[part] + most)
        reach = (np.sqrt(np.maximum(last + off, 0.0)) + 2e-9) ** 2 + off
        found = d <= reach[:, None]
        if not np.isfinite(last).all():
            found &= d < np.inf
        r, c = np.divmod(np.flatnonzero(found), max(len(y), 1))  # faster than two places at once
        out.append((r + lo, c))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def nearest(x: np.ndarray, y: np.ndarray, k: int = 2, ok: np.ndarray | None = None, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the `k` (1 or 2) nearest rows of y for each row of x, among those that the mask `ok`
    lets through. Distances count to nine places, ties by the smaller `rank` (by default the place in y)."""
    r, c = _candidates(x, y, k, ok)
    d = np.empty(len(r))
    for lo in range(0, len(r), 20_000):
        part = slice(lo, lo + 20_000)
        d[part] = np.sqrt(((x[r[part]] - y[c[part]]) ** 2).sum(axis=1)).round(9)
    order = np.lexsort((c if rank is None else rank[c], d, r))
    r, c, d = r[order], c[order], d[order]
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) if len(r) else r
    return r[place < k], c[place < k], d[place < k]


def _every(left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """The rows of `left` in turns, each with all of `right`."""
    for lo in range(0, len(left), ROWS):
        yield np.arange(lo, min(lo + ROWS, len(left))), np.arange(len(right)), None


def _meet(left: DataFrame, right: DataFrame, by: list[str], counts: DataFrame, k: int, turns: Callable = _every, block: int = BLOCK) -> DataFrame:
    """(by, kp_i, kp_j, d): of each row of `left` the `k` nearest of each block of `right` with the same `by`, both (by, kp_id,
    desc, at: numbers for `turns`). counts (by, ni, nj): how many rows either has.

    Rows are cut into blocks by a hash. Two blocks meet in one task as arrays, and `turns(left's numbers, right's)` says which
    rows are compared, by what mask. What is shuffled grows with the rows times the blocks of the other side.
    """
    n = counts.select(*by, *[F.ceil(F.col(c) / block).alias(f"__{c}") for c in ("ni", "nj")])
    keys = [*by, "__bi", "__bj"]

    def side(rows: DataFrame, own: str, other: str, mark: int) -> DataFrame:
        r = rows.where(F.col("desc").isNotNull()).join(n, by).withColumn(f"__b{own}", F.pmod(F.xxhash64("kp_id"), f"__n{own}"))
        r = r.withColumn(f"__b{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__n{other}") - 1)))
        return r.select(*keys, F.lit(mark).alias("__side"), "kp_id", "desc", "at")

    rows = side(left, "i", "j", 0).unionByName(side(right, "j", "i", 1))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__side", "kp_id")
    kind = {c: rows.schema[c].dataType.simpleString() for c in (*by, "kp_id")}
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in by], f"kp_i {kind['kp_id']}", f"kp_j {kind['kp_id']}", "d double"])

    def array(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
        one = [p.column(name) for p in parts]
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in one])
        if len({v for c in one for v in pc.unique(pc.list_value_length(c)).to_pylist()}) > 1:
            raise ValueError(f"{name} of different lengths")
        total = sum(map(len, one))
        return flat.reshape(total, len(flat) // total)

    def compared(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        (x, y), (p, q) = ([array(h, c) for h in held] for c in ("desc", "at"))
        own, other = (pa.concat_arrays([b.column("kp_id") for b in h]) for h in held)
        first = held[0][0]
        for i, j, ok in turns(p, q):
            r, c, d = nearest(x[i], y[j], k, ok, j)  # ids stand in order
            if len(r):
                same = [pa.concat_arrays([first.column(b)[:1]]).take(pa.array(np.zeros(len(r), np.int64))) for b in by]
                yield pa.RecordBatch.from_arrays([*same, own.take(pa.array(i[r])), other.take(pa.array(j[c])), pa.array(d)], names=[*by, "kp_i", "kp_j", "d"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for batch in parts:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = True
            for c in (*keys, "__side"):
                v = batch.column(c)
                new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(new)
            for lo, hi in zip(heads, [*heads[1:], len(batch)], strict=True):
                key = tuple(batch.column(c)[int(lo)].as_py() for c in keys)
                if key != at:
                    if held[0] and held[1]:
                        yield from compared(held)
                    at, held = key, ([], [])
                held[batch.column("__side")[int(lo)].as_py()].append(batch.slice(int(lo), int(hi - lo)))
        if held[0] and held[1]:
            yield from compared(held)

    return rows.mapInArrow(run, schema)


def _of_pairs(kp: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For `_meet`: the keypoints (cam_id, ...) of either image of each pair (cam_i, cam_j, ...), and their counts."""
    per = kp.groupBy("cam_id").agg(F.count("*").alias("n"))
    n = lambda c: per.select(F.col("cam_id").alias(f"cam_{c}"), F.col("n").alias(f"n{c}"))
    counts = pairs.select("cam_i", "cam_j").join(n("i"), "cam_i").join(n("j"), "cam_j")
    left, right = (pairs.join(kp.withColumnRenamed("cam_id", c), c) for c in ("cam_i", "cam_j"))
    return left, right, counts


def ratio_match(kp: DataFrame, pairs: DataFrame, ratio: float = 0.6, block: int = BLOCK) -> DataFrame:
    """Nearest descriptor of cam_j for each keypoint of cam_i, if nearer than `ratio` times the
    second nearest (strictly). kp (cam_id, kp_id, desc); pairs (cam_i, cam_j).

    All descriptors of two paired images are compared, block by block; only the two nearest of each keypoint
    and block are shuffled again. Distances count to nine places, ties by the smaller kp_j.
    """
    by = ["cam_i", "cam_j"]
    left, right, counts = _of_pairs(kp.select("cam_id", "kp_id", "desc", F.array().cast("array<double>").alias("at")), pairs.select(*by))
    two = _meet(left, right, by, counts, 2, block=block).select(*by, "kp_i", F.struct("d", "kp_j").alias("c"))
    # two rows a block of cam_j
    best = two.groupBy("cam_i", "cam_j", "kp_i").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 2).alias("t"))
    return best.where((F.size("t") == 2) & (F.col("t")[0]["d"] < ratio * F.col("t")[1]["d"])).select("cam_i", "cam_j", "kp_i", F.col("t")[0]["kp_j"].alias("kp_j"), F.col("t")[0]["d"].alias("dist"))


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """The `k` nearest matches of each pair."""
    w = W.partitionBy("cam_i", "cam_j").orderBy("dist", "kp_i", "kp_j")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def inside(points: DataFrame, box: DataFrame) -> DataFrame:
    """Points (x, y) strictly inside a box of one row (x0, x1, y0, y1)."""
    b = F.broadcast(box)  # one row
    return points.crossJoin(b).where("x > x0 and x < x1 and y > y0 and y < y1").select(points["*"])


def window_match(a: DataFrame, b: DataFrame, radius: float, most: float, by: tuple[str, ...] = ()) -> DataFrame:
    """For each keypoint of `a` the nearest descriptor of `b` within `radius` in space, if its
    distance is below `most`. Both (kp_id, x, y, desc). Points meet only where they agree in the columns `by`,
    such as the pair of images that both stand for; blocks of them are cut into strips along x and these into tiles along y, so
    that rows meet what their radius reaches on both axes."""

    def turns(p: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
        p_order, q_order = (np.argsort(a[:, 0], kind="stable") for a in (p, q))

        def reached(sorted_: np.ndarray, own: np.ndarray) -> slice:
            wide = radius + 1e-9 * (radius + np.abs(own).max())
            return slice(np.searchsorted(sorted_, own.min() - wide), np.searchsorted(sorted_, own.max() + wide, "right"))

        strip = math.ceil(math.sqrt(len(p) / TILE)) * TILE  # as many strips as tiles in each
        for at in range(0, len(p), strip):
            across = p_order[at : at + strip]
            near = q_order[reached(q[q_order, 0], p[across, 0])]
            across, near = (i[np.argsort(a[i, 1], kind="stable")] for i, a in ((across, p), (near, q)))
            ys = q[near, 1]
            for lo in range(0, len(across), TILE):
                i = across[lo : lo + TILE]
                j = near[reached(ys, p[i, 1])]
                if len(j):
                    yield i, j, (p[i, :1] - q[j, 0]) ** 2 + (p[i, 1:] - q[j, 1]) ** 2 <= radius * radius

    keys = list(by) or ["__all"]

    def rows(d: DataFrame) -> DataFrame:
        d = d if by else d.withColumn("__all", F.lit(0))
        at = F.array(F.col("x").cast("double"), F.col("y").cast("double"))
        return d.select(*keys, "kp_id", "desc", at.alias("at")).where("NOT (isnull(at[0]) OR isnull(at[1]) OR isnan(at[0]) OR isnan(at[1]))")

    left, right = rows(a), rows(b)
    counts = left.groupBy(*keys).agg(F.count("*").alias("ni")).join(right.groupBy(*keys).agg(F.count("*").alias("nj")), keys)
    m = _meet(left, right, keys, counts, 1, turns)
    best = m.groupBy(*keys, "kp_i").agg(F.min(F.struct("d", "kp_j")).alias("c"))
    return best.where(F.col("c.d") < most).select(*by, "kp_i", "c.kp_j", F.col("c.d").alias("dist"))


def epipolar_inliers(m: DataFrame, f: list[list[float]], thr: float) -> DataFrame:
    """Matches (x1, y1, x2, y2) whose larger squared distance to the epipolar lines is below thr²."""
    line = lambda m, x, y: [m[i][0] * F.col(x) + m[i][1] * F.col(y) + m[i][2] for i in range(3)]
    turned = [list(r) for r in zip(*f, strict=True)]
    dist = lambda ln, x, y: F.pow(ln[0] * F.col(x) + ln[1] * F.col(y) + ln[2], 2) / (ln[0] * ln[0] + ln[1] * ln[1])
    d = F.greatest(dist(line(f, "x1", "y1"), "x2", "y2"), dist(line(turned, "x2", "y2"), "x1", "y1"))
    return m.withColumn("d2", d).where(F.col("d2") < thr * thr)


def idw(points: DataFrame, queries: DataFrame, k: int = 8, per_cell: int = 4) -> DataFrame:
    """Inverse distance weighting of z over the `k` nearest points: points (p_id, x, y, z), queries
    (q_id, x, y). A point nearer than 1e-10 gives its own value.

    Both are dealt to the cells of a grid with about `per_cell` points a cell, and a query meets the
    points of the nine cells around it. Its k nearest are certain if they are no farther away than a
    cell's side; queries that have fewer go on with cells twice, later four times as large, until all are certain.
    """
    s = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]).first()
    q = queries.agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]).first()
    left = queries.select("q_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    if not s["n"] or q["x0"] is None:
        return left.limit(0).select("q_id", F.lit(0.0).alias("z"))
    wide, high = s["x1"] - s["x0"], s["y1"] - s["y0"]
    side = first_side = math.sqrt(wide * high * per_cell / s["n"]) or max(wide, high) * per_cell / s["n"] or 1.0
    reach = math.hypot(max(s["x1"], q["x1"]) - min(s["x0"], q["x0"]), max(s["y1"], q["y1"]) - min(s["y0"], q["y0"]))
    left, done, factor = kept(left), None, 2
    while True:
        cell = lambda c: F.floor((F.col(c) - s[f"{c[-1]}0"]) / side)  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct((cell("qx") + i).alias("gx"), (cell("qy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asked = left.select("q_id", "qx", "qy", around.alias("g")).select("q_id", "qx", "qy", "g.gx", "g.gy")
        m = asked.join(points.select("p_id", "x", "y", "z", cell("x").alias("gx"), cell("y").alias("gy")), ["gx", "gy"], "left")
        d = F.sqrt(F.pow(F.col("qx") - F.col("x"), 2) + F.pow(F.col("qy") - F.col("y"), 2)).alias("d")
        near = F.when(F.col("p_id").isNotNull(), F.struct(d, "p_id", "z")).alias("c")
        first = m.select("q_id", "qx", "qy", "gx", "gy", near).withColumn("k", F.row_number().over(W.partitionBy("q_id", "gx", "gy").orderBy(F.col("c").asc_nulls_last()))).where(F.col("k") <= k)
        best = first.groupBy("q_id", "qx", "qy").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k).alias("c"))  # k of each of nine cells
        sure = (F.size("c") == k) & (F.col("c")[k - 1]["d"] <= side) if side < reach else F.lit(True)
        step = kept(best.withColumn("sure", sure))  # the one table of a round
        done = step.where("sure").select("q_id", "c") if done is None else done.unionByName(step.where("sure").select("q_id", "c"))
        left = step.where("NOT sure").select("q_id", "qx", "qy")
        if side >= reach or left.isEmpty():
            break
        # few are left after two rounds, so that larger cells cost little
        side, factor = side * factor, 4 if factor == 2 and side > first_side else factor
    w = lambda c: 1 / F.greatest(c["d"], F.lit(1e-300))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda a, c: a + f(c))
    z = F.when(F.col("c")[0]["d"] < 1e-10, F.col("c")[0]["z"]).otherwise(total(lambda c: c["z"] * w(c)) / total(w))
    return done.select("q_id", z.alias("z"))


def consistent(matches: DataFrame, slack: float = 5.0) -> DataFrame:
    """Matches (cam_i, cam_j, xi, yi, xj, yj) whose ends are no farther apart on the ground than
    their pair's elbow plus `slack`; a pair without an elbow keeps all."""
    pair = F.concat_ws("-", "cam_i", "cam_j")
    m = matches.withColumns({"grp": pair, "err": F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))})
    e = elbows(m.select("grp", "err"))
    return m.join(e.select("grp", F.when(F.col("found"), F.col("elbow") + slack).otherwise(F.col("high")).alias("thr")), "grp").where("err <= thr").drop("grp", "thr")


def ransac(matches: DataFrame, thr: float = 0.3, trials: int = 1000, seed: int = 0) -> DataFrame:
    """Matches (cam_i, cam_j, kp_i, kp_j, x1, y1, x2, y2) that agree with the best affine epipolar
    geometry of their pair: samples of four, seeded by the pair, then one refit on the inliers.
    A pair's matches are one group; an image has `FT_kp_max` keypoints at most."""

    def fit(a: np.ndarray) -> np.ndarray:
        c = a.mean(axis=0)
        n = np.linalg.svd(a - c, full_matrices=False)[2][-1]
        return np.append(n, -n @ c)

    def off(f: np.ndarray, a: np.ndarray) -> np.ndarray:
        d = np.abs(a @ f[:4] + f[4])
        return np.maximum(d / max(np.hypot(f[0], f[1]), 1e-300), d / max(np.hypot(f[2], f[3]), 1e-300))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values(["kp_i", "kp_j"])[["x1", "y1", "x2", "y2"]].to_numpy(float)
        if len(a) < 7:
            return pdf.iloc[:0]
        draw, best = np.random.default_rng([seed, int(pdf["cam_i"].iloc[0]), int(pdf["cam_j"].iloc[0])]), None
        for _ in range(trials):
            ok = off(fit(a[draw.choice(len(a), 4, replace=False)]), a) < thr
            if best is None or ok.sum() > best.sum():
                best = ok
        f = fit(a[best]) if best.sum() >= 4 else None
        return pdf.iloc[:0] if f is None else pdf[off(f, pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)) < thr]

    cols = ["cam_i", "cam_j", "kp_i", "kp_j", "x1", "y1", "x2", "y2"]
    return matches.select(*cols).groupBy("cam_i", "cam_j").applyInPandas(run, matches.select(*cols).schema)


def fundamental(a: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix with x2' F x1 = 0 of eight matches or more (x1, y1, x2, y2): least squares over
    points moved to their centroid and scaled to a mean distance of sqrt(2), then the nearest matrix of
    rank two; None where the points of one image are all one."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        c = p.mean(axis=0)
        d = np.hypot(*(p - c).T).mean()
        if not d > 0:
            return None
        s = math.sqrt(2) / d
        return np.c_[(p - c) * s, np.ones(len(p))], np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    one, two = scaled(a[:, :2]), scaled(a[:, 2:])
    if one is None or two is None:
        return None
    rows = (two[0][:, :, None] * one[0][:, None, :]).reshape(len(a), 9)
    f = np.linalg.svd(rows, full_matrices=len(a) < 9)[2][-1].reshape(3, 3)
    u, w, v = np.linalg.svd(f)
    f = two[1].T @ (u * [w[0], w[1], 0]) @ v @ one[1]
    n = np.linalg.norm(f)
    return f / n if n > 0 else None


def line_distances(f: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The larger one of the distances of a match's two points from their epipolar lines."""
    p, q = np.c_[a[:, :2], np.ones(len(a))], np.c_[a[:, 2:], np.ones(len(a))]
    to, back = p @ f.T, q @ f
    e = np.abs((q * to).sum(axis=1))
    return np.maximum(e / np.maximum(np.hypot(to[:, 0], to[:, 1]), 1e-300), e / np.maximum(np.hypot(back[:, 0], back[:, 1]), 1e-300))


def ransac_projective(matches: DataFrame, thr: float = 0.3, trials: int = 1000, seed: int = 0, sure: float = 0.999) -> DataFrame:
    """`ransac` for the whole epipolar geometry of perspective cameras: samples of eight matches, as many as it takes to
    draw one without an outlier with a probability of `sure` at the share of inliers found so far, `trials` at
    most; then refits on the inliers until these stay. A pair with fewer than eight matches keeps none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values(["kp_i", "kp_j"])[["x1", "y1", "x2", "y2"]].to_numpy(float)
        if len(a) < 8:
            return pdf.iloc[:0]
        draw = np.random.default_rng([seed, *(abs(int(pdf[c].iloc[0])) for c in ("cam_i", "cam_j"))])
        best, wanted, k = np.zeros(len(a), bool), trials, 0
        while k < min(wanted, trials):
            k += 1
            f = fundamental(a[draw.choice(len(a), 8, replace=False)])
            ok = best if f is None else line_distances(f, a) < thr
            if ok.sum() > best.sum():
                best = ok
                share = min(ok.mean() ** 8, 1 - 1e-12)
                wanted = math.ceil(math.log(1 - sure) / math.log(1 - share)) if share > 1e-12 else trials
        f = None
        for _ in range(10):
            if best.sum() < 8:
                return pdf.iloc[:0]
            f = fundamental(a[best])
            if f is None:
                return pdf.iloc[:0]
            ok = line_distances(f, a) < thr
            if (ok == best).all():
                break
            best = ok
        return pdf[line_distances(f, pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)) < thr]

    cols = ["cam_i", "cam_j", "kp_i", "kp_j", "x1", "y1", "x2", "y2"]
    return matches.select(*cols).groupBy("cam_i", "cam_j").applyInPandas(run, matches.select(*cols).schema)


def normalized(points: DataFrame, by: str, axes: str = "xy") -> DataFrame:
    """Points moved to their group's centroid and scaled to a mean distance of sqrt(dimensions)."""
    c = points.groupBy(by).agg(*[F.avg(a).alias(f"m{a}") for a in axes])
    p = points.join(c, by).withColumn("d", F.sqrt(sum(F.pow(F.col(a) - F.col(f"m{a}"), 2) for a in axes)))
    s = p.groupBy(by).agg((math.sqrt(len(axes)) / F.avg("d")).alias("s"))
    p = p.join(s, by)
    return p.select(*[k for k in points.columns if k not in axes], *[((F.col(a) - F.col(f"m{a}")) * F.col("s")).alias(a) for a in axes])


def overlap_keypoints(kp: DataFrame, pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(cam_i, cam_j, cam_id, kp_id): the keypoints (cam_id, kp_id, x, y) of each pair that stand strictly
    inside what the boxes (cam_id, x0, x1, y0, y1) of its two images have in common."""
    b = lambda c: boxes.select(F.col("cam_id").alias(c), *[F.col(k).alias(f"{k}_{c[-1]}") for k in ("x0", "x1", "y0", "y1")])
    r = pairs.join(b("cam_i"), "cam_i").join(b("cam_j"), "cam_j")
    r = r.select("cam_i", "cam_j", F.greatest("x0_i", "x0_j").alias("x0"), F.least("x1_i", "x1_j").alias("x1"), F.greatest("y0_i", "y0_j").alias("y0"), F.least("y1_i", "y1_j").alias("y1"))
    both = r.select("*", F.explode(F.array("cam_i", "cam_j")).alias("cam_id"))
    return both.join(kp.select("cam_id", "kp_id", "x", "y"), "cam_id").where("x > x0 and x < x1 and y > y0 and y < y1").select("cam_i", "cam_j", "cam_id", "kp_id")


def epipolar_match(kp: DataFrame, pairs: DataFrame, thr: float, ratio: float, bands: int = 64) -> DataFrame:
    """For each keypoint of cam_i the nearest descriptor of cam_j among the keypoints no farther than
    `thr` from its epipolar line, if nearer than `ratio` times the second nearest, where there is one.
    kp (cam_id, kp_id, x, y, desc), pairs (cam_i, cam_j, f: 9 numbers of x_j' F x_i = 0).

    Blocks of two images meet as arrays. Axes are turned along the lines' mean direction; lines stand in order of where they
    cross the middle of the other block and are cut into `bands` or more bands, each of which meets the keypoints
    between its outermost lines. Lines across the mean direction meet them all.
    """
    line = lambda r: F.col("f")[3 * r] * F.col("x") + F.col("f")[3 * r + 1] * F.col("y") + F.col("f")[3 * r + 2]
    place = F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0))

    def turns(p: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
        long = np.hypot(p[:, 0], p[:, 1])
        unit = p / long[:, None]
        # directions of lines, not of arrows: twice the angle
        turn = np.angle(((unit[:, 0] + 1j * unit[:, 1]) ** 2).sum()) / 2
        c, s = math.cos(turn), math.sin(turn)
        across, along = q[:, 0] * c + q[:, 1] * s, q[:, 1] * c - q[:, 0] * s
        cos, sin = unit[:, 0] * c + unit[:, 1] * s, unit[:, 1] * c - unit[:, 0] * s
        steep = np.abs(cos) > 0.1
        ends = [np.where(steep, -(unit[:, 2] + sin * t) / np.where(steep, cos, 1.0), 0.0) for t in (along.min(), along.max())]
        wide = thr / np.where(steep, np.abs(cos), 1.0) + 1e-9 * (thr + np.abs(across).max() + np.abs(ends[0]) + np.abs(ends[1]))
        low, high = np.where(steep, np.minimum(*ends) - wide, -np.inf), np.where(steep, np.maximum(*ends) + wide, np.inf)
        order, at = np.lexsort((ends[0] + ends[1], ~steep)), np.argsort(across, kind="stable")
        for i in np.array_split(order, max(min(bands, len(p)), math.ceil(len(p) / ROWS))):
            j = at[np.searchsorted(across[at], low[i].min()) : np.searchsorted(across[at], high[i].max(), "right")]
            if len(j):
                off = p[i, :1] * q[j, 0]
                off += p[i, 1:2] * q[j, 1]
                off += p[i, 2:]
                yield i, j, np.abs(off, out=off) <= thr * np.sqrt(p[i, :1] * p[i, :1] + p[i, 1:2] * p[i, 1:2])

    by = ["cam_i", "cam_j"]
    left, right, counts = _of_pairs(kp.select("cam_id", "kp_id", "x", "y", "desc"), pairs.select(*by, "f"))
    usable = "NOT (exists(at, v -> isnull(v) OR isnan(v)))"
    left = left.select(*by, "kp_id", "desc", F.array(line(0), line(1), line(2)).alias("at")).where(usable).where("at[0] <> 0 OR at[1] <> 0")
    right = right.select(*by, "kp_id", "desc", place.alias("at")).where(usable)
    two = _meet(left, right, by, counts, 2, turns).select(*by, "kp_i", F.struct("d", "kp_j").alias("c"))
    t = two.groupBy(*by, "kp_i").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 2).alias("t"))  # two rows a block of cam_j
    first, second = F.col("t")[0], F.get("t", F.lit(1))
    return t.where(second.isNull() | (first["d"] < ratio * second["d"])).select(*by, "kp_i", first["kp_j"].alias("kp_j"), first["d"].alias("dist"))
