"""Areas of any shape: masks by scanline runs, pairs of boxes by cells, and overlays of polygons.

A polygon is all rings of one member (group, member, ring, i, x, y): concave rings, holes and several
parts count by the even-odd rule, so the direction of a ring is no matter. Rings close from their
last point to their first. Rings with fewer than three points, and points without a number, count nothing.

* A mask is the runs of columns that each image row has inside an area; points meet it by their row.
* Boxes meet by an equi-join on the cells of a grid of many levels: a box is at home on the level whose
  cells are as large as it is, where it stands in four cells at most, and visits the coarser levels that
  occur. The cell that holds the lower left corner of what two boxes share owns the pair, so
  pairs come once. A crowded cell is cut into blocks of its homes, which all its visitors see.
* An overlay cuts the plane into tiles. An edge carries how many polygons begin above it, less those that end: edges
  that polygons share count as one, whatever the number of polygons. A tile holds the pieces of the edges that go through it, and
  the number of polygons over its lower left corner stands for all that is below; polygons without an edge in a tile have no
  row there. Between two neighbouring ends or crossings, pieces have an order; from piece to piece the number goes
  up or down. Crowded tiles are cut in four.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept
from . import geometry, graph, polygons

BLOCK, CROWD, TURN = 1000, 1000, 0.7390851332151607
#: Columns of a mask that points and runs meet in.
SPAN = 64


def usable(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Rings without their bad points, and without rings of fewer than three."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    r = rings.where(number("x") & number("y")).select(*keys, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return r.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n >= 3").drop("__n")


def edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, u, v): the edges of rings that `keys` tell apart."""
    w = W.partitionBy(*keys).orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias
    return usable(rings, keys).select(*keys, "x", "y", nxt("x")("u"), nxt("y")("v"))


# ---- masks ----


def fill_runs(rings: DataFrame, by: str, first: str | None = None, last: str | None = None, whole: bool = False) -> DataFrame:
    """(by, row, c0, c1): the columns, both included, that each whole row has inside the rings (by, ring,
    i, x, y). Pixels on a border are inside. `first` and `last` name columns of the rings with the rows
    that are wanted; `whole`: points are moved to the nearest pixel first.

    An edge crosses the rows from its lower end to below its upper one, so each row of an area has an even
    number of crossings, whatever points it goes through; they are taken two by two from left to right. Runs of a row
    have no column in common: where one begins in the pixel that another ends in, it leaves that pixel out.
    """
    own = rings if not whole else rings.withColumns({"x": F.rint("x"), "y": F.rint("y")})
    bounds = [c for c in (first, last) if c]
    e = edges(own, [by, "ring", *bounds])
    low, high = F.ceil(F.least("y", "v")), F.ceil(F.greatest("y", "v")) - 1
    low = F.greatest(low, F.col(first).cast("long")) if first else low
    high = F.least(high, F.col(last).cast("long")) if last else high
    e = e.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    e = e.withColumn("row", F.explode(F.sequence("__low", "__high")))
    # from the lower end, so that an edge that two rings share gives the same column twice
    up = F.col("y") <= F.col("v")
    x0, y0, x1, y1 = (F.when(up, F.col(a)).otherwise(F.col(b)) for a, b in (("x", "u"), ("y", "v"), ("u", "x"), ("v", "y")))
    c = e.select(by, "row", (x0 + (F.col("row") - y0) * (x1 - x0) / (y1 - y0)).alias("c"))
    w = W.partitionBy(by, "row").orderBy("c")
    c = c.withColumns({"k": F.row_number().over(w), "next": F.lead("c").over(w), "last": F.lag("c").over(w)}).where("k % 2 = 1")
    begin = F.greatest(F.ceil("c"), F.floor("last") + 1)  # a null counts nothing
    return c.select(by, "row", begin.alias("c0"), F.floor("next").alias("c1")).where("c0 <= c1")


def masked(points: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """Points (by, col, row) whose pixel stands in a run of their group; each once. Runs meet the points of the `SPAN`s of
    columns that they reach into, so that a row of many runs costs a point no more than a short one. How many runs a small table of
    rings makes is not seen in its size, so they are never broadcast: both sides are sorted."""
    cells = F.explode(F.sequence(F.floor(F.col("c0") / SPAN), F.floor(F.col("c1") / SPAN))).alias("__cell")
    r = runs.select(F.col(by).alias("__by"), F.col("row").alias("__row"), "c0", "c1", cells)
    r = r.select("__by", "__row", "__cell", F.greatest("c0", F.col("__cell") * SPAN).alias("c0"), F.least("c1", F.col("__cell") * SPAN + SPAN - 1).alias("c1")).distinct()
    column = F.floor("col")
    at = (F.col(by) == F.col("__by")) & (F.floor("row") == F.col("__row")) & (F.floor(column / SPAN) == F.col("__cell")) & column.between(F.col("c0"), F.col("c1"))
    return points.join(r.hint("merge"), at, "left_semi")


def area_rings(area: DataFrame, crops: DataFrame, models: DataFrame) -> DataFrame:
    """(cam_id, ring, i, x, y, height): the area (ring, i, x, y in degrees) as each crop (cam_id, col0, row0,
    width, height, alt) sees it, in the crop's pixels."""
    every = crops.select("cam_id", "col0", "row0", "height", "alt").crossJoin(F.broadcast(area.select("ring", "i", "x", "y").limit(100_000)))  # an area's bound
    key = F.xxhash64("ring", "i").alias("id")
    seen = geometry.project(every.select("cam_id", key, F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("alt").cast("double").alias("alt")), models)
    at = every.select("cam_id", key, "ring", "i", "col0", "row0", "height")
    return at.join(seen.select("cam_id", "id", "col", "row"), ["cam_id", "id"]).select("cam_id", "ring", "i", (F.col("col") - F.col("col0")).alias("x"), (F.col("row") - F.col("row0")).alias("y"), "height")


def inside_area(keypoints: DataFrame, area: DataFrame, crops: DataFrame, models: DataFrame) -> DataFrame:
    """Keypoints (cam_id, col, row of a crop) that stand inside an area (ring, i, x, y in degrees)."""
    rings = area_rings(area, crops, models).withColumns({"__first": F.lit(0), "__last": F.ceil("height")})
    return masked(keypoints, fill_runs(rings, "cam_id", "__first", "__last", True), "cam_id")


# ---- pairs of boxes ----


def _cells(boxes: DataFrame, by: list[str], member: str, block: int) -> tuple[DataFrame, DataFrame, list[str], DataFrame] | None:
    """Boxes at home in the blocks of their cells and as visitors of all blocks there (m, lev, x0, x1, y0, y1, side), the key of a
    block, and the cells with their `blocks`; none where no box has a number."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = boxes.select(*by, F.col(member).alias("m"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")])
    own = own.where(F.coalesce((F.abs(size) < float("inf")) & (size >= 0), F.lit(False)))
    own = kept(own.withColumn("lev", F.ceil(F.log2(F.greatest(size, F.lit(2.0**-60)))).cast("int")), "boxes")
    levels = sorted(r.lev for r in own.select("lev").distinct().collect())  # of a double's exponents
    if not levels:
        return None
    at = own.withColumn("l", F.explode(F.array(*[F.lit(x) for x in levels]))).where("l >= lev").withColumn("side", F.pow(F.lit(2.0), F.col("l")))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / F.col("side")), F.floor(F.col(f"{c}1") / F.col("side"))))
    at = at.withColumn("cx", span("x")).withColumn("cy", span("y"))
    cell = [*by, "l", "cx", "cy"]
    homes = at.where("l = lev").groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("blocks"))
    home = at.where("l = lev").join(homes, cell).withColumn("k", F.pmod(F.xxhash64("m"), "blocks"))
    seen = at.join(homes, cell).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return home.drop("blocks"), seen.drop("blocks"), [*cell, "k"], homes


def box_pairs(boxes: DataFrame, by: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """(by, a, b): the pairs of members a < b of a group whose boxes (by, member, x0, x1, y0, y1) meet,
    borders included. Boxes without a number meet nothing."""
    found = _cells(boxes, by, member, block)
    if not found:
        return boxes.select(*by, F.col(member).alias("a"), F.col(member).alias("b")).where("false")
    home, seen, cell, _ = found
    side = lambda d, s: d.select(*cell, *[F.col(c).alias(f"{c}{s}") for c in ("m", "lev", "x0", "x1", "y0", "y1", "side")])
    p = side(home, "h").join(side(seen, "s"), cell)
    p = p.where("x0h <= x1s and x0s <= x1h and y0h <= y1s and y0s <= y1h and mh <> ms").where("levs < levh or mh < ms")
    owner = (F.floor(F.greatest("x0h", "x0s") / F.col("sideh")) == F.col("cx")) & (F.floor(F.greatest("y0h", "y0s") / F.col("sideh")) == F.col("cy"))
    return p.where(owner).select(*by, F.least("mh", "ms").alias("a"), F.greatest("mh", "ms").alias("b"))


# ---- overlays ----


def arrange(e: np.ndarray, poly: np.ndarray, weight: np.ndarray, box: tuple[float, float, float, float]) -> tuple[dict[int, float], np.ndarray]:
    """Inside a box, the area that each number of polygons covers, and the pieces of edges (edge, x, y, u, v,
    below, above: how many cover the plane on either side), joined where they go on. e: (x, y, u, v) of
    all edges of the polygons that meet the box; poly: whose they are; weight: how often one counts."""
    x0, x1, y0, y1 = box
    turn = e[:, 0] > e[:, 2]
    e = np.where(turn[:, None], e[:, [2, 3, 0, 1]], e)
    ok = (e[:, 0] < e[:, 2]) & (e[:, 2] > x0) & (e[:, 0] < x1)
    e, own = e[ok], np.flatnonzero(ok)
    at = lambda a, x: a[:, 1] + (a[:, 3] - a[:, 1]) * ((x - a[:, 0]) / (a[:, 2] - a[:, 0]))
    # cut at the sides, and where an edge passes below or above
    cuts = [np.clip(np.c_[e[:, 0], e[:, 2]], x0, x1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        for y in (y0, y1):
            c = e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
            cuts.append(np.where(np.isfinite(c), np.clip(c, *cuts[0].T), cuts[0][:, 0])[:, None])
    cuts = np.sort(np.concatenate(cuts, axis=1), axis=1)
    parts = []
    for k in range(3):
        a, b = cuts[:, k], cuts[:, k + 1]
        parts.append(np.c_[a, at(e, a), b, at(e, b), own])
    s = np.concatenate(parts) if len(e) else np.zeros((0, 5))
    s = s[s[:, 0] < s[:, 2]]
    mid = (s[:, 1] + s[:, 3]) / 2
    real = (mid > y0) & (mid < y1)
    s[:, [1, 3]] = np.clip(s[:, [1, 3]], y0, y1)
    own = s[:, 4].astype(int)
    if not len(s):
        return {}, np.zeros((0, 7))
    xs = [s[:, 0], s[:, 2]]
    rise = (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
    block = max(1, 2_000_000 // len(s))
    for lo in range(0, len(s), block):  # crossings, a block of edges at once
        a, ra = s[lo : lo + block], rise[lo : lo + block]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = ((s[None, :, 1] - rise[None] * s[None, :, 0]) - (a[:, 1] - ra * a[:, 0])[:, None]) / (ra[:, None] - rise[None])
        good = (c > np.maximum(a[:, None, 0], s[None, :, 0])) & (c < np.minimum(a[:, None, 2], s[None, :, 2]))
        xs.append(c[good])
    xs = np.unique(np.concatenate(xs))
    area: dict[int, float] = {}
    pieces: dict[int, list[list[float]]] = {}
    begin = np.argsort(s[:, 0], kind="stable")
    alive, nxt = np.zeros(0, int), 0
    near = 1e-9 * max(x1 - x0, y1 - y0)
    for a, b in zip(xs, xs[1:], strict=False):
        alive = alive[s[alive, 2] > a]
        end = nxt
        while end < len(begin) and s[begin[end], 0] <= a:
            end += 1
        alive, nxt = np.r_[alive, begin[nxt:end]], end
        if not len(alive):
            continue
        ya, yb = (s[alive, 1] + rise[alive] * (x - s[alive, 0]) for x in (a, b))
        order = np.argsort(ya + yb, kind="stable")
        edge, ya, yb = alive[order], ya[order], yb[order]
        p = poly[own[edge]]
        by_poly = np.argsort(p, kind="stable")
        head = np.flatnonzero(np.r_[True, p[by_poly][1:] != p[by_poly][:-1]])
        nth = np.arange(len(p)) - np.repeat(head, np.diff(np.r_[head, len(p)]))
        step = np.empty(len(p), np.int64)
        step[by_poly] = np.where(nth % 2 == 0, 1, -1)
        cover = np.cumsum(step * weight[own[edge]])
        y = (ya + yb) / 2
        tall = np.diff(y) * (b - a)
        for n in np.unique(cover[:-1]).tolist():
            area[n] = area.get(n, 0.0) + float(tall[cover[:-1] == n].sum())
        # edges at one height are one border
        first = np.flatnonzero(np.r_[True, np.diff(y) > near])
        last = np.r_[first[1:] - 1, len(y) - 1]
        below = np.r_[0, cover[last[:-1]]]
        for f, g, lo, hi in zip(first.tolist(), last.tolist(), below.tolist(), cover[last].tolist(), strict=True):
            k = next((i for i in range(f, g + 1) if real[edge[i]]), None)
            if k is None or lo == hi:
                continue
            run = pieces.setdefault(int(edge[k]), [])
            if run and run[-1][2] == a and run[-1][4:] == [lo, hi]:
                run[-1][2:4] = [b, yb[k]]
            else:
                run.append([a, ya[k], b, yb[k], lo, hi])
    flat = [[own[i], *r] for i, runs in pieces.items() for r in runs]
    return area, np.array(flat, float).reshape(-1, 7)


def _turned(x: str, y: str, back: bool = False):
    """Overlays are made in turned axes, where no edge of real data stands upright or on a tile's border."""
    c, s = math.cos(TURN), math.sin(TURN) * (-1 if back else 1)
    return F.col(x) * c - F.col(y) * s, F.col(x) * s + F.col(y) * c


def signed(e: np.ndarray) -> np.ndarray:
    """(x, y, u, v, d) of the edges of one polygon, from left to right: the polygon begins above an edge with
    d = 1 and ends there with d = -1. Rings that cross or touch themselves are cut where they do."""
    turn = e[:, 0] > e[:, 2]
    e = np.where(turn[:, None], e[:, [2, 3, 0, 1]], e)
    e = e[e[:, 0] < e[:, 2]]
    if not len(e):
        return np.zeros((0, 5))
    x, y, u, v = e.T
    near = 1e-9 * max(np.ptp(e[:, [0, 2]]), np.ptp(e[:, [1, 3]]))
    if len(e) <= 1000:
        rise = (v - y) / (u - x)
        over = lambda at: y + rise * (at[:, None] - x)
        mid = (x + u) / 2
        off = over(mid) - ((y + v) / 2)[:, None]
        span = (x <= mid[:, None]) & (mid[:, None] < u)
        np.fill_diagonal(span, False)
        lo, hi = np.maximum(x[:, None], x), np.minimum(u[:, None], u)
        gap = lambda at: (y + rise * (at - x)) - (y[:, None] + rise[:, None] * (at - x[:, None]))
        p, q = gap(lo), gap(hi)
        crossed = (lo < hi) & (p * q < 0) & (np.minimum(np.abs(p), np.abs(q)) > near)
        if not (crossed.any() or (span & (np.abs(off) <= near)).any()):
            return np.c_[e, 1 - 2 * ((span & (off < 0)).sum(axis=1) % 2)]
    pad = near * 1000
    _, p = arrange(e, np.zeros(len(e), int), np.ones(len(e), np.int64), (x.min() - pad, u.max() + pad, e[:, [1, 3]].min() - pad, e[:, [1, 3]].max() + pad))
    return np.c_[p[:, 1:5], p[:, 6] - p[:, 5]]


def _oriented(polys: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the `signed` edges (`e`: x, y, u, v, d) of polygons with `e`, a list of edges."""

    def run(parts):
        for pdf in parts:
            out = [[tuple(r) for r in signed(np.array([(s["x"], s["y"], s["u"], s["v"]) for s in e], float).reshape(-1, 4)).tolist()] for e in pdf["e"]]
            yield pdf[keep].assign(e=[[dict(zip("xyuvd", r, strict=True)) for r in e] for e in out])

    kinds = ", ".join(f"{c} {polys.schema[c].dataType.simpleString()}" for c in keep)
    return polys.select(*keep, "e").mapInPandas(run, f"{kinds}, e array<struct<x: double, y: double, u: double, v: double, d: double>>")


def split(p: np.ndarray, x0: np.ndarray, y0: np.ndarray, s: np.ndarray, most: int | None = None) -> dict[str, np.ndarray]:
    """Edges (x, y, u, v), from left to right, cut by the lines of grids of cells `s` from (x0, y0), into columns and
    rows up to `most`. `src`: whose piece it is; `i`, `j`: its cell; `left`: it comes in through the cell's left side; `up`,
    `down`: it begins or ends on the bottom; `head`, `tail`: it has the edge's own beginning or end. `lsrc`, `li`, `lj`: edges that cross the left
    side of column li, and the row where they do."""
    x, y, u, v = p.T
    place = lambda c, o, g: np.clip(np.floor((c - o) / g), None if most is None else 0, most).astype(np.int64)
    runs = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    i0 = place(x, x0, s)
    i1 = np.maximum(np.clip(np.ceil((u - x0) / s) - 1, None if most is None else 0, most).astype(np.int64), i0)
    src, k = runs(i1 - i0 + 1)
    i, g, ox, oy = i0[src] + k, s[src], x0[src], y0[src]
    first, last, line = i == i0[src], i == i1[src], ox + i * g
    a, b = np.where(first, x[src], line), np.where(last, u[src], ox + (i + 1) * g)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lambda c: y[src] + (v[src] - y[src]) * ((c - x[src]) / (u[src] - x[src]))
        ya, yb = np.where(first, y[src], at(a)), np.where(last, v[src], at(b))
        left = (b > a) & (a <= line)
        up, lo, hi = yb >= ya, np.minimum(ya, yb), np.maximum(ya, yb)
        j0, j1 = place(lo, oy, g), place(hi, oy, g)
        begin, end = np.where(up, j0, j1), np.where(up, j1, j0)
        q, k = runs(j1 - j0 + 1)
        j = j0[q] + k
        bottom, top = j == j0[q], j == j1[q]
        cross = lambda c: np.clip(a[q] + (c - ya[q]) / (yb[q] - ya[q]) * (b[q] - a[q]), a[q], b[q])
        low, high = oy[q] + j * g[q], oy[q] + (j + 1) * g[q]
        yl, yh = np.where(bottom, lo[q], low), np.where(top, hi[q], high)
        xl, xh = np.where(bottom, np.where(up, a, b)[q], cross(low)), np.where(top, np.where(up, b, a)[q], cross(high))
    r = up[q]
    e = np.c_[np.where(r, xl, xh), np.where(r, yl, yh), np.where(r, xh, xl), np.where(r, yh, yl)]
    return {"src": src[q], "i": i[q], "j": j, "e": e, "left": left[q] & (j == begin[q]), "up": r & ~bottom, "down": ~r & ~bottom, "head": first[q] & (j == begin[q]), "tail": last[q] & (j == end[q]), "lsrc": src[left], "li": i[left], "lj": begin[left]}


def sweep(e: np.ndarray, d: np.ndarray, up: np.ndarray, down: np.ndarray, base: float, side: float) -> np.ndarray:
    """The pieces (x, y, u, v, below, above) of edges in a tile, where the number of polygons changes. `d`: by how much it
    goes up from below an edge to above; `base`: how many polygons cover the tile's lower left corner. Along the bottom the number
    changes where an edge begins (`up`) or ends (`down`) there."""
    when = np.r_[e[up, 0], e[down, 2]]
    much = np.r_[-d[up], d[down]][np.argsort(when, kind="stable")]
    when, much = np.sort(when), np.r_[0.0, np.cumsum(much)]
    ok = e[:, 0] < e[:, 2]
    s, d = e[ok], d[ok]
    rise = (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
    xs = [s[:, 0], s[:, 2], when]
    block = max(1, 2_000_000 // max(len(s), 1))
    for lo in range(0, len(s), block):
        a, ra = s[lo : lo + block], rise[lo : lo + block]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = ((s[None, :, 1] - rise[None] * s[None, :, 0]) - (a[:, 1] - ra * a[:, 0])[:, None]) / (ra[:, None] - rise[None])
        good = (c > np.maximum(a[:, None, 0], s[None, :, 0])) & (c < np.minimum(a[:, None, 2], s[None, :, 2])) & (np.abs(ra[:, None] - rise[None]) > 1e-9)
        xs.append(c[good])
    xs = np.unique(np.concatenate(xs))
    begin, alive, nxt, near = np.argsort(s[:, 0], kind="stable"), np.zeros(0, int), 0, 1e-9 * side
    out: list[list[float]] = []
    open_: dict[int, int] = {}
    for a, b in zip(xs.tolist(), xs[1:].tolist(), strict=False):
        if b - a <= 1e-12 * side:
            continue
        alive = alive[s[alive, 2] > a]
        end = nxt
        while end < len(begin) and s[begin[end], 0] <= a:
            end += 1
        new = begin[nxt:end]
        alive, nxt = np.r_[alive, new[s[new, 2] > a]], end
        if not len(alive):
            continue
        ya, yb = (s[alive, 1] + rise[alive] * (x - s[alive, 0]) for x in (a, b))
        order = np.argsort(ya + yb, kind="stable")
        y = (ya + yb)[order] / 2
        cover = base + much[np.searchsorted(when, a, "right")] + np.cumsum(d[alive[order]])
        # edges at one height are one border
        first = np.flatnonzero(np.r_[True, np.diff(y) > near])
        last = np.r_[first[1:] - 1, len(y) - 1]
        lo, hi = np.r_[cover[0] - d[alive[order[0]]], cover[last[:-1]]], cover[last]
        for k in np.flatnonzero(lo != hi).tolist():
            o = order[first[k]]
            edge, run = int(alive[o]), open_.get(int(alive[o]))
            if run is not None and out[run][2] == a and out[run][4] == lo[k] and out[run][5] == hi[k]:
                out[run][2:4] = [b, yb[o]]
            else:
                open_[edge] = len(out)
                out.append([a, ya[o], b, yb[o], lo[k], hi[k]])
    return np.array(out, float).reshape(-1, 6)


def _merged(at: DataFrame, by: str) -> DataFrame:
    """Pieces on one line between the same ends of one tile as one piece, and a tile's bases as one row."""
    near = lambda c, o: F.round((F.col(c) - F.col(o)) / F.col("side") * 1e9).cast("long").alias(f"__{c}")
    key = [by, "tx", "ty", "side", "ox", "oy", "left", "up", "down"]
    one = at.groupBy(*key, near("x", "tx"), near("y", "ty"), near("u", "tx"), near("v", "ty")).agg(F.sum("d").alias("d"), *[F.min(c).alias(c) for c in "xyuv"])
    return one.where("d <> 0").select(*key, *"xyuv", "d")


_PIECES = "tx double, ty double, side double, ox double, oy double, left boolean, up boolean, down boolean, x double, y double, u double, v double, d double"


def _rows(g, tile: list[np.ndarray], flags: list, e: np.ndarray | None, d: np.ndarray, by: str) -> pd.DataFrame:
    """Rows of _PIECES; without `e` they are bases: what is below the tile's lower left corner."""
    cols = dict(zip(("tx", "ty", "side", "ox", "oy"), tile, strict=True)) | dict(zip(("left", "up", "down"), flags, strict=True))
    for k, c in enumerate("xyuv"):
        cols[c] = e[:, k] if e is not None else np.full(len(d), np.nan)
    out = pd.DataFrame(cols | {"d": d}, index=range(len(d)))
    out.insert(0, by, g)
    return out


def tiles(rings: DataFrame, by: str, member: str, crowd: int = CROWD, depth: int = 6) -> DataFrame:
    """(by, tx, ty, side, ox, oy, base, e): the tiles that edges go through, in turned axes from the group's lower left
    corner (ox, oy). `base` is how many polygons cover the tile's lower left corner, `e` a list of pieces
    (x, y, u, v, d, up, down) as `sweep` takes them: what is below the tile is in `base`, not in the list."""
    tx, ty = _turned("x", "y")
    r = usable(rings, [by, member, "ring"]).withColumns({"__x": tx, "__y": ty}).select(by, member, "ring", "i", F.col("__x").alias("x"), F.col("__y").alias("y"))
    flat = edges(r, [by, member, "ring"]).groupBy(by, member).agg(F.sort_array(F.collect_list(F.struct("x", "y", "u", "v"))).alias("e"))
    same = flat.withColumn("__d", F.sha2(F.to_json("e"), 256)).groupBy(by, "__d").agg(F.count("*").cast("double").alias("w"), F.first("e").alias("e"))
    end = lambda f, g, a, b: f(F.transform("e", lambda s: g(s[a], s[b])))
    box = [end(F.array_min, F.least, "x", "u").alias("x0"), end(F.array_max, F.greatest, "x", "u").alias("x1"), end(F.array_min, F.least, "y", "v").alias("y0"), end(F.array_max, F.greatest, "y", "v").alias("y1")]
    own = _oriented(same, [by, "w"]).where(F.size("e") > 0)
    own = kept(own.select(by, "w", "e", *box), "polygons")
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    extent = own.groupBy(F.col(by).alias("__by")).agg(F.avg(size).alias("mean"), F.max(size).alias("most"), F.min("x0").alias("ox"), F.min("y0").alias("oy"), F.max("x1").alias("wx"), F.max("y1").alias("wy"))
    line = own.select(by, "w", F.explode("e").alias("s")).groupBy(by, "s.x", "s.y", "s.u", "s.v").agg(F.sum(F.col("w") * F.col("s.d")).alias("d")).where("d <> 0")
    line = kept(line, "edges")
    # a side with a twentieth of a crowd of pieces a tile, were all edges spread evenly
    n = line.groupBy(F.col(by).alias("__b")).agg(F.count("*").alias("n"), F.avg(F.hypot(F.col("u") - F.col("x"), F.col("v") - F.col("y"))).alias("len"))
    grid = extent.join(n, F.col("__by").eqNullSafe(F.col("__b"))).drop("__b")
    even = (F.sqrt(F.col("len") * F.col("len") + 0.2 * crowd * (F.col("wx") - F.col("ox")) * (F.col("wy") - F.col("oy")) / F.col("n")) - F.col("len")) / 2
    grid = grid.select("__by", "ox", "oy", F.greatest(F.least("mean", even), F.col("most") / 64, F.lit(1e-300)).alias("side"))
    kind = f"{by} {rings.schema[by].dataType.simpleString()}, "
    shift = 0.3183098861837907  # of a tile, so that round numbers stand on no border

    def first(parts):
        for pdf in parts:
            g, s = pdf[by].to_numpy(), pdf["side"].to_numpy()
            ox, oy, d = (pdf[c].to_numpy() for c in ("ox", "oy", "d"))
            e = pdf[["x", "y", "u", "v"]].to_numpy() - np.c_[ox, oy, ox, oy]
            c = split(e, -shift * s, -shift * s, s)
            for q, i, j, p in ((c["src"], c["i"], c["j"], c["e"]), (c["lsrc"], c["li"], c["lj"], None)):
                flags = [c[f] for f in ("left", "up", "down")] if p is not None else [False] * 3
                yield _rows(g[q], [(i - 0.0), (j - 0.0), s[q], ox[q], oy[q]], flags, p, d[q], by)

    cut = line.join(grid, line[by].eqNullSafe(grid["__by"])).drop("__by").mapInPandas(first, kind + _PIECES)
    cut = kept(cut, "tiles")  # tx and ty are numbers of columns and rows here
    is_base = F.col("x").isNull()
    tile = [by, "side", "ox", "oy", "tx"]
    below = cut.groupBy(*tile, "ty").agg(F.sum(F.when(is_base, F.col("d")).otherwise(0.0)).alias("s"), F.max(~is_base).alias("has"))  # one row a tile
    below = below.withColumn("d", F.sum("s").over(W.partitionBy(*tile).orderBy("ty").rowsBetween(W.unboundedPreceding, -1))).where("has AND d <> 0")
    none = [F.lit(None).cast("double").alias(c) for c in "xyuv"]
    own = cut.where(~is_base).unionByName(below.select(*tile, "ty", *[F.lit(False).alias(c) for c in ("left", "up", "down")], *none, "d"))
    at = own.withColumns({"tx": (F.col("tx") - 0.0) * F.col("side") - shift * F.col("side"), "ty": F.col("ty") * F.col("side") - shift * F.col("side")})
    at = kept(_merged(at, by), "tiles")

    def quarter(parts):
        for pdf in parts:
            b = pdf[np.isnan(pdf["x"].to_numpy())]
            for i in (0, 1):
                for j in (0, 1):
                    h = b["side"].to_numpy() / 2
                    yield _rows(b[by].to_numpy(), [b["tx"].to_numpy() + i * h, b["ty"].to_numpy() + j * h, h, b["ox"].to_numpy(), b["oy"].to_numpy()], [False] * 3, None, b["d"].to_numpy(), by)
            p = pdf[~np.isnan(pdf["x"].to_numpy())]
            g, (X, Y, s, ox, oy, d) = p[by].to_numpy(), (p[c].to_numpy() for c in ("tx", "ty", "side", "ox", "oy", "d"))
            left, up, down = (p[c].to_numpy(bool) for c in ("left", "up", "down"))
            h = s / 2
            c = split(p[["x", "y", "u", "v"]].to_numpy(), X, Y, h, 1)
            q, i, j = c["src"], c["i"], c["j"]
            tile_of = lambda q, i, j: [X[q] + i * h[q], Y[q] + j * h[q], h[q], ox[q], oy[q]]  # noqa: B023, E731
            flags = [c["left"] & ((i == 1) | left[q]), c["up"] | (up[q] & c["head"]), c["down"] | (down[q] & c["tail"])]
            yield _rows(g[q], tile_of(q, i, j), flags, c["e"], d[q], by)
            k = (c["lj"] == 0) & ((c["li"] == 1) | left[c["lsrc"]])
            q = c["lsrc"][k]
            yield _rows(g[q], tile_of(q, c["li"][k], 1), [False] * 3, None, d[q], by)
            for own, where, sign in ((up, "head", -1), (down, "tail", 1)):
                q = c["src"][c[where] & own[c["src"]] & (i == 0)]
                for j in (0, 1):
                    yield _rows(g[q], tile_of(q, 1, j), [False] * 3, None, sign * d[q], by)

    done, tile = None, [by, "tx", "ty", "side", "ox", "oy"]
    for k in range(depth + 1):
        n = at.where(~is_base).groupBy(*tile).agg(F.count("*").alias("__n")).where(F.col("__n") > crowd).select(*[F.col(c).alias(f"__{c}") for c in tile[:4]])
        match = at[by].eqNullSafe(n[f"__{by}"]) & (F.col("tx") == F.col("__tx")) & (F.col("ty") == F.col("__ty")) & (F.col("side") == F.col("__side"))
        last = k == depth or n.isEmpty()
        small = at if last else at.join(n, match, "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            break
        at = kept(_merged(at.join(n, match, "left_semi").mapInPandas(quarter, kind + _PIECES), by), "tiles")
    e = F.collect_list(F.when(~is_base, F.struct(*"xyuvd", "up", "down")))
    return done.groupBy(*tile).agg(F.sum(F.when(is_base, F.col("d")).otherwise(0.0)).alias("base"), e.alias("e")).where(F.size("e") > 0)


def overlay(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(by, ox, oy, x, y, u, v, below, above): the pieces of edges between areas of a group that another number of polygons
    covers, in turned axes from the group's corner (ox, oy), and how many cover the plane on either side."""
    kind = f"{by} {rings.schema[by].dataType.simpleString()}, "

    def run(parts):
        for pdf in parts:
            for g, ox, oy, side, base, e in zip(*(pdf[c] for c in (by, "ox", "oy", "side", "base", "e")), strict=True):
                a = np.array([(s["x"], s["y"], s["u"], s["v"], s["d"], s["up"], s["down"]) for s in e], float).reshape(-1, 7)
                a = a[np.lexsort(a.T[::-1])]
                p = sweep(a[:, :4], a[:, 4], a[:, 5] > 0, a[:, 6] > 0, base, side)
                out = pd.DataFrame(p, columns=["x", "y", "u", "v", "below", "above"])
                out.insert(0, by, g)
                out.insert(1, "ox", ox)
                out.insert(2, "oy", oy)
                yield out

    t = tiles(rings, by, member)
    return t.repartition(by, "tx", "ty").mapInPandas(run, kind + "ox double, oy double, x double, y double, u double, v double, below double, above double")


def covered_areas(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(by, n, area): the area that n polygons of a group cover, for each n from 1; polygons are the
    rings (by, member, ring, i, x, y) of a member."""
    o = overlay(rings, by, member)
    # what is below a piece, with its sign: an area ends below it, another one begins above
    under = (F.col("u") - F.col("x")) * (F.col("y") + F.col("v")) / 2
    part = lambda n, a: F.struct(F.col(n).cast("long").alias("n"), a.alias("a"))
    p = o.select(by, F.explode(F.array(part("below", under), part("above", -under))).alias("p"), (F.abs("y") + F.abs("u")).alias("far"))
    s = p.groupBy(by, "p.n").agg(F.sum("p.a").alias("area"), F.max(F.col("far")).alias("far"))
    return s.where("n > 0 AND area > 1e-13 * far * far").select(by, "n", "area")


def above(pieces: DataFrame, by: str, least: int) -> DataFrame:
    """(by, x, y, u, v): of the pieces of an `overlay`, those that border what `least` polygons or more cover, that
    area to their left."""
    p = pieces.where((F.col("below") >= least) != (F.col("above") >= least))
    on = F.col("above") >= least  # covered above: to the left of a piece from left to right
    ends = lambda a, b, o: F.when(on, F.col(a)).otherwise(F.col(b)) + F.col(o)
    b = p.select(by, ends("x", "u", "ox").alias("x"), ends("y", "v", "oy").alias("y"), ends("u", "x", "ox").alias("u"), ends("v", "y", "oy").alias("v"))
    (x, y), (u, v) = _turned("x", "y", True), _turned("u", "v", True)
    return b.select(by, x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))


def covered_border(rings: DataFrame, by: str, member: str, least: int = 1) -> DataFrame:
    """(by, x, y, u, v): the pieces of edges that border what `least` polygons of a group or more cover,
    that area to their left. 1 gives the union, 2 what is seen twice."""
    return above(overlay(rings, by, member), by, least)


def border_areas(border: DataFrame, by: str) -> DataFrame:
    return border.groupBy(by).agg((F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2).alias("area"))


def pair_areas(rings: DataFrame, by: str, member: str, border: bool = True) -> DataFrame:
    """(by, a, b, shared, border): for the members a < b of a group whose boxes meet, the area that both
    cover and the length of border that they have in common (null where it is not asked for)."""
    r = kept(edges(rings, [by, member, "ring"]), "edges")
    box = r.groupBy(by, member).agg(F.min(F.least("x", "u")).alias("x0"), F.max(F.greatest("x", "u")).alias("x1"), F.min(F.least("y", "v")).alias("y0"), F.max(F.greatest("y", "v")).alias("y1"))
    return _pair_areas(box_pairs(box, [by], member), r, by, member, border) if border else _cell_areas(box, r, by, member)


def _cell_areas(box: DataFrame, r: DataFrame, by: str, member: str) -> DataFrame:
    """`pair_areas` without borders. Polygons, not pairs of them, are sent to the cells in which they meet: a task holds
    the polygons at home in one block of a cell, and those that visit it stream past."""
    kind = {c: r.schema[c].dataType.simpleString() for c in (by, member)}
    schema = f"{by} {kind[by]}, a {kind[member]}, b {kind[member]}, shared double, border double"
    found = _cells(box.where(F.col(member).isNotNull()), [by], member, BLOCK)
    if not found:
        return r.sparkSession.createDataFrame([], schema)
    home, seen, cell, homes = found
    # what is below upright edges is nothing, so axes need no turn here
    own = r.select(by, member, F.struct("x", "y", "u", "v").alias("s")).groupBy(by, member).agg(F.collect_list("s").alias("e"))
    own = kept(_oriented(own, [by, member]).withColumnRenamed(member, "m"), "edges")
    rows = home.withColumn("__seen", F.lit(False)).unionByName(seen.withColumn("__seen", F.lit(True))).join(own, [by, "m"])
    blocks = homes.agg(F.sum("blocks")).first()[0]
    # a number of its own: by their bytes, which stand for the square of them in pairs, few tasks would do
    rows = rows.repartition(max(1, min(blocks, 2000)), *cell).sortWithinPartitions(*cell, "__seen")
    cols = ("m", "lev", "x0", "x1", "y0", "y1", "side", "cx", "cy", "__seen", "e")

    def run(parts):
        key, at_home, one = None, [], None
        for batch in parts:
            k, flag = batch.column("__key").to_numpy(), batch.column("__seen").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (flag[1:] != flag[:-1])]) if len(k) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(k)], strict=True):
                if k[lo] != key:
                    key, at_home, one = k[lo], [], None
                if not flag[lo]:
                    at_home.append(batch.slice(lo, hi - lo))
                elif at_home:
                    one = one or _Polygons(pa.Table.from_batches(at_home))
                    step = max(1, 1_000_000 // len(one.m))
                    for i in range(lo, hi, step):
                        yield from _met(one, _Polygons(pa.Table.from_batches([batch.slice(i, min(step, hi - i))])), batch.column(by)[lo], by)

    return rows.select(by, F.xxhash64(*cell).alias("__key"), *cols).mapInArrow(run, schema)


class _Polygons:
    """Polygons of one cell, their edges in arrays by how many they have, from the cell's corner."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        self.m, self.lev = t.column("m").combine_chunks(), col("lev")
        self.side, self.cx, self.cy = (col(c)[0] for c in ("side", "cx", "cy"))
        self.box = np.stack([col(c) for c in ("x0", "x1", "y0", "y1")])
        e = t.column("e").combine_chunks()
        flat = e.flatten()
        ox, oy = self.cx * self.side, self.cy * self.side
        x, y, u, v, d = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        parts = np.stack([x - ox, u - ox, y - oy, (v - y) / (u - x), d])
        n = pc.fill_null(pc.list_value_length(e), 0).to_numpy()
        first = np.cumsum(n) - n
        # as many as they have, from 16 on the next power of two; the rest are edges without a width
        self.size = np.where(n <= 16, n, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(int))
        self.place, self.edges = np.zeros(len(n), int), {}
        for c in np.unique(self.size[n > 0]).tolist():
            own = np.flatnonzero((self.size == c) & (n > 0))
            self.place[own] = np.arange(len(own))
            k = np.arange(c)
            real = k < n[own][:, None]
            self.edges[c] = np.where(real, parts[:, np.where(real, first[own][:, None] + k, 0)], 0.0)


def _met(a: _Polygons, b: _Polygons, g: pa.Scalar, by: str):
    """Batches of `_cell_areas`: the polygons `a` at home with the visitors `b`."""
    (ax0, ax1, ay0, ay1), (bx0, bx1, by0, by1) = a.box[:, :, None], b.box
    i, j = np.nonzero((ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1))
    at = lambda k, c: np.floor(np.maximum(a.box[k][i], b.box[k][j]) / a.side) == c
    ok = at(0, a.cx) & at(2, a.cy)
    i, j = i[ok], j[ok]
    p, q = a.m.take(pa.array(i)), b.m.take(pa.array(j))
    less, lower = pc.less(p, q), b.lev[j] < a.lev[i]
    ok = less.to_numpy(zero_copy_only=False) | (lower & pc.not_equal(p, q).to_numpy(zero_copy_only=False))
    keep = pa.array(ok)
    i, j, p, q, less = i[ok], j[ok], p.filter(keep), q.filter(keep), less.filter(keep)
    area = areas_in_common(a, b, i, j)
    for lo in range(0, len(i), 100_000):
        n = slice(lo, min(lo + 100_000, len(i)))
        c = [x[n] for x in (p, q, less)]
        size = len(c[0])
        yield pa.RecordBatch.from_arrays([pa.repeat(g, size), pc.if_else(c[2], c[0], c[1]), pc.if_else(c[2], c[1], c[0]), pa.array(area[n]), pa.nulls(size, pa.float64())], names=[by, "a", "b", "shared", "border"])


def areas_in_common(a: _Polygons, b: _Polygons, i: np.ndarray, j: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The areas that polygons a[i] and b[j] of a cell both cover: the sum, over pairs of edges, of what is below both, with
    their signs. Of two edges f and g, that is the integral of g and of f - g where f is lower."""
    out = np.zeros(len(i))
    for c, ea in a.edges.items():
        for d, eb in b.edges.items():
            own = np.flatnonzero((a.size[i] == c) & (b.size[j] == d))
            n, m = max(1, block // (c * d)), max(1, block // d)  # pairs at once, and edges of a where these are too many
            steps = np.arange(min(c, m) * d)
            for lo in range(0, len(own), n):
                o = own[lo : lo + n]
                pi, qj = a.place[i[o]], b.place[j[o]]
                q = eb[:2, qj][:, :, None, :]
                for k in range(0, c, m):
                    p = ea[:2, pi, k : k + m][:, :, :, None]
                    x = np.maximum(p[0], q[0])
                    w = np.minimum(p[1], q[1]) - x
                    x, w = (z.reshape(len(o), -1) for z in (x, w))
                    at = pair, r = np.nonzero(w > 0)  # few edges are above each other
                    x, w = x[at], w[at]
                    f, g = (pi * c + k)[pair] + (steps // d)[r], (qj * d)[pair] + (steps % d)[r]
                    (fx, fy, fs, fd), (gx, gy, gs, gd) = ([e[k].take(t) for k in (0, 2, 3, 4)] for e, t in ((ea, f), (eb, g)))
                    f, g = fy + fs * (x - fx), gy + gs * (x - gx)
                    h = g + gs * w
                    d0, d1 = f - g, f + fs * w - h
                    less = np.minimum(d0, 0.0) + np.minimum(d1, 0.0)
                    cross = np.flatnonzero(d0 * d1 < 0)
                    s, t = d0[cross], d1[cross]
                    less[cross] = np.where(s < 0, s * s, -t * t) / (s - t)
                    out[o] += np.bincount(pair, w * (g + h + less) * (fd * gd), len(o)) / 2
    low, high = (f(a.box[k][:, i], b.box[k][:, j]) for f, k in ((np.minimum, [0, 2]), (np.maximum, [1, 3])))
    ext = (high - low).max(axis=0, initial=0.0)
    return np.where(out > 1e-12 * ext * ext, out, 0.0)


def _pair_areas(p: DataFrame, r: DataFrame, by: str, member: str, border: bool) -> DataFrame:
    """`pair_areas` of the pairs (by, a, b) of polygons with the edges `r`."""
    (x, y), (u, v) = _turned("x", "y"), _turned("u", "v")
    turned = r.select(by, member, F.struct(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).alias("s"))
    arr = kept(_oriented(turned.groupBy(by, member).agg(F.collect_list("s").alias("e")), [by, member]), "edges")
    end = lambda s: arr.select(by, F.col(member).alias(s), F.col("e").alias(f"e{s}"))
    m = p.join(end("a"), [by, "a"]).join(end("b"), [by, "b"]).select(by, "a", "b", "ea", "eb")
    kind = {c: m.schema[c].dataType.simpleString() for c in (by, "a")}

    def run(parts):
        for rows in parts:
            two = []
            for c in ("ea", "eb"):
                flat = rows.column(c).flatten()
                two += [np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(rows.column(c)), 0).to_numpy())]]
            shared, along = shared_areas(*two, border)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in (by, "a", "b")] + [pa.array(shared), pa.array(along) if border else pa.nulls(len(shared), pa.float64())], names=[by, "a", "b", "shared", "border"])

    return m.mapInArrow(run, f"{by} {kind[by]}, a {kind['a']}, b {kind['a']}, shared double, border double")


def shared_areas(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, border: bool = True, close: float = 1e-9, block: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The areas that pairs of polygons both cover, and the lengths that their edges have in common on one line. a, b: the `signed` edges
    of all pairs; na, nb: where those of a pair begin. A polygon is the sum of what is below its edges, with their signs;
    so what two have in common is a sum over pairs of edges."""
    pairs = len(na) - 1
    shared, along, ext, floor = (np.zeros(pairs) for _ in range(4))
    pair = np.repeat(np.arange(pairs), np.diff(na))
    low, high = np.full((2, pairs), np.inf), np.full((2, pairs), -np.inf)
    for e, k in ((a, pair), (b, np.repeat(np.arange(pairs), np.diff(nb)))):
        for axis, cols in enumerate(((0, 2), (1, 3))):
            for c in cols:
                np.minimum.at(low[axis], k, e[:, c])
                np.maximum.at(high[axis], k, e[:, c])
    some = np.isfinite(low).all(axis=0)
    ext[some], floor[some] = (high - low)[:, some].max(axis=0), low[1][some]
    far = close * np.maximum(np.abs(low), np.abs(high)).max(axis=0)
    n = np.diff(nb)[pair]  # edges of b that an edge of a meets
    ends = np.cumsum(n)
    lo = 0
    while lo < len(a):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, "right")), lo + 1)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + nb[pair[i]]
        k = pair[i]
        if border:
            p, q = a[i], b[j]
            tx, ty = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1]
            size = np.maximum(np.hypot(tx, ty), 1e-300)
            tx, ty = tx / size, ty / size
            on = np.ones(len(i), bool)
            for c in (0, 2):
                on &= np.abs(tx * (q[:, c + 1] - p[:, 1]) - ty * (q[:, c] - p[:, 0])) <= far[k]
            s, t = (tx * (q[:, c] - p[:, 0]) + ty * (q[:, c + 1] - p[:, 1]) for c in (0, 2))
            long = np.minimum(np.maximum(s, t), size) - np.maximum(np.minimum(s, t), 0)
            along += np.bincount(k, np.where(on & (long > far[k]), long, 0), pairs)
        x0, x1 = np.maximum(a[i, 0], b[j, 0]), np.minimum(a[i, 2], b[j, 2])
        ok = x1 > x0
        i, j, k, x0, x1 = i[ok], j[ok], k[ok], x0[ok], x1[ok]
        height = lambda e, x: e[:, 1] + (e[:, 3] - e[:, 1]) * ((x - e[:, 0]) / (e[:, 2] - e[:, 0]))
        p, q = a[i], b[j]
        f0, f1, g0, g1 = height(p, x0), height(p, x1), height(q, x0) - floor[k], height(q, x1) - floor[k]
        d0, d1 = f0 - floor[k] - g0, f1 - floor[k] - g1
        with np.errstate(divide="ignore", invalid="ignore"):
            t = d0 / (d0 - d1)
        less = np.where(d0 * d1 < 0, np.where(d0 < 0, d0 * t, d1 * (1 - t)), np.minimum(d0, 0) + np.minimum(d1, 0))
        shared += np.bincount(k, p[:, 4] * q[:, 4] * (x1 - x0) * (g0 + g1 + less) / 2, pairs)
        lo = hi
    return np.where(shared > 1e-12 * ext * ext, shared, 0.0), along


def inner_points(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(by, member, px, py): points of a grid, in turned axes, that stand inside each polygon, of a grid that is 2^-k times its
    size; the points of a coarser grid are among those of a finer one, so polygons of any size may have one in common."""
    (x, y), (u, v) = _turned("x", "y"), _turned("u", "v")
    turned = edges(rings, [by, member, "ring"]).select(by, member, F.struct(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).alias("s"))
    kind = {c: rings.schema[c].dataType.simpleString() for c in (by, member)}

    def run(parts):
        for pdf in parts:
            for g, m, e in zip(pdf[by], pdf[member], pdf["e"], strict=True):
                e = np.array([(s["x"], s["y"], s["u"], s["v"], s["d"]) for s in e], float).reshape(-1, 5)
                if not len(e):
                    continue
                low, high = e[:, [0, 1, 2, 3]].reshape(-1, 2).min(axis=0), e[:, [0, 1, 2, 3]].reshape(-1, 2).max(axis=0)
                size = (high - low).max()
                step = 2.0 ** (math.ceil(math.log2(size)) - 3)
                px, py = (q.ravel() for q in np.meshgrid(*(np.arange(math.ceil(a / step), math.floor(b / step) + 1) * step for a, b in zip(low, high, strict=True))))
                n, clear = np.zeros(len(px)), np.ones(len(px), bool)
                for x, y, u, v, d in e:
                    off = py - (y + (v - y) * ((px - x) / (u - x)))
                    over = (x <= px) & (px < u)
                    n += np.where(over & (off > 0), d, 0)
                    clear &= ~over | (np.abs(off) > 1e-6 * size)
                ok = clear & (n == 1)
                yield pd.DataFrame({by: g, member: m, "px": px[ok], "py": py[ok]})

    polys = _oriented(turned.groupBy(by, member).agg(F.collect_list("s").alias("e")), [by, member])
    return polys.mapInPandas(run, f"{by} {kind[by]}, {member} {kind[member]}, px double, py double")


def union_parts(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(by, parts): of how many parts a group's union consists; polygons that share an area or a length of
    border are one part, those that meet in a point are not. A polygon of several parts counts as one.

    Polygons over one point of a grid share an area, so most links come without pairs. Only polygons of different
    components of these links, where the components' boxes meet, are compared.
    """
    name = lambda c: F.xxhash64(F.col(by), F.col(c))
    r = kept(edges(rings, [by, member, "ring"]), "edges")
    inside = kept(inner_points(rings, by, member), "points").withColumn("node", name(member))
    over = inside.groupBy(F.col(by).alias("__by"), F.col("px").alias("__px"), F.col("py").alias("__py")).agg(F.min("node").alias("b"))
    at = inside[by].eqNullSafe(over["__by"]) & (F.col("px") == F.col("__px")) & (F.col("py") == F.col("__py"))
    links = kept(inside.join(over, at).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "links")
    box = r.groupBy(by, member).agg(F.min(F.least("x", "u")).alias("x0"), F.max(F.greatest("x", "u")).alias("x1"), F.min(F.least("y", "v")).alias("y0"), F.max(F.greatest("y", "v")).alias("y1")).withColumn("node", name(member))
    box = kept(box.join(graph.connected_components(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).select(by, member, "comp", "x0", "x1", "y0", "y1"), "boxes")
    comps = kept(box.groupBy(by, "comp").agg(*[f(f"{c}{k}").alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]), "components")
    p = kept(box_pairs(comps, [by], "comp"), "pairs")
    meet = lambda s, t: " and ".join(f"{c}0{s} <= {c}1{t} and {c}0{t} <= {c}1{s}" for c in "xy")
    named = lambda d, s: d.select(by, *[F.col(c).alias(f"{c}{s}") for c in d.columns if c != by])

    def side(own: str, other: str) -> DataFrame:
        """The members of one component that meet the box of the other one."""
        m = p.join(named(box, "_m").withColumnRenamed("comp_m", own), [by, own]).join(named(comps, "_o").withColumnRenamed("comp_o", other), [by, other]).where(meet("_m", "_o"))
        return m.select(by, "a", "b", *[F.col(f"{c}_m").alias(f"{c}_{own}") for c in (member, "x0", "x1", "y0", "y1")])

    two = side("a", "b").join(side("b", "a"), [by, "a", "b"]).where(meet("_a", "_b"))
    two = two.select(by, F.col(f"{member}_a").alias("a"), F.col(f"{member}_b").alias("b"))
    more = _pair_areas(two, r, by, member, True).where("shared > 0 or border > 0").select(name("a").alias("a"), name("b").alias("b"))
    found = graph.connected_components(links.unionByName(more))
    m = usable(rings, [by, member, "ring"]).select(by, member).distinct().withColumn("node", name(member))
    return m.join(found, "node", "left").groupBy(by).agg(F.countDistinct(F.coalesce("component", "node")).alias("parts"))


def union_or_hull(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(by, parts, x, y, u, v): the border of a group's union, or of its convex hull where the union has
    several parts."""
    parts = kept(union_parts(rings, by, member), "parts")
    one, many = (parts.where(c).select(by) for c in ("parts = 1", "parts > 1"))
    border = covered_border(rings.join(one, by, "left_semi"), by, member)
    hull = polygons.hulls(rings.join(many, by, "left_semi").select(by, "x", "y"), by).withColumn("ring", F.lit(0))
    return border.unionByName(edges(hull, [by, "ring"]).drop("ring")).join(parts, by).select(by, "parts", "x", "y", "u", "v")
