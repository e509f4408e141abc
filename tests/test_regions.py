"""Masks, box pairs and overlays of any rings against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rayloom.functions import kernels
from rayloom.operators import footprints, regions

rnd = random.Random(4)
RINGS = "g int, m int, ring int, i int, x double, y double"


def star(g, m, cx, cy, r, ring=0, n=9):
    return [(g, m, ring, i, cx + r * rnd.uniform(0.35, 1) * math.cos(2 * math.pi * i / n), cy + r * rnd.uniform(0.35, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def polygons(rows):
    out = {}
    for g, m, ring, _, x, y in rows:
        out.setdefault((g, m), {}).setdefault(ring, []).append((x, y))
    return out


def holds(rings, x, y):
    """Even-odd rule at many points."""
    inside = np.zeros(np.shape(x), bool)
    for ring in rings.values():
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if b != d:
                inside ^= ((b <= y) != (d <= y)) & (x < a + (y - b) * (c - a) / (d - b))
    return inside


def area(rings):
    """Of rings that do not cross, the first one outside, the others holes."""
    one = [abs(sum(a * d - c * b for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True))) / 2 for r in rings.values()]
    return one[0] - sum(one[1:])


def scene():
    rows = []
    for g in range(2):
        for m in range(14):
            cx, cy, r = rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(3, 25)
            rows += star(g, m, cx, cy, r)
            if m % 3 == 0:
                rows += star(g, m, cx, cy, r * 0.3, 1)  # inside the smallest radius of the outer ring
    rows += [(g, 90 + k, ring, i, x, y) for k in range(3) for g, m, ring, i, x, y in rows if m == 3]  # copies
    return rows


def test_overlays_equal_rasters(spark):
    rows = scene()
    df = spark.createDataFrame(rows, RINGS)
    got = {(r.g, r.n): r.area for r in regions.covered_areas(df, "g", "m").collect()}
    ps = polygons(rows)
    xs, ys = np.meshgrid(np.arange(-26, 90, 0.125) + 0.05, np.arange(-26, 90, 0.125) + 0.07)
    for g in range(2):
        n = sum(holds(p, xs, ys).astype(int) for (h, _), p in ps.items() if h == g)
        for k, c in Counter(n[n > 0].ravel().tolist()).items():
            # of a count's area, an error of its border only
            assert got.get((g, k), 0.0) == pytest.approx(c / 64, rel=0.05, abs=3), (g, k)
        # what all polygons have together is exact
        assert sum(k * a for (h, k), a in got.items() if h == g) == pytest.approx(sum(area(p) for (h, _), p in ps.items() if h == g), rel=1e-9)
    for least in (1, 2, 5):
        border = {r.g: r.area for r in regions.border_areas(regions.covered_border(df, "g", "m", least), "g").collect()}
        for g in range(2):
            assert border[g] == pytest.approx(sum(a for (h, k), a in got.items() if h == g and k >= least), rel=1e-7)


def test_crowded_tiles_are_cut(spark):
    rows = [r for m in range(60) for r in star(0, m, 10 + m * 0.01, 10, 5)] + star(0, 99, 200, 200, 300)
    df = spark.createDataFrame(rows, RINGS)
    whole, cut = regions.tiles(df, "g", "m"), regions.tiles(df, "g", "m", crowd=20, depth=3)
    assert cut.select("side").distinct().count() > whole.select("side").distinct().count()
    big = cut.groupBy("tx", "ty", "side").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert big <= 61
    a = sum(r.n * r.area for r in regions.covered_areas(df, "g", "m").collect())
    assert a == pytest.approx(sum(area(p) for p in polygons(rows).values()), rel=1e-9)


def test_edges_on_one_line_leave_no_border(spark):
    square = lambda m, x, y, s=1.0: [(0, m, 0, i, x + a * s, y + b * s) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])]
    df = spark.createDataFrame(square(0, 0, 0) + square(1, 1, 0) + square(2, 0, 1) + square(3, 1, 1) + square(4, 5, 5) + square(5, 2, 2), RINGS)
    b = regions.covered_border(df, "g", "m").collect()
    assert sum(math.hypot(r.u - r.x, r.v - r.y) for r in b) == pytest.approx(8 + 4 + 4)
    assert sum(r.x * r.v - r.u * r.y for r in b) / 2 == pytest.approx(6)
    assert regions.union_parts(df, "g", "m").first().parts == 3  # (2, 2) meets the others in a point
    h = regions.union_or_hull(df, "g", "m").collect()
    assert {r.parts for r in h} == {3} and sum(r.x * r.v - r.u * r.y for r in h) / 2 == pytest.approx(kernels.area(kernels.hull(np.array([(0, 0), (0, 2), (2, 0), (3, 2), (6, 5), (6, 6), (5, 6), (2, 3)], float))))
    one = regions.union_or_hull(df.where("m < 4"), "g", "m").collect()
    assert {r.parts for r in one} == {1} and sum(r.x * r.v - r.u * r.y for r in one) / 2 == pytest.approx(4)


def test_a_polygon_in_anothers_hole_is_a_part(spark):
    ring = lambda m, k, r: [(0, m, k, i, r * a, r * b) for i, (a, b) in enumerate([(-1, -1), (-1, 1), (1, 1), (1, -1)])]
    df = spark.createDataFrame([(g, m, k, i, float(x), float(y)) for g, m, k, i, x, y in ring(0, 0, 5) + ring(0, 1, 3) + ring(1, 0, 2)], RINGS)
    assert regions.union_parts(df, "g", "m").first().parts == 2
    assert {r.n: r.area for r in regions.covered_areas(df, "g", "m").collect()} == {1: pytest.approx(100 - 36 + 16)}
    p = regions.pair_areas(df, "g", "m").first()
    assert (p.a, p.b, p.shared, p.border) == (0, 1, 0.0, 0.0)


def test_convex_pairs_equal_clipping(spark):
    rows = [r for m in range(12) for r in [(0, m, 0, i, *map(float, p)) for i, p in enumerate(kernels.hull(np.random.default_rng(m).normal(m % 4, 2, (12, 2))))]]
    ps = {m: np.array(p[0]) for (_, m), p in polygons(rows).items()}
    got = {(r.a, r.b): r.shared for r in regions.pair_areas(spark.createDataFrame(rows, RINGS), "g", "m").collect()}
    for a in ps:
        for b in ps:
            if a < b:
                assert got.get((a, b), 0.0) == pytest.approx(kernels.area(kernels.clip(ps[a], ps[b])), abs=1e-7)


ODD = [(5, 0, 0, 0, 1.0, 1.0), (5, 0, 0, 1, 2.0, 2.0), (6, 0, 0, 0, None, 1.0), (6, 0, 0, 1, float("nan"), 1.0), (6, 0, 0, 2, 1.0, 3.0), (6, 0, 0, 3, 2.0, 2.0)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_rings_without_an_area(spark, rows):
    df = spark.createDataFrame(rows, RINGS)
    assert regions.covered_areas(df, "g", "m").count() == 0 and regions.covered_border(df, "g", "m").count() == 0
    assert regions.fill_runs(df.withColumnRenamed("g", "area"), "area").count() == 0
    assert regions.pair_areas(df, "g", "m").count() == 0


def test_runs_equal_the_even_odd_rule(spark):
    rows = scene()
    df = spark.createDataFrame([(g * 100 + m, ring, i, x, y) for g, m, ring, i, x, y in rows], "area int, ring int, i int, x double, y double")
    got = {(r.area, r.row, c) for r in regions.fill_runs(df, "area").collect() for c in range(r.c0, r.c1 + 1)}
    xs, ys = np.meshgrid(np.arange(-40, 100), np.arange(-40, 100))
    want = {(g * 100 + m, int(y), int(x)) for (g, m), p in polygons(rows).items() for x, y in np.c_[xs.ravel(), ys.ravel()][holds(p, xs, ys).ravel()]}
    assert got == want and len(want) > 5000


def test_runs_hold_their_borders_and_meet_points(spark):
    square = [(1, 0, i, *map(float, p)) for i, p in enumerate([(2, 2), (2, 6), (6, 6), (6, 2)])] + [(1, 1, i, *map(float, p)) for i, p in enumerate([(3.6, 3.6), (3.6, 4.6), (4.6, 4.6), (4.6, 3.6)])]
    df = spark.createDataFrame(square, "area int, ring int, i int, x double, y double")
    runs = regions.fill_runs(df, "area")
    assert {(r.row, r.c0, r.c1) for r in runs.collect()} == {(2, 2, 6), (3, 2, 6), (4, 2, 3), (4, 5, 6), (5, 2, 6)}
    low = regions.fill_runs(df.withColumns({"a": F.lit(3), "b": F.lit(4)}), "area", "a", "b")
    assert {r.row for r in low.collect()} == {3, 4}
    p = spark.createDataFrame([(1, 1.9, 2.0), (1, 2.0, 2.0), (1, 6.9, 5.9), (1, 4.5, 4.5), (1, 3.9, 4.5), (1, 7.0, 3.0), (2, 3.0, 3.0), (None, 3.0, 3.0), (1, None, 3.0)], "area int, col double, row double")
    assert {(r.col, r.row) for r in regions.masked(p, runs, "area").collect()} == {(2.0, 2.0), (6.9, 5.9), (3.9, 4.5)}


def test_runs_have_no_column_in_common(spark):
    """Parts that touch in a pixel, so that the pixels of a row are the sum of its runs."""
    parts = [[(2, 2), (2, 6), (4, 6), (4, 2)], [(4, 2), (4, 6), (6, 6), (6, 2)], [(6, 2), (6, 6), (6.5, 6), (6.5, 2)], [(8, 2), (8, 6), (8, 7)]]
    df = spark.createDataFrame([(1, ring, i, *map(float, p)) for ring, ps in enumerate(parts) for i, p in enumerate(ps)], "area int, ring int, i int, x double, y double")
    runs = regions.fill_runs(df, "area").collect()
    assert sorted((r.c0, r.c1) for r in runs if r.row == 3) == [(2, 4), (5, 6), (8, 8)]
    assert len({(r.row, c) for r in runs for c in range(r.c0, r.c1 + 1)}) == sum(r.c1 - r.c0 + 1 for r in runs)


@pytest.mark.parametrize("block", [1000, 3])
def test_box_pairs_equal_all_pairs(spark, block):
    boxes = []
    for k in range(150):
        x, y, s = rnd.uniform(-50, 50), rnd.uniform(-50, 50), 2.0 ** rnd.randrange(-6, 7)
        boxes.append((k % 2, k, x, x + s * rnd.random(), y, y + s * rnd.random()))
    boxes += [(0, 200 + k, 0.0, 1.0, 0.0, 1.0) for k in range(8)] + [(0, 300, 1.0, 1.0, 1.0, 1.0), (0, 301, None, 1.0, 0.0, 1.0), (0, 302, float("nan"), 1.0, 0.0, 1.0), (0, 303, 1.0, 4.0, 1.0, 4.0)]
    got = regions.box_pairs(spark.createDataFrame(boxes, "g int, m int, x0 double, x1 double, y0 double, y1 double"), ["g"], "m", block)
    good = [b for b in boxes if all(v is not None and v == v for v in b)]
    want = Counter((a[0], a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5])
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_footprint_plans_have_no_product_and_no_join_on_the_group_alone(spark):
    rings = spark.createDataFrame([(0, m, i, float(m + a), float(b)) for m in range(5) for i, (a, b) in enumerate([(0, 0), (0, 2), (2, 2), (2, 0)])], "g int, m int, i int, x double, y double")
    centres = spark.createDataFrame([(m, 0.0, 0.0, float(m)) for m in range(5)], "cam_id int, cx double, cy double, cz double")
    pairs = footprints.footprint_pairs(rings.select(F.col("m").alias("cam_id"), "i", "x", "y"), centres)
    for df in (pairs, footprints.union_border(rings, "g", "m"), footprints.shared_parts(rings, "g", "m")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert not any("Join [g#" in line and line.split("Join [")[1].split("]")[0].count("#") == 1 for line in plan.splitlines())
    assert {(r.cam_i, r.cam_j, r.overlap) for r in pairs.collect()} == {(k, k + 1, 0.5) for k in range(4)}


def test_polygons_over_one_place_do_not_multiply_tiles(spark):
    """Many polygons whole over each tile: a tile holds the edges that go through it, and lines that they share count once."""
    boxes = [(m, m * 37 % 11, m * 53 % 13, m * 37 % 11 + 20 + m % 3, m * 53 % 13 + 20 + m % 4) for m in range(900)]
    rows = [(0, m, 0, i, float(x), float(y)) for m, a, b, c, d in boxes for i, (x, y) in enumerate([(a, b), (c, b), (c, d), (a, d)])]
    df = spark.createDataFrame(rows, RINGS)
    assert regions.tiles(df, "g", "m").agg(F.sum(F.size("e"))).first()[0] < 20 * len(boxes)
    n = np.zeros((40, 40), int)
    for _, a, b, c, d in boxes:
        n[a:c, b:d] += 1
    want = {k: int(v) for k, v in zip(*np.unique(n[n > 0], return_counts=True), strict=True)}
    got = {r.n: r.area for r in regions.covered_areas(df, "g", "m").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pairs_of_one_batch_equal_unit_squares(spark):
    """Concave polygons with holes, all pairs of a batch at once."""
    shapes = [[(0, 0), (9, 0), (9, 8), (6, 8), (6, 4), (3, 4), (3, 8), (0, 8)], [(7, 2), (7, 3), (8, 3), (8, 2)]]
    rows = [(0, m, k, i, float(x + m * 37 % 11), float(y + m * 53 % 13)) for m in range(30) for k, ring in enumerate(shapes) for i, (x, y) in enumerate(ring)]
    xs, ys = np.meshgrid(np.arange(30) + 0.5, np.arange(30) + 0.5)
    cover = {m: holds(p, xs, ys) for (_, m), p in polygons(rows).items()}
    got = regions.pair_areas(spark.createDataFrame(rows, RINGS), "g", "m", border=False).collect()
    assert {r.border for r in got} == {None} and len(got) > 200
    found = {(r.a, r.b): r.shared for r in got}
    assert all(found.get((a, b), 0.0) == pytest.approx((cover[a] & cover[b]).sum(), abs=1e-9) for a in cover for b in cover if a < b)


def test_parts_come_from_common_points_and_few_pairs(spark):
    """Polygons of one place have an inner point in common, whatever their sizes; others are compared."""
    box = lambda g, m, x, y, s: [(g, m, 0, i, x + a * s, y + b * s) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])]
    rows = [r for m in range(40) for r in box(0, m, m * 0.01, m * 0.02, 1.0 + m % 3)]  # one place
    rows += box(0, 50, -1.0, 0.0, 1.0) + box(0, 51, 20.0, 20.0, 2.0) + box(0, 52, 22.0, 22.0, 2.0) + box(0, 53, 20.1, 20.1, 0.01)  # a border, alone, a point, inside
    rows += [r for m, k in ((0, 0), (0, 1), (1, 0)) for r in [(1, m, k, *p[3:]) for p in box(1, m, -5.0 if m + k == 0 else (-3.0 if k else -2.0), -5.0 if m + k == 0 else (-3.0 if k else -2.0), 10.0 if m + k == 0 else (6.0 if k else 4.0))]]
    df = spark.createDataFrame(rows, RINGS)
    ps = polygons(rows)
    inner = regions.inner_points(df, "g", "m").collect()
    c, s = math.cos(regions.TURN), math.sin(regions.TURN)
    assert {(r.g, r.m) for r in inner} == set(ps) and all(holds(ps[r.g, r.m], r.px * c + r.py * s, r.py * c - r.px * s) for r in inner)
    seen = Counter((r.px, r.py) for r in inner if r.g == 0 and r.m < 40)
    assert max(seen.values()) >= 30
    assert {r.g: r.parts for r in regions.union_parts(df, "g", "m").collect()} == {0: 3, 1: 2}


def test_points_meet_the_runs_near_them_only(spark):
    """A row of 3000 runs and 20,000 points in it: all were compared."""
    runs = [(1, 5, 10 * k - 700, 10 * k - 700 + k % 9) for k in range(3000)] + [(1, 6, -1000, 40_000), (2, 5, 3, 3)]
    r = spark.createDataFrame(runs, "g int, row long, c0 long, c1 long")
    points = [(k, 1 + k % 2, (k * 7 % 31_000) - 800 + 0.5, 5.0 + k % 3) for k in range(20_000)]
    df = spark.createDataFrame(points, "id int, g int, col double, row double")
    got = sorted(x.id for x in regions.masked(df, r, "g").collect())
    held = {(g, row, c) for g, row, a, b in runs for c in range(a, b + 1)}
    assert got == [k for k, g, c, y in points if (g, int(y), int(np.floor(c))) in held] and len(got) > 1000
    plan = regions.masked(df, r, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan.split("LeftSemi")[1].splitlines()[0]


def test_runs_are_not_broadcast(spark):
    """A small table of rings makes many runs: by its size they were sent to every task through the driver."""
    rings = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (9000.0, 0.0), (9000.0, 900.0), (0.0, 900.0)])], "g int, ring int, i int, x double, y double")
    points = spark.createDataFrame([(1, 5.5, 7.5), (1, 9500.0, 7.5), (2, 5.5, 7.5)], "g int, col double, row double")
    df = regions.masked(points, regions.fill_runs(rings, "g"), "g")
    assert [tuple(r) for r in df.collect()] == [(1, 5.5, 7.5)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_areas_in_common_without_pairs_of_rows(spark, monkeypatch):
    """Polygons were joined to a row for each pair of them, twice. Equal to the way over pairs, for boxes of many sizes in small blocks."""
    rows = scene() + [(1, 200 + k, 0, i, x * 40.0 - 9, y * 40.0 - 9) for k in range(2) for i, (x, y) in enumerate([(0, 0), (2 + k, 0), (2 + k, 2), (1, 1), (0, 2)])] + star(1, 300, 30, 30, 20, n=40) + [(0, 400, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame([(g, f"m{m:03d}", *r) for g, m, *r in rows] + [(None, "m", 0, i, float(i % 2), float(i)) for i in range(3)], RINGS.replace("m int", "m string"))
    for block in (1000, 3):
        monkeypatch.setattr(regions, "BLOCK", block)
        got = {(r.g, r.a, r.b): r.shared for r in regions.pair_areas(df, "g", "m", border=False).collect()}
        every = regions.pair_areas(df, "g", "m").collect()
        assert len(every) == len(got) > 100 and all(r.a < r.b and abs(got[r.g, r.a, r.b] - r.shared) < 1e-6 for r in every)
    plan = regions.pair_areas(df, "g", "m", border=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("RepartitionByExpression")[0] and "RepartitionByExpression" in plan
    empty = regions.pair_areas(df.where("g > 9"), "g", "m", border=False)
    assert empty.columns == ["g", "a", "b", "shared", "border"] and empty.count() == 0


def test_edges_of_large_polygons_meet_in_parts():
    def made(seed, n):
        r = np.random.default_rng(seed)
        at = [2 * np.pi * np.arange(k) / k for k in n]
        xy = [np.c_[8 + 7 * r.uniform(0.4, 1, len(t)) * np.cos(t), 8 + 7 * r.uniform(0.4, 1, len(t)) * np.sin(t)] for t in at]
        e = [regions.signed(np.c_[q, np.roll(q, -1, axis=0)]) for q in xy]
        cols = {"m": np.arange(len(n)), "lev": [4] * len(n), "side": [16.0] * len(n), "cx": [0] * len(n), "cy": [0] * len(n)}
        box = {c: [f(q[:, k]) for q in xy] for c, f, k in (("x0", np.min, 0), ("x1", np.max, 0), ("y0", np.min, 1), ("y1", np.max, 1))}
        kind = pa.list_(pa.struct([(c, pa.float64()) for c in "xyuvd"]))
        return e, regions._Polygons(pa.table(cols | box | {"e": pa.array([[dict(zip("xyuvd", z, strict=True)) for z in q.tolist()] for q in e], kind)}))

    (e, a), (f, b) = made(1, [5, 9, 60, 33]), made(2, [7, 100, 17])
    i, j = (k.ravel() for k in np.meshgrid(np.arange(4), np.arange(3)))
    begin = lambda x: np.r_[0, np.cumsum([len(q) for q in x])]
    p, q = [e[k] for k in i], [f[k] for k in j]
    want = regions.shared_areas(np.concatenate(p), begin(p), np.concatenate(q), begin(q), False)[0]
    assert (want > 1).all()
    for block in (1 << 16, 300, 1):
        assert np.allclose(regions.areas_in_common(a, b, i, j, block), want, rtol=1e-12)
