"""Height grids, isolated points, the forest of descriptors and projective fits, against plain loops and made scenes."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.operators import forest, heights, matching, surface

rnd = random.Random(6)


@pytest.mark.parametrize("size", [1, 4, 32])
def test_heights_equal_a_plain_loop(spark, size):
    grid = {(x, y): rnd.uniform(-50, 50) for x in range(-9, 12) for y in range(-7, 8) if rnd.random() < 0.97}
    nodes = spark.createDataFrame([(x, y, h) for (x, y), h in grid.items()], "ix int, iy int, h double")
    places = [(rnd.uniform(-1.2, 1.3), rnd.uniform(-0.9, 0.9)) for _ in range(300)] + [(0.0, 0.0), (0.5, 0.25), (1.1, 0.7), (1.1, 0.3), (-0.9, -0.7), (1.15, 0.0)]
    points = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(places)] + [(-1, None, 0.0), (-2, float("nan"), 0.0)], "id int, lon double, lat double")
    got = {r.id: r.height for r in heights.heights_at(points, heights.tiled(nodes, size), 0.0, 0.0, 0.1, size).collect()}
    assert len(got) == len(places) + 2 and got[-1] is None

    def plain(a, b):
        x, y = a / 0.1, b / 0.1
        i, k = int(np.floor(x)), int(np.floor(y))
        out = 0.0
        for p, wx in ((i, 1 - (x - i)), (i + 1, x - i)):
            for q, wy in ((k, 1 - (y - k)), (k + 1, y - k)):
                if wx * wy != 0:
                    if (p, q) not in grid:
                        return None
                    out += wx * wy * grid[p, q]
        return out

    for k, (a, b) in enumerate(places):
        want = plain(a, b)
        assert got[k] is None if want is None else got[k] == pytest.approx(want)
    assert sum(v is not None for v in got.values()) > 150


def test_a_grid_that_goes_round(spark):
    nodes = spark.createDataFrame([(x, y, float(10 * x + y)) for x in range(36) for y in range(3)], "ix int, iy int, h double")
    t = heights.tiled(nodes, 8, 36)
    p = spark.createDataFrame([(175.0, 5.0, 100.0), (-185.0, 5.0, None), (535.0, 5.0, 0.0)], "lon double, lat double, alt double")
    got = heights.ellipsoidal(p, t, -180.0, 0.0, 10.0, 8, 36).collect()
    assert [r.ellipsoid for r in got] == [pytest.approx(100 + 175.5), None, pytest.approx(175.5)]  # between columns 35 and 0


@pytest.mark.parametrize(("window", "least", "rescue"), [(1, 3, 1), (2, 4, 3), (1, 1, 1), (1, 99, 2)])
def test_isolated_points_equal_a_plain_loop(spark, window, least, rescue):
    w, h, r = 14, 11, 1.0
    xyz = {(c, k): [c * 0.6 + rnd.gauss(0, 0.3), k * 0.6 + rnd.gauss(0, 0.3), rnd.choice([0.0, 0.0, 5.0, rnd.uniform(0, 2)])] for c in range(w) for k in range(h) if rnd.random() < 0.9}
    xyz[3, 3] = [float("nan")] * 3
    rows = [(c * 100 + k, c, k, *p) for (c, k), p in xyz.items()]
    near = lambda a, b: sum((x - y) ** 2 for x, y in zip(xyz[a], xyz[b], strict=True)) < r * r
    around = lambda p, n: [q for q in ((p[0] + i, p[1] + j) for i in range(-n, n + 1) for j in range(-n, n + 1)) if q in xyz]
    stay = {p for p in xyz if sum(near(p, q) for q in around(p, window)) >= least}
    while more := {p for p in xyz if p not in stay and any(q in stay and near(p, q) for q in around(p, rescue))}:
        stay |= more
    df = spark.createDataFrame(rows, "id int, col int, row int, x double, y double, z double")
    got = {(x.col, x.row) for x in surface.without_isolated(df, r, window, least, rescue).collect()}
    assert got == stay


def clustered(n, seed, size=32):
    g = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(scale=40, size=(40, size))
    return centres[g.integers(0, 40, n)] + g.normal(scale=6, size=(n, size))


def test_the_forest_finds_both_neighbours(spark):
    """Images of which most keypoints are seen twice, among clusters."""
    a = clustered(3000, 2)
    b = np.r_[a[:2000] + np.random.default_rng(3).normal(scale=1, size=(2000, 32)), clustered(1000, 4)]
    rows = [(0, k, v.tolist()) for k, v in enumerate(a)] + [(1, k, v.tolist()) for k, v in enumerate(b)]
    kp = spark.createDataFrame(rows, "cam_id int, kp_id int, desc array<double>")
    pairs = spark.createDataFrame([(0, 1)], "cam_i int, cam_j int")
    got = {r.kp_i: [x.kp_j for x in r.t] for r in forest.two_nearest(kp, pairs).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).round(9)
    best = np.argsort(d, axis=1, kind="stable")[:, :2]
    first = np.mean([got.get(k, [None])[:1] == [best[k, 0]] for k in range(len(a))])
    both = np.mean([got.get(k) == best[k].tolist() for k in range(len(a))])
    assert first >= 0.95 and both >= 0.95, (first, both)
    exact = {(r.kp_i, r.kp_j) for r in matching.ratio_match(kp, pairs, 0.6).collect()}
    found = {(r.kp_i, r.kp_j) for r in forest.forest_match(kp, pairs, 0.6).collect()}
    assert len(exact) > 1000 and len(exact & found) >= 0.99 * len(exact) and len(found - exact) <= 0.01 * len(exact)


def test_forest_of_few_and_odd_descriptors(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 7)
    kp = [(0, k, [float(k), 0.0]) for k in range(5)] + [(1, k, [float(k), 0.1]) for k in range(5)] + [(1, 50 + k, [9.0, 9.0]) for k in range(40)] + [(0, 90, None), (0, 91, [float("nan"), 0.0]), (1, 92, [1.0])]
    df = spark.createDataFrame(kp, "cam_id int, kp_id int, desc array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "cam_i int, cam_j int")
    got = {r.kp_i: [(x.kp_j, x.d) for x in r.t] for r in forest.two_nearest(df, pairs).collect()}
    assert {k: [x[0] for x in v] for k, v in got.items()} == {0: [0, 1], 1: [1, 0], 2: [2, 1], 3: [3, 2], 4: [4, 3]}
    assert forest.forest_match(df.where("false"), pairs).count() == 0


def test_a_query_goes_once_to_each_part_of_a_tree(spark, monkeypatch):
    """Not once to each leaf, nor for each image that it asks."""
    placed, real = [], forest._placed
    monkeypatch.setattr(forest, "_placed", lambda *a: placed.append(real(*a)) or placed[-1])
    at = {(c, k): v for c in range(4) for k, v in enumerate(np.random.default_rng(c).normal(size=(150, 8)))}
    kp = spark.createDataFrame([(*k, v.tolist()) for k, v in at.items()], "cam_id int, kp_id int, desc array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(4) for j in range(i + 1, 4)], "cam_i int, cam_j int")
    rows = forest.two_nearest(kp, pairs, leaf=4).collect()
    assert sum(d.count() for d in placed) <= 450 * forest.TREES * (1 + 4)  # stored ones stand in one part, queries in four at most
    right = 0
    for r in rows:
        d = {k: round(math.dist(at[r.cam_i, r.kp_i], at[r.cam_j, k]), 9) for k in range(150)}
        assert len(r.t) == 2 and all(abs(x.d - d[x.kp_j]) < 1e-8 for x in r.t) and r.t[0].kp_j != r.t[1].kp_j
        right += [x.kp_j for x in r.t] == sorted(d, key=lambda k: (d[k], k))[:2]
    assert len({(r.cam_i, r.cam_j, r.kp_i) for r in rows}) == len(rows) == 900 and right > 600


def scene(seed, n=120, outliers=50):
    """Two perspective cameras that look at points of depth, and matches of which some are wrong."""
    g = np.random.default_rng(seed)
    x = np.c_[g.uniform(-1, 1, (n, 2)) * 3, g.uniform(4, 9, n)]
    a = 0.2
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    see = lambda p: 800 * p[:, :2] / p[:, 2:] + 500
    one, two = see(x) + g.normal(scale=0.05, size=(n, 2)), see(x @ r.T + [-1.5, 0.2, 0.3]) + g.normal(scale=0.05, size=(n, 2))
    bad = np.c_[g.uniform(0, 1000, (outliers, 2)), g.uniform(0, 1000, (outliers, 2))]
    return np.r_[np.c_[one, two], bad]


def test_projective_ransac_finds_known_outliers(spark):
    rows = [(i, 10 + i, k, k, *map(float, m)) for i in range(3) for k, m in enumerate(scene(i))] + [(7, 8, k, k, float(k), 0.0, 1.0, float(k)) for k in range(7)] + [(9, 10, k, k, 1.0, 1.0, 2.0, 2.0) for k in range(20)]
    df = spark.createDataFrame(rows, "cam_i int, cam_j int, kp_i int, kp_j int, x1 double, y1 double, x2 double, y2 double")
    got = matching.ransac_projective(df, 0.5, 2000)
    for i in range(3):
        kept = {r.kp_i for r in got.where(F.col("cam_i") == i).collect()}
        assert len(kept & set(range(120))) >= 118 and len(kept & set(range(120, 170))) <= 2
        # one affine geometry does not hold this scene
        assert matching.ransac(df.where(F.col("cam_i") == i), 0.5, 200).count() < 100
    assert got.where("cam_i > 2").count() == 0  # too few matches, and points that are all one
    again = matching.ransac_projective(df.repartition(5), 0.5, 2000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_a_fundamental_matrix_of_exact_matches_has_rank_two():
    m = scene(5, outliers=0)
    f = matching.fundamental(m)
    assert np.linalg.svd(f)[1][2] < 1e-12 and matching.line_distances(f, m).max() < 0.6
    assert matching.fundamental(np.ones((9, 4))) is None


@pytest.mark.parametrize("bands", [1, 7, 64])
def test_epipolar_matches_equal_all_pairs(spark, bands):
    """Lines of any slope, level and upright ones among them, against every keypoint."""
    g = np.random.default_rng(bands)
    kp = [(c, k, float(x), float(y), [float(v) for v in g.normal(size=3)]) for c in range(3) for k, (x, y) in enumerate(g.uniform(-100, 900, (150, 2)))]
    kp += [(1, 150 + k, float(100 * k), 50.0, [0.1, 0.2, 0.3]) for k in range(8)]  # on borders and on one level
    f = {(0, 1): g.normal(size=9), (0, 2): np.array([0, 0, 0, 0, 0, 1, 0, -1, 0.0]), (1, 2): np.array([0, 0, 1, 0, 0, 0, -1, 0, 0.0])}
    f[0, 1] *= np.array([1e-4, 1e-4, 1, 1e-4, 1e-4, 1, 1, 1, 100])
    pairs = spark.createDataFrame([(i, j, [float(v) for v in m]) for (i, j), m in f.items()], "cam_i int, cam_j int, f array<double>")
    df = spark.createDataFrame(kp, "cam_id int, kp_id int, x double, y double, desc array<double>")
    got = {(r.cam_i, r.cam_j, r.kp_i): (r.kp_j, r.dist) for r in matching.epipolar_match(df, pairs, 6.0, 0.8, bands).collect()}
    want = {}
    for (i, j), m in f.items():
        m = m.reshape(3, 3)
        for _, k, x, y, d in (r for r in kp if r[0] == i):
            a, b, c = m @ [x, y, 1]
            near = sorted((round(float(np.linalg.norm(np.subtract(d, e))), 9), q) for cam, q, u, v, e in kp if cam == j and abs(a * u + b * v + c) <= 6.0 * np.hypot(a, b))
            if near and (len(near) == 1 or near[0][0] < 0.8 * near[1][0]):
                want[i, j, k] = (near[0][1], near[0][0])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want) and len(want) > 60


def test_rows_at_one_pixel_keep_their_ids(spark):
    from rayloom.plans import scene

    same = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    d = spark.createDataFrame([(1, 2000.0, 2000.0, 3.0, 0.5), (2, 2000.0, 2000.0, 3.0, 0.5), (3, 2100.0, 2000.0, 3.0, 0.5)], "id int, col double, row double, dx double, dy double")
    got = surface.disparity_points(d, same, same, scene.models(spark), 0, 1, (-1e9, 1e9, -1e9, 1e9)).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0][1:] == got[1][1:] != got[2][1:]


def test_blocks_of_images_find_the_nearest_in_one_product(spark):
    """Near ties, copies, large offsets and masks against plain distances; 9 billion numbers a loop over rows would take."""
    g = np.random.default_rng(8)
    for shift in (0.0, 1e6):
        x, y = g.normal(size=(40, 8)) + shift, g.normal(size=(90, 8)) + shift
        y[50:60], x[:5] = y[3], y[3]  # copies
        y[70], y[71] = x[9] + 1e-10, x[9] - 1e-10  # one distance at nine places
        ok = g.random((40, 90)) < 0.3
        ok[7] = False
        rank = g.permutation(90)
        for mask in (None, ok):
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).round(9)
            want = [(i, j, d[i, j]) for i in range(40) for j in sorted((j for j in range(90) if mask is None or mask[i, j]), key=lambda j: (d[i, j], rank[j]))[:2]]
            assert list(zip(*matching.nearest(x, y, 2, mask, rank), strict=True)) == want
            assert list(zip(*matching.nearest(x, y, 1, mask, rank), strict=True)) == [w for k, w in enumerate(want) if not k or want[k - 1][0] != w[0]]
    assert len(matching.nearest(x, y[:1])[0]) == 40 and len(matching.nearest(x, y[:0])[0]) == 0
    odd = y.copy()
    odd[5] = np.nan
    assert 5 not in matching.nearest(x, odd)[1]
    # pairs are an array's numbers: 64 million distances of 64 numbers within the time of a test
    began, a = time.time(), g.normal(size=(8000, 64))
    for i, j, mask in matching._every(a, a):
        r, c, d = matching.nearest(a[i], a[j], 2, mask)
        assert (c[::2] == i).all()
    assert time.time() - began < 30


@pytest.mark.parametrize("block", [7, 1000])
def test_matches_do_not_depend_on_blocks(spark, block, monkeypatch):
    g = np.random.default_rng(9)
    kp = [(c, k, float(x), float(y), [float(v) for v in np.round(g.normal(size=3), 1)]) for c in range(3) for k, (x, y) in enumerate(g.uniform(0, 100, (40, 2)))] + [(1, 99, 1.0, 1.0, None), (2, 99, None, 1.0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(kp, "cam_id int, kp_id int, x double, y double, desc array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "cam_i int, cam_j int")
    monkeypatch.setattr(matching._meet, "__defaults__", (matching._every, block))
    side = lambda c: pairs.join(df.withColumnRenamed("cam_id", c), c)
    got = {tuple(r)[:4] for r in matching.window_match(side("cam_i"), side("cam_j"), 30.0, 2.5, ("cam_i", "cam_j")).collect()}
    lines = pairs.withColumn("f", F.array(*[F.lit(v) for v in (0.0, 0.0, 0.3, 0.0, 0.0, -1.0, -0.3, 1.0, 4.0)]))
    seen = {tuple(r)[:4] for r in matching.epipolar_match(df, lines, 9.0, 0.9).collect()}
    want, along = set(), set()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for _, k, x, y, d in (r for r in kp if r[0] == i and r[4]):
            others = [r for r in kp if r[0] == j and r[4] and r[2] is not None]
            near = sorted((round(math.dist(d, e), 9), q) for _, q, u, v, e in others if (x - u) ** 2 + (y - v) ** 2 <= 900)
            want |= {(i, j, k, near[0][1])} if near and near[0][0] < 2.5 else set()
            near = sorted((round(math.dist(d, e), 9), q) for _, q, u, v, e in others if abs(0.3 * u - v - 0.3 * x + y + 4) <= 9 * math.hypot(0.3, 1))
            along |= {(i, j, k, near[0][1])} if near and (len(near) == 1 or near[0][0] < 0.9 * near[1][0]) else set()
    assert got == want and seen == along and len(want) > 30 and len(along) > 10
