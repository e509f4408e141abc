"""Columns against numpy, round trips, fits and the solver on a scene with known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions import cameras, geodesy, kernels, rotation
from rayloom.operators import geometry, solve
from rayloom.session import kept
from rayloom.sources import files

g = np.random.default_rng(7)


def model(k: int) -> dict:
    """A sensor model over a small area, seen from direction k."""
    num = lambda *v: list(v) + [0.0] * (20 - len(v))
    tilt = [(0.25, 0.05), (-0.25, 0.1), (0.05, -0.3), (-0.1, -0.2)][k % 4]
    return {
        "lon_off": 10.0, "lat_off": 45.0, "alt_off": 300.0, "lon_scale": 0.05, "lat_scale": 0.05, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0,
        "col_num": num(0.01, 1.0, 0.02, tilt[0], 0.001), "col_den": num(1.0, 0.001, 0.0005, 0.0002), "row_num": num(-0.02, 0.03, -1.0, tilt[1], 0.0, 0.001), "row_den": num(1.0, 0.0003, -0.001, 0.0001),
    }


@pytest.fixture(scope="module")
def models(spark):
    rows = [{"cam_id": k, **model(k)} for k in range(4)]
    schema = "cam_id long, " + ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in geometry.FIELDS)
    return spark.createDataFrame([tuple(r[c] for c in ["cam_id", *geometry.FIELDS]) for r in rows], schema)


def test_rotations(spark):
    e = spark.createDataFrame([tuple(map(float, v)) for v in g.uniform(-1.5, 1.5, (20, 3))], "r double, p double, y double")
    m = rotation.euler_to_matrix(F.col("r"), F.col("p"), F.col("y"))
    back = rotation.matrix_to_euler(m)
    q = rotation.quaternion_to_euler(*rotation.euler_to_quaternion(F.col("r"), F.col("p"), F.col("y")))
    again = rotation.axis_angle_to_matrix(*rotation.matrix_to_axis_angle(m))
    out = e.select(F.array("r", "p", "y").alias("e"), F.array(*back).alias("b"), F.array(*q).alias("q"), F.array(*[x for r in m for x in r]).alias("m"), F.array(*[x for r in again for x in r]).alias("a")).collect()
    for r in out:
        assert np.allclose(r.e, r.b) and np.allclose(r.e, r.q) and np.allclose(r.m, r.a)
        x = np.array(r.m).reshape(3, 3)
        assert np.allclose(x @ x.T, np.eye(3)) and np.isclose(np.linalg.det(x), 1)
        assert np.allclose(x, solve._turn(np.array(r.e)))
    still = spark.range(1).select(*[c.alias(k) for c, k in zip(rotation.rodrigues([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(0.0)] * 3), "xyz", strict=True)]).first()
    assert tuple(still) == (1.0, 2.0, 3.0)


def test_geodesy(spark):
    p = spark.createDataFrame([tuple(map(float, v)) for v in np.c_[g.uniform(-179, 179, 30), g.uniform(-79, 79, 30), g.uniform(-100, 9000, 30)]], "lon double, lat double, alt double")
    z = geodesy.utm_zone(F.col("lon"))
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), z)
    x = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    rows = p.select("*", z.alias("zone"), e.alias("e"), n.alias("n"), *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])
    lon, lat = geodesy.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    la, lo, al = geodesy.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    for r in rows.select("*", lon.alias("lon2"), lat.alias("lat2"), la.alias("la"), lo.alias("lo"), al.alias("al")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
        assert abs(r.la - r.lat) < 1e-9 and abs(r.lo - r.lon) < 1e-9 and abs(r.al - r.alt) < 1e-3
        assert np.allclose(kernels.ecef(r.lon, r.lat, r.alt), [r.x, r.y, r.z])
    # known: the equator at a central meridian
    known = spark.range(1).select(*[c.alias(k) for c, k in zip(geodesy.to_utm(F.lit(3.0), F.lit(0.0), F.lit(31)), "en", strict=True)]).first()
    assert abs(known.e - 500000) < 1e-6 and abs(known.n) < 1e-6


def test_projection_and_localisation(spark, models):
    pts = [(k % 4, k, 10 + float(a), 45 + float(b), 300 + float(c)) for k, (a, b, c) in enumerate(np.c_[g.uniform(-0.04, 0.04, (80, 2)), g.uniform(-300, 300, 80)])]
    df = spark.createDataFrame(pts, "cam_id long, id long, lon double, lat double, alt double")
    seen = geometry.project(df, models)
    columns = {}
    for k in range(4):
        c, r = cameras.project_rpc(model(k), F.col("lon"), F.col("lat"), F.col("alt"))
        columns |= {x.id: (x.c, x.r) for x in df.where(f"cam_id = {k}").select("id", c.alias("c"), r.alias("r")).collect()}
    assert all(np.allclose(columns[x.id], (x.col, x.row)) for x in seen.collect())
    back = geometry.localize(seen.join(df.select("id", "alt"), "id"), models)
    truth = {p[1]: p for p in pts}
    assert all(abs(x.lon - truth[x.id][2]) < 1e-9 and abs(x.lat - truth[x.id][3]) < 1e-9 for x in back.collect())


def test_triangulation(spark, models):
    lla = np.c_[10 + g.uniform(-0.03, 0.03, 20), 45 + g.uniform(-0.03, 0.03, 20), 300 + g.uniform(-200, 200, 20)]
    rows = [(t, i, j, *map(float, kernels.project(model(i), *lla[t][:, None])[:, 0]), *map(float, kernels.project(model(j), *lla[t][:, None])[:, 0])) for t in range(20) for i, j in ((0, 1), (0, 2), (1, 3))]
    got = geometry.triangulate(spark.createDataFrame(rows, "track_id long, cam_i long, cam_j long, ci double, ri double, cj double, rj double"), models).collect()
    for r in got:
        assert np.linalg.norm(np.array([r.x, r.y, r.z]) - kernels.ecef(*lla[r.track_id])) < 0.01 and r.miss < 1e-3 and r.pairs == 3


def test_matrices():
    p1, p2 = np.c_[np.eye(3), [0, 0, 4.0]], np.c_[solve._turn(np.array([0.1, -0.3, 0.2])), [1.0, 0.5, 5]]
    x = g.uniform(-1, 1, (30, 3))
    see = lambda p: ((h := np.c_[x, np.ones(30)] @ p.T)[:, :2] / h[:, 2:])
    assert np.allclose(kernels.triangulate_matrices(p1, p2, see(p1), see(p2)), x)
    assert np.allclose(kernels.camera_matrix(x, see(p2)), p2 / p2[2, 3])


def test_decompositions():
    turn = solve._turn(np.array([0.4, -0.7, 1.1]))
    persp = kernels.compose_perspective(np.array([[9000.0, 3.0, 2000.0], [0, 9100.0, 1500.0], [0, 0, 1]]), turn, np.array([4.1e6, 7.2e5, 5.3e6]))
    k, r, t, c = kernels.decompose_perspective(persp)
    assert np.allclose(kernels.compose_perspective(k, r, c), persp) and np.allclose(r @ r.T, np.eye(3)) and np.allclose(t, -r @ c)
    aff = kernels.compose_affine(np.array([[1.2, 0.01], [0, 1.1]]), turn, np.array([-1.1e6, 4.0e6]))
    assert np.allclose(kernels.compose_affine(*kernels.decompose_affine(aff)), aff)
    a, b = np.c_[np.eye(3), [0, 0, 4.0]], np.c_[solve._turn(np.array([0.1, -0.3, 0.2])), [1.0, 0.5, 5]]
    x = np.c_[g.uniform(-1, 1, (10, 3)), np.ones(10)]
    assert np.allclose(np.einsum("ni,ij,nj->n", x @ b.T, kernels.fundamental(a, b), x @ a.T), 0)


def test_approximations():
    m = model(1)
    p = kernels.affine_approximation(m, 10.0, 45.0, 300.0)
    near = kernels.ecef(10.0003, 45.0002, 310.0)
    assert np.allclose((p @ np.append(near, 1))[:2], kernels.project(m, 10.0003, 45.0002, 310.0).ravel(), atol=0.05)
    assert np.allclose(kernels.project(kernels.rescaled(m, 0.5), 10.01, 45.0, 300.0), kernels.project(m, 10.01, 45.0, 300.0) / 2)


def test_refit(spark, models):
    got = geometry.refit(models, 8).collect()
    assert len(got) == 4 and all(r.rmse < 1e-2 for r in got)


def test_solver_recovers_a_known_scene(spark, models):
    n = 60
    lla = np.c_[10 + g.uniform(-0.03, 0.03, n), 45 + g.uniform(-0.03, 0.03, n), 300 + g.uniform(-200, 200, n)]
    x = kernels.ecef(*lla.T).T
    up = kernels.ecef(10.0, 45.0, 0.0) / np.linalg.norm(kernels.ecef(10.0, 45.0, 0.0))
    centre = {k: kernels.ecef(10.0, 45.0, 300.0) + 5e5 * up + 1e5 * g.normal(size=3) for k in range(4)}
    turn = {k: np.zeros(3) if k == 0 else g.normal(scale=2e-6, size=3) for k in range(4)}
    obs = [(t, k, *map(float, solve._see(model(k), x[t : t + 1], turn[k], centre[k])[0] + g.normal(scale=0.05, size=2))) for t in range(n) for k in range(4)]
    o = spark.createDataFrame(obs, "track_id long, cam_id long, col double, row double")
    pts = spark.createDataFrame([(t, *map(float, x[t] + g.normal(scale=1.0, size=3))) for t in range(n)], "track_id long, x double, y double, z double")
    cen = spark.createDataFrame([(k, *map(float, v)) for k, v in centre.items()], "cam_id long, cx double, cy double, cz double")
    angles, moved, costs = solve.adjust(spark, o, pts, models, cen, kept, fixed={0}, settings=solve.Settings(rounds=8))
    assert costs[-1] < 0.01 * costs[0]
    err = solve.errors(solve._state(spark, o, moved, models, angles, cen)).agg(F.avg("err")).first()[0]
    assert err < 0.1
    assert (angles[0] == 0).all()


def test_robust_refinement_end_to_end(spark, models):
    from rayloom.plans import refine

    n = 50
    lla = np.c_[10 + g.uniform(-0.03, 0.03, n), 45 + g.uniform(-0.03, 0.03, n), 300 + g.uniform(-200, 200, n)]
    x, up = kernels.ecef(*lla.T).T, kernels.ecef(10.0, 45.0, 300.0) / np.linalg.norm(kernels.ecef(10.0, 45.0, 300.0))
    centre = {k: kernels.ecef(10.0, 45.0, 300.0) + 5e5 * up + 1e5 * g.normal(size=3) for k in range(3)}
    turn = {k: np.zeros(3) if k == 0 else g.normal(scale=2e-6, size=3) for k in range(3)}
    kp = [(k, t, *map(float, solve._see(model(k), x[t : t + 1], turn[k], centre[k])[0] + g.normal(scale=0.05, size=2) + (30.0 if (t, k) in ((5, 1), (9, 2), (20, 1)) else 0.0)), 1.0) for t in range(n) for k in range(3)]
    keypoints = spark.createDataFrame(kp, "cam_id long, kp_id long, col double, row double, scale double")
    matches = spark.createDataFrame([(i, j, t, t) for t in range(n) for i, j in ((0, 1), (1, 2))], "cam_i long, cam_j long, kp_i long, kp_j long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "cam_i long, cam_j long")
    cen = spark.createDataFrame([(k, *map(float, v)) for k, v in centre.items()], "cam_id long, cx double, cy double, cz double")
    out = refine.refine(spark, matches, keypoints, pairs, models.where("cam_id < 3"), cen, refine.Config(fixed=frozenset({0}), fit_grid=6))
    left = {(r.track_id, r.cam_id) for r in out["obs"].collect()}
    assert not left & {(5, 1), (9, 2), (20, 1)} and len(left) >= 0.7 * 3 * n
    err = solve.errors(solve._state(spark, out["obs"], out["points"], models, out["angles"], cen)).agg(F.percentile("err", 0.5)).first()[0]
    assert err < 0.15
    fitted = out["models"].collect()
    assert len(fitted) == 3 and all(r.rmse < 0.05 for r in fitted)


def test_rpc_text(spark, tmp_path, models):
    files.write_rpc_texts(models.withColumn("image_id", F.concat(F.lit("img"), "cam_id")), f"{tmp_path}/rpc")
    lines = files.rpc_lines(models.withColumn("image_id", F.col("cam_id").cast("string")))
    raw = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda v: v["value"]), "\n").alias("value"))
    got = {r.image_id: r for r in files.parse_rpc_texts(raw).collect()}
    for r in models.collect():
        assert all(got[str(r.cam_id)][f] == r[f] for f in geometry.FIELDS)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.b.rpc").write_text("\n".join(f"{k}: {v} pixels" for k, v in [("LINE_OFF", "1.5"), ("SAMP_OFF", "-2e3"), *[(f"LINE_NUM_COEFF_{i}", f"{i}.0E-2") for i in range(1, 21)]]))
    one = files.read_rpc_texts(spark, f"{tmp_path}/one").first()
    assert (one.image_id, one.row_off, one.col_off, one.row_num[19], one.lat_off) == ("a.b", 1.5, -2000.0, 0.2, None)


def test_polygons_and_clouds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"coordinates": [[[1, 2], [3, 4], [5, 0]]], "type": "Polygon"}}]}')
    p = files.read_polygons(spark, f"{tmp_path}/a.json")
    assert [(r.x, r.y) for r in p.orderBy("i").collect()] == [(1, 2), (3, 4), (5, 0)]
    assert files.polygon_json(p, "file").first().value == '{"coordinates":[[[1.0,2.0],[3.0,4.0],[5.0,0.0]]],"type":"Polygon"}'
    cloud = files.point_cloud_lines(spark.createDataFrame([(1.0, 2.0, 1e-5), (4.0, 5.0, 6e10)], "x double, y double, z double"))
    cloud.orderBy("i").select("value").coalesce(1).write.text(f"{tmp_path}/c")
    assert sorted(tuple(r) for r in files.read_point_cloud(spark, f"{tmp_path}/c").collect()) == [(1.0, 2.0, 1e-5), (4.0, 5.0, 6e10)]


def scene(kind: str):
    """Cameras around a cloud of points: parameters, points and what is seen."""
    draw = np.random.default_rng(21)
    x = draw.uniform(-1, 1, (40, 3))
    theta = {}
    for k in range(5):
        turn = draw.normal(scale=0.4, size=3)
        theta[k] = np.r_[turn, draw.normal(scale=0.1, size=2), [6.0, 900.0, 905.0, 0.5, 500.0, 400.0]] if kind == "perspective" else np.r_[turn, draw.normal(scale=0.1, size=2), [300.0, 310.0, 0.4]]
    obs = [(t, k, *map(float, solve._see(None, x[t : t + 1], v, None, kind)[0])) for k, v in theta.items() for t in range(len(x)) if (t + k) % 4]
    return theta, x, obs


@pytest.mark.parametrize(("kind", "correct"), [("perspective", ("R", "T")), ("perspective", ("R", "T", "COMMON_K")), ("affine", ("R", "K"))])
def test_solver_recovers_matrices(spark, kind, correct):
    theta, x, obs = scene(kind)
    s = solve.Settings(kind=kind, correct=correct, rounds=8, ftol=1e-6)
    o = spark.createDataFrame(obs, "track_id long, cam_id long, col double, row double")
    pts = spark.createDataFrame([(t, *map(float, v + g.normal(scale=0.01, size=3))) for t, v in enumerate(x)], "track_id long, x double, y double, z double")
    off = {k: v.copy() for k, v in theta.items()}
    for k in (1, 2, 3):
        off[k][[0, 1, 2]] += g.normal(scale=0.01, size=3)
        if "T" in correct:
            off[k][[3, 4]] += g.normal(scale=0.01, size=2)
        if "K" in correct:
            off[k][5:7] *= 1.01
    if "COMMON_K" in correct:
        for v in off.values():
            v[6:8] *= 1.01
    start = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in off.items()], "cam_id long, theta array<double>")
    params, moved, costs = solve.adjust(spark, o, pts, start, None, kept, fixed={0, 4}, settings=s)
    assert costs[-1] < 1e-3 * costs[0] and costs[-1] < 1e-2 * len(obs)
    assert (params[0][:6] == off[0][:6]).all()
    if "COMMON_K" in correct:
        assert all((v[6:] == params[0][6:]).all() for v in params.values()) and abs(params[0][6] - 900) < abs(off[0][6] - 900) / 3


def test_weights_and_fixed_points(spark):
    """A camera that counts much pulls the others; points that are fixed stay."""
    theta, x, obs = scene("perspective")
    s = solve.Settings(kind="perspective", correct=("R",), rounds=3)
    o = spark.createDataFrame([(*r, 5.0 if r[1] == 1 else 1.0) for r in obs], "track_id long, cam_id long, col double, row double, weight double")
    pts = spark.createDataFrame([(t, *map(float, v + 0.01), t < 5) for t, v in enumerate(x)], "track_id long, x double, y double, z double, is_fixed boolean")
    start = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in theta.items()], "cam_id long, theta array<double>")
    _, moved, costs = solve.adjust(spark, o, pts, start, None, kept, fixed={0}, settings=s)
    got = {r.track_id: (r.x, r.y, r.z) for r in moved.collect()}
    assert all(np.allclose(got[t], x[t] + 0.01) for t in range(5)) and not np.allclose(got[7], x[7] + 0.01, atol=1e-4)
    e = {r.cam_id: r.e for r in solve.errors(solve._state(spark, o, moved, start, theta, None, s), s).groupBy("cam_id").agg(F.avg("err").alias("e")).collect()}
    assert len(e) == 5 and costs[-1] < costs[0]


def test_block_gradients_are_the_dense_solution(spark):
    draw = np.random.default_rng(3)
    a = draw.normal(size=(30, 30))
    a = a @ a.T + np.eye(30)
    b = draw.normal(size=30)
    ends = {0: (0, 6), 1: (6, 12), 2: (12, 18), 3: (18, 24), solve.COMMON: (24, 30)}
    blocks = {(i, j): a[slice(*p), slice(*q)] for i, p in ends.items() for j, q in ends.items()}
    rhs = {i: b[slice(*p)] for i, p in ends.items()}
    sizes = {i: 6 for i in ends}
    rows = [(i, j, m.ravel().tolist(), (rhs[i] if i == j else np.zeros(6)).tolist(), 0.0) for (i, j), m in blocks.items()] + [(-1, -1, [0.0] * 36, [0.0] * 6, 7.0)]
    in_spark = solve.solve_in_spark(spark.createDataFrame(rows, "ci long, cj long, block array<double>, rhs array<double>, cost double").repartition(3), sizes, kept)
    assert all(np.allclose(in_spark[k], -np.linalg.solve(a, b)[slice(*ends[k])], atol=1e-7) for k in ends)
    one, two = (solve.solve_blocks(blocks, rhs, sizes, dense) for dense in (100, 1))
    assert all(np.allclose(one[k], two[k], atol=1e-7) and np.allclose(one[k], -np.linalg.solve(a, b)[slice(*ends[k])]) for k in ends)
    with pytest.raises(ValueError):
        solve.Settings(correct=("K", "COMMON_K"))


def test_gradients_in_spark_with_owners_of_several_sizes(spark):
    draw = np.random.default_rng(4)
    n = {5: 3, 9: 3, solve.COMMON: 2}
    a = draw.normal(size=(8, 8))
    a, b = a @ a.T + np.eye(8), draw.normal(size=8)
    ends = {5: (0, 3), 9: (3, 6), solve.COMMON: (6, 8)}
    padded = lambda m, r, c: np.pad(m, ((0, 3 - r), (0, 3 - c)), constant_values=9.0).ravel().tolist()
    rows = [(i, j, padded(a[slice(*p), slice(*q)], n[i], n[j]), np.pad(b[slice(*p)], (0, 3 - n[i]), constant_values=9.0).tolist() if i == j else [0.0] * 3) for i, p in ends.items() for j, q in ends.items()]
    got = solve.solve_in_spark(spark.createDataFrame(rows, "ci long, cj long, block array<double>, rhs array<double>"), n, kept)
    assert all(np.allclose(got[k], -np.linalg.solve(a, b)[slice(*ends[k])], atol=1e-8) for k in ends)
    assert solve.solve_in_spark(spark.createDataFrame(rows, "ci long, cj long, block array<double>, rhs array<double>"), {}, kept) == {}


def perturbed(spark, spread=0.02):
    theta, x, obs = scene("perspective")
    draw = np.random.default_rng(11)
    o = spark.createDataFrame(obs, "track_id long, cam_id long, col double, row double")
    pts = spark.createDataFrame([(t, *map(float, v + draw.normal(scale=spread, size=3))) for t, v in enumerate(x)], "track_id long, x double, y double, z double")
    off = {k: np.r_[v[:3] + (draw.normal(scale=spread, size=3) if k else 0), v[3:]] for k, v in theta.items()}
    return theta, x, obs, o, pts, off, spark.createDataFrame([(k, [float(y) for y in v]) for k, v in off.items()], "cam_id long, theta array<double>")


def test_steps_in_spark_are_the_dense_steps(spark):
    _, _, _, o, pts, _, start = perturbed(spark)
    one, two = (solve.adjust(spark, o, pts, start, None, kept, fixed={0}, settings=solve.Settings(kind="perspective", rounds=1, dense=d)) for d in (6000, 2))
    assert all(np.allclose(one[0][k], two[0][k], atol=1e-8) for k in one[0]) and np.allclose(one[2], two[2])


def test_trust_radius_finds_the_scene(spark):
    theta, _, obs, o, pts, _, start = perturbed(spark, 0.05)
    s = solve.Settings(kind="perspective", trust=True, rounds=8, first_radius=1.0)
    params, _, costs = solve.adjust(spark, o, pts, start, None, kept, fixed={0}, settings=s)
    assert all(b < a for a, b in zip(costs, costs[1:], strict=False)) and costs[-1] < 1e-3 * costs[0] and costs[-1] < 1e-2 * len(obs)
    _, _, capped = solve.adjust(spark, o, pts, start, None, kept, fixed={0}, settings=solve.Settings(kind="perspective", trust=True, evaluations=1, first_radius=1e-3))
    assert 1 <= len(capped) <= 2


def test_bounded_steps_end_where_a_plain_loop_does(spark):
    """One angle may not come nearer to its true value than a bound; points held, so that a small dense loop can tell."""
    theta, x, obs, o, _, _, _ = perturbed(spark)
    limit = 0.01
    start = {k: _with(v, 1, v[1] + 0.03) for k, v in theta.items()}
    s = solve.Settings(kind="perspective", trust=True, rounds=7, ftol=1e-8, bounds=tuple((i, -10.0, 10.0) for i in (0, 2)) + ((1, max(v[1] for v in theta.values()) + limit, 10.0),))
    pts = spark.createDataFrame([(t, *map(float, v), True) for t, v in enumerate(x)], "track_id long, x double, y double, z double, is_fixed boolean")
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in start.items()], "cam_id long, theta array<double>")
    params, moved, costs = solve.adjust(spark, o, pts, df, None, kept, settings=s)
    low = s.bounds[-1][1]
    assert all(v[1] >= low - 1e-12 for v in params.values())
    # each camera by itself: projected steps with small damping
    for c in theta:
        mine = [(t, col, row) for t, k, col, row in obs if k == c]
        at = np.array([x[t] for t, _, _ in mine])
        want = np.array([r[1:] for r in mine])
        cost = lambda v: float(((solve._see(None, at, v, None, "perspective") - want) ** 2).sum())
        v = _with(start[c], 1, max(start[c][1], low))
        for _ in range(300):
            f = solve._see(None, at, v, None, "perspective")
            j = np.stack([(solve._see(None, at, v + 1e-7 * np.eye(len(v))[k], None, "perspective") - f).ravel() / 1e-7 for k in range(3)], axis=1)
            free = [k for k in range(3) if not (k == 1 and v[1] <= low and (j.T @ (f - want).ravel())[1] > 0)]
            d = np.zeros(3)
            d[free] = -np.linalg.lstsq(j[:, free], (f - want).ravel(), rcond=None)[0]
            new = np.r_[v[:3] + d, v[3:]]
            new[1] = max(new[1], low)
            if cost(new) > cost(v) - 1e-10:
                break
            v = new
        assert cost(params[c]) <= 1.02 * cost(v) + 1e-6, c


def _with(v, k, value):
    out = np.array(v, float)
    out[k] = value
    return out


def test_steps_turn_back_at_bounds():
    low, high = np.array([-1.0, -1.0]), np.array([1.0, 1.0])
    assert len(solve.within(np.zeros(2), np.array([0.5, -0.5]), low, high)) == 1
    near, back, cut = solve.within(np.array([0.5, 0.0]), np.array([1.0, 0.5]), low, high)
    assert np.allclose(near, 0.995 * 0.5 * np.array([1.0, 0.5])) and np.allclose(back, [0.0, 0.5]) and np.allclose(cut, [0.5, 0.5])
    with pytest.raises(ValueError):
        solve.Settings(bounds=((0, -1.0, 1.0),))


def test_a_batch_holds_as_many_models_as_points():
    """One point a camera, as a large table deals them: the kernels take a model for each point, and a bad point
    leaves the others as they are."""
    ms = [model(k) | {"lon_off": 10.0 + k / 100} for k in range(40)]
    every = {f: np.array([m[f] for m in ms], float) for f in geometry.FIELDS}
    col, row, alt = g.uniform(500, 3500, (3, 40))
    col[7] = np.nan
    got = kernels.localize(every, col, row, alt / 10)
    one = np.stack([kernels.localize(m, [c], [r], [h])[:, 0] for m, c, r, h in zip(ms, col, row, alt / 10, strict=True)], axis=1)
    assert np.isnan(got[:, 7]).all() and np.allclose(got, one, atol=1e-11, rtol=0, equal_nan=True)
    ok = np.arange(40) != 7
    assert np.allclose(kernels.project(every, *got, alt / 10)[:, ok], np.stack([col, row])[:, ok], atol=1e-6)
