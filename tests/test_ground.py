"""Footprints, poses, names, formats and summaries that DuckDB's SQL does not reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions import geodesy, kernels, names
from rayloom.operators import footprints, geometry, pairs, plane
from rayloom.sources import files

g = np.random.default_rng(11)
FIELDS = "cam_id long, " + ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in geometry.FIELDS)


def model(k: int) -> dict:
    num = lambda *v: list(v) + [0.0] * (20 - len(v))
    tilt = [(0.25, 0.05), (-0.25, 0.1), (0.05, -0.3)][k % 3]
    return {
        "lon_off": 10.0, "lat_off": 45.0, "alt_off": 300.0, "lon_scale": 0.05, "lat_scale": 0.05, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0,
        "col_num": num(0.01, 1.0, 0.02, tilt[0], 0.001), "col_den": num(1.0, 0.001, 0.0005, 0.0002), "row_num": num(-0.02, 0.03, -1.0, tilt[1], 0.0, 0.001), "row_den": num(1.0, 0.0003, -0.001, 0.0001),
    }


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame([tuple({"cam_id": k, **model(k)}[c] for c in ["cam_id", *geometry.FIELDS]) for k in range(3)], FIELDS)


def test_known_utm_point(spark):
    e, n = geodesy.to_utm(F.lit(7.5), F.lit(51.2), F.lit(32))
    p = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(p.e - 395201.31) < 0.01 and abs(p.n - 5673135.24) < 0.01  # published values of this point
    s = spark.range(1).select(*[c.alias(k) for c, k in zip(geodesy.transform([F.lit(-70.0), F.lit(-33.0), F.lit(5.0)], 4326, 32719), "enh", strict=True)])
    back = s.select(*[c.alias(k) for c, k in zip(geodesy.transform([F.col(k) for k in "enh"], 32719, 4979), "xyz", strict=True)]).first()
    assert np.allclose(tuple(back), (-70.0, -33.0, 5.0), atol=1e-9) and 6e6 < s.first().n < 1e7
    with pytest.raises(ValueError):
        geodesy.transform([F.lit(0.0)] * 3, 4326, 3857)


def test_union_of_turned_squares(spark):
    """Areas of unions and of what two cover, against points drawn at random."""
    rows, rings = [], []
    for m in range(7):
        a, c, r = g.uniform(0, 7), g.uniform(0, 3, 2), g.uniform(0.5, 1.2)
        ring = np.array([c + r * np.array([np.cos(a + k * np.pi / 2), np.sin(a + k * np.pi / 2)]) for k in range(4)])
        ring = ring if m % 2 else ring[::-1]
        rings.append(ring)
        rows += [("a", m, k, float(x), float(y)) for k, (x, y) in enumerate(ring)]
    rows += [("b", m, k, float(x), float(y)) for m in (1, 2) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]  # the same square twice
    df = spark.createDataFrame(rows, "g string, m int, i int, x double, y double")
    area = {r.g: r.area for r in footprints.union_areas(df, "g", "m").collect()}
    border = footprints.seen_twice(df, "g", "m")
    twice = {r.g: r.a for r in border.groupBy("g").agg((F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2).alias("a")).collect()}
    p = g.uniform(-2, 5, (400_000, 2))
    n = np.zeros(len(p), int)
    for ring in rings:
        s = [(b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True)]
        n += np.all(np.array(s) >= 0, axis=0) | np.all(np.array(s) <= 0, axis=0)
    assert abs(area["a"] - 49 * (n > 0).mean()) < 0.1 and abs(twice["a"] - 49 * (n > 1).mean()) < 0.1
    assert area["b"] == pytest.approx(1) and twice["b"] == pytest.approx(1)


def test_repair_keeps_rings_that_are_right(spark):
    rows = [("ok", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 2), (2, 1), (0, 2)])] + [("bad", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 1.5), (1, 0), (0, 1)])]
    got = footprints.repaired(spark.createDataFrame(rows, "g string, i int, x double, y double"), "g").orderBy("g", "i").collect()
    ring = lambda n: [(r.x, r.y) for r in got if r.g == n]
    assert ring("ok") == [(0, 0), (4, 0), (4, 2), (2, 1), (0, 2)]
    assert kernels.area(np.array(ring("bad"))) > kernels.area(np.array([(0, 0), (1, 1.5), (1, 0), (0, 1)]))


def test_footprints_make_pairs(spark, models):
    crops = models.select("cam_id", F.lit(0.0).alias("col0"), F.lit(0.0).alias("row0"), F.lit(4000.0).alias("width"), F.lit(4000.0).alias("height"), F.lit(300.0).alias("alt"))
    f = footprints.footprints(crops, models)
    c = spark.createDataFrame([(k, 4e6 + 2e5 * k, 7e5, 4.5e6) for k in range(3)], "cam_id long, cx double, cy double, cz double")
    p = footprints.footprint_pairs(f, c)
    q = pairs.qualify_pairs(p).collect()
    assert {(r.cam_i, r.cam_j) for r in q} == {(0, 1), (0, 2), (1, 2)} and all(0.9 < r.overlap <= 1 for r in q)
    assert {(r.cam_i, r.cam_j): round(r.baseline) for r in q}[(0, 2)] == 400_000
    # corners come back where the model sees them
    seen = geometry.project(f.select("cam_id", F.col("i").cast("long").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.lit(300.0).alias("alt")), models).collect()
    assert {(round(r.col), round(r.row)) for r in seen} == {(0, 0), (0, 4000), (4000, 0), (4000, 4000)}


def test_covered_crops(spark):
    inside = [(1, float(c), float(r)) for c in (-10, 50, 110) for r in (-10, 50, 110)]
    short = [(2, float(c), float(r)) for c, r in ((-10, -10), (110, -10), (110, 110), (5, 110), (-10, 60))]
    crops = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 0.0, 0.0, 100.0, 100.0)], "cam_id long, col0 double, row0 double, width double, height double")
    got = {r.cam_id: r.covered for r in geometry.covered(spark.createDataFrame(inside + short, "cam_id long, col double, row double"), crops).collect()}
    assert got == {1: True, 2: False}


def test_matrix_near_a_model(spark, models):
    got = geometry.approximated(models, 5).collect()
    assert len(got) == 3 and all(r.worst < 10 for r in got)
    c = geometry.decomposed(geometry.approximated(models, 5), "perspective").collect()
    assert all(r.cx_ecef is not None for r in c)


def test_plane_fits_against_numpy(spark):
    x = g.normal(size=(50, 2))
    y = x @ np.array([[1.2, 0.1], [-0.3, 0.8]]) + [3, -1] + g.normal(scale=0.01, size=(50, 2))
    m = spark.createDataFrame([(1, 2, *map(float, r)) for r in np.c_[x, y]], "cam_i long, cam_j long, x1 double, y1 double, x2 double, y2 double")
    h = plane.affine_maps(m).first()
    v = np.linalg.svd(np.c_[x - x.mean(0), y - y.mean(0)])[2]
    expected = v[:2, 2:].T @ np.linalg.inv(v[:2, :2].T)
    assert np.allclose([[h.h00, h.h01], [h.h10, h.h11]], expected)
    f = plane.affine_fundamentals(m).first()
    n = v[-1]
    assert np.allclose(np.abs([f.c, f.d, f.a, f.b]), np.abs(n))
    assert plane.affine_maps(m.limit(2)).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("/a.b/20200413_151408_x.tif", None, 3725.5), ("plain", "2021:02:03 04:05:06", 59.0), ("/d/.hidden", "never", 86400.25)], "path string, tag string, s double")
    got = df.select(names.image_id(F.col("path")), names.with_suffix(F.col("path"), "_n"), names.acquired(F.col("tag"), F.col("path")).cast("string"), names.clock(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("20200413_151408_x", "/a.b/20200413_151408_x_n.tif", "2020-04-13 15:14:08", "01:02:05.50"), ("plain", "plain_n", "2021-02-03 04:05:06", "00:00:59.00"), (".hidden", "/d/.hidden_n", None, "24:00:00.25")]


def test_xml_models(spark, tmp_path):
    m = model(1)
    tags = {"LINE": "row", "SAMP": "col", "LAT": "lat", "LONG": "lon", "HEIGHT": "alt"}
    ends = [(f"{t}_{e}", m[f"{k}_{e.lower()}"] + (1 if (t in ("LINE", "SAMP") and e == "OFF") else 0)) for t, k in tags.items() for e in ("OFF", "SCALE")]
    poly = [(f"{t}_{p}_COEFF_{i + 1}", m[f"{k}_{p.lower()}"][i]) for t, k in (("SAMP", "col"), ("LINE", "row")) for p in ("NUM", "DEN") for i in range(20)]
    xml = lambda items: "".join(f"<{t}>{v!r}</{t}>\n" for t, v in items)
    (tmp_path / "numbered.XML").write_text(f"<?xml version='1.0'?>\n<R><Direct_Model>{xml([(t, 7.0) for t, _ in poly])}</Direct_Model>\n<Inverse_Model>{xml(poly)}</Inverse_Model>\n<V>{xml(ends)}</V></R>")
    flat = [(f"{t}{e}", m[f"{k}_{'off' if e == 'OFFSET' else 'scale'}"]) for t, k in tags.items() for e in ("OFFSET", "SCALE")]
    lists = "".join(f"<{t}{p}COEFList>\n<{t}{p}COEF>{' '.join(map(repr, m[f'{k}_{p.lower()}']))}</{t}{p}COEF></{t}{p}COEFList>" for t, k in (("SAMP", "col"), ("LINE", "row")) for p in ("NUM", "DEN"))
    (tmp_path / "listed.XML").write_text(f"<isd><RPB>{xml(flat)}{lists}</RPB></isd>")
    (tmp_path / "plain.rpc").write_text("\n".join(f"{t}: {v - (1 if t in ('LINE_OFF', 'SAMP_OFF') else 0)!r}" for t, v in ends) + "\n" + "\n".join(f"{t}: {v!r}" for t, v in poly))
    got = {r.image_id: r for r in files.read_rpc_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"numbered", "listed", "plain"}
    for r in got.values():
        assert all(np.allclose(r[f], m[f]) for f in geometry.FIELDS), r.image_id
    tagged = files.rpc_tags(files.read_rpc_files(spark, str(tmp_path))).first().tags
    assert len(tagged["LINE_NUM_COEFF"].split()) == 20 and float(tagged["LAT_OFF"]) == 45.0


def test_sinks(spark, tmp_path):
    p = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0], [0.0, 0.0, 1.0, 2.0]]
    m = spark.createDataFrame([("one", p, 1.0, 2.0, 30.0, 40.0)], "image_id string, p array<array<double>>, col0 double, row0 double, width double, height double")
    assert json.loads(files.matrix_json(m).first().value) == {"P": p, "height": 40, "width": 30, "col_offset": 1, "row_offset": 2}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one_pinhole.json").write_text(files.matrix_json(m).first().value)
    r = files.read_matrices(spark, f"{tmp_path}/m", "_pinhole").first()
    assert (r.image_id, r.col0, r.row0, r.width, r.height, r.p[0][3], r.p[2][3]) == ("one", 1, 2, 30, 40, 2.0, 1.0)
    lines = files.params_lines(spark.createDataFrame([("one", {"R": [0.5, 1e-9]})], "image_id string, params map<string, array<double>>"))
    assert [x.value for x in lines.orderBy("i").collect()] == ["R", "0.5000000000000000 0.0000000010000000"]
    files.write_lines(lines, f"{tmp_path}/params")
    assert (spark.read.text(f"{tmp_path}/params").count()) == 2
    pts = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    files.write_points(pts, spark.createDataFrame([(1.0, 1.0, 1.0)], "dx double, dy double, dz double"), f"{tmp_path}/ply")
    assert sorted(tuple(x) for x in files.read_point_cloud(spark, f"{tmp_path}/ply").collect()) == [(0, 1, 2), (3, 4, 5)]
    files.write_list(spark.createDataFrame([("/a/b.tif",)], "path string"), f"{tmp_path}/list")
    assert [x.path for x in files.read_list(spark, f"{tmp_path}/list").collect()] == ["/a/b.tif"]


def test_predefined_matches_round_trip(spark, tmp_path):
    kp = spark.createDataFrame([(c, k, 1.0 * k, 2.0 * c, 1.5, [0.0]) for c in (0, 1) for k in (0, 1)], "cam_id long, kp_id long, col double, row double, scale double, desc array<double>")
    images = spark.createDataFrame([(0, "a"), (1, "b")], "cam_id long, image_id string")
    files.write_predefined_matches(kp, spark.createDataFrame([(0, 1, 0, 1)], "cam_i long, cam_j long, kp_i long, kp_j long"), images, f"{tmp_path}/set")
    read = lambda n: spark.read.parquet(f"{tmp_path}/set/{n}")
    assert "desc" not in read("keypoints").columns
    m = files.read_predefined_matches(read("keypoints"), read("matches"), read("images"), spark.createDataFrame([(5, "b"), (9, "a")], "cam_id long, image_id string")).collect()
    assert [(r.cam_i, r.cam_j, r.kp_i, r.kp_j, r.row_i, r.row_j) for r in m] == [(5, 9, 1, 0, 2.0, 0.0)]


def test_discovery_reads_no_contents(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("d/20200413_151408_a.tif", "d/e/20200414_000001_b.tif", "d/c.txt"):
        (tmp_path / n).write_bytes(b"12345")
    f = files.discover(spark, f"{tmp_path}/d")
    assert sorted((r.image_id, r.bytes, str(r.ts)) for r in f.collect()) == [("20200413_151408_a", 5, "2020-04-13 15:14:08"), ("20200414_000001_b", 5, "2020-04-14 00:00:01")]
    assert "content" not in f._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_crops_add_their_terms_in_order(spark):
    """Corners on the borders of pixels: the sums' order decides, as it does in a plain loop."""
    vector = lambda *v: [*map(float, v), *[0.0] * (20 - len(v))]
    lit = {"alt_off": 100.0, "lon_scale": 0.1, "lat_scale": 0.1, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0, "col_num": vector(0, 1, 0.1, 0.05), "col_den": vector(1), "row_num": vector(0, 0.2, -1, 0.03), "row_den": vector(1)}
    rows = [lit | {"cam_id": 25 * k + n, "lon_off": k / 10.0, "lat_off": 40 + n / 5.0} for k in range(100) for n in range(25)]
    schema = "cam_id long, " + ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in geometry.FIELDS)
    df = spark.createDataFrame([tuple(r[c] for c in ("cam_id", *geometry.FIELDS)) for r in rows], schema)
    ring = [(0, 4.9, 42.1), (1, 5.3, 42.07), (2, 5.21, 42.43)]
    got = {r.cam_id: (r.col0, r.row0) for r in footprints.crops_of(spark.createDataFrame(ring, "i int, x double, y double"), df, 250.0).collect()}
    for r in rows:
        at = [(x - r["lon_off"], y - r["lat_off"]) for _, x, y in ring]
        want = min(2000 + 2000 * (p / 0.1 + 0.1 * q / 0.1 + 0.05 * 150 / 500) for p, q in at), min(2000 + 2000 * (0.2 * p / 0.1 - q / 0.1 + 0.03 * 150 / 500) for p, q in at)
        assert got[r["cam_id"]] == tuple(map(int, want))
