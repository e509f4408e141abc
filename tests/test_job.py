"""The job on a made series of acquisitions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions import kernels
from rayloom.operators import geometry, solve
from rayloom.plans import job as jobs
from rayloom.plans import refine
from rayloom.sources import files

g = np.random.default_rng(5)
FIELDS = ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in geometry.FIELDS)
TILTS = ((0.25, 0.05), (-0.25, 0.1), (0.05, -0.3), (-0.1, -0.25))


def model(k: int) -> dict:
    num = lambda *v: list(v) + [0.0] * (20 - len(v))
    return {
        "lon_off": 10.0, "lat_off": 45.0, "alt_off": 300.0, "lon_scale": 0.05, "lat_scale": 0.05, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0,
        "col_num": num(0.01, 1.0, 0.02, TILTS[k][0], 0.001), "col_den": num(1.0, 0.001, 0.0005, 0.0002), "row_num": num(-0.02, 0.03, -1.0, TILTS[k][1], 0.0, 0.001), "row_den": num(1.0, 0.0003, -0.001, 0.0001),
    }


@pytest.fixture(scope="module")
def series(spark):
    n, up = 45, kernels.ecef(10.0, 45.0, 300.0) / np.linalg.norm(kernels.ecef(10.0, 45.0, 300.0))
    x = kernels.ecef(*np.c_[10 + g.uniform(-0.03, 0.03, n), 45 + g.uniform(-0.03, 0.03, n), 300 + g.uniform(-100, 100, n)].T).T
    t0 = datetime.datetime(2024, 1, 1)
    images, models, kps = [], [], []
    for k in range(4):
        name = f"{k:02d}_img"
        images.append((name, "s1" if k % 2 else "s2", t0 + datetime.timedelta(days=k // 2, minutes=k % 2), 0.0, 0.0, 4000.0, 4000.0, 300.0))
        models.append(tuple({"image_id": name, **model(k)}[c] for c in ["image_id", *geometry.FIELDS]))
        centre = kernels.ecef(10.0, 45.0, 300.0) + 5e5 * up
        seen = solve._see(model(k), x, np.zeros(3) if k == 0 else g.normal(scale=2e-6, size=3), centre)
        kps += [(name, t, float(a), float(b), 1.0 + t % 3, [float(v) for v in np.eye(n)[t] * 100]) for t, (a, b) in enumerate(seen + g.normal(scale=0.05, size=(n, 2)))]
    return (
        spark.createDataFrame(images, "image_id string, sensor string, ts timestamp, col0 double, row0 double, width double, height double, alt double"),
        spark.createDataFrame(models, f"image_id string, {FIELDS}"),
        spark.createDataFrame(kps, "image_id string, kp_id long, col double, row double, scale double, desc array<double>"),
    )


def test_date_after_date_goes_on(spark, series, tmp_path):
    images, models, kps = series
    j = jobs.Job(out=f"{tmp_path}/a", method="by_date", filter_pairs=False, ransac_trials=50, slack=100.0, fit_grid=4, rounds=3, clean_outliers=False, fix_reference=True)
    first = jobs.run(spark, j, images.where("ts < '2024-01-02'"), models, kps).collect()
    assert [(r.date_id, r.n_images, r.n_tracks > 30) for r in first] == [("20240101_000000", 2, True)]
    both = jobs.run(spark, jobs.Job(**{**j.__dict__, "reset": False}), images, models, kps).collect()
    assert [r.date_id for r in both] == ["20240102_000000"] and both[0].mean_after < 1.0
    done = jobs.results(spark, f"{tmp_path}/a", "models").select("image_id", "date_id", "rmse").collect()
    assert sorted(r.image_id for r in done) == [f"{k:02d}_img" for k in range(4)] and all(r.rmse < 0.1 for r in done)


QUICK = {"filter_pairs": False, "ransac_trials": 20, "slack": None, "fit_grid": 4, "rounds": 2, "clean_outliers": False}


def counted(monkeypatch):
    """The pairs that each step matches."""
    seen, plain = [], jobs.matched

    def matched(k, cams, models, p, job):
        seen.append(p.count())
        return plain(k, cams, models, p, job)

    monkeypatch.setattr(jobs, "matched", matched)
    return seen


def test_a_resumed_run_takes_new_dates_and_matches_new_pairs_only(spark, series, tmp_path, monkeypatch):
    images, models, kps = series
    seen = counted(monkeypatch)
    j = jobs.Job(out=f"{tmp_path}/c", **QUICK)
    jobs.run(spark, j, images.where("ts < '2024-01-02'"), models, kps)
    first = {r.image_id: r for r in jobs.results(spark, j.out, "models").collect()}
    again = jobs.run(spark, jobs.Job(**{**j.__dict__, "reset": False}), images, models, kps).collect()
    assert [(r.date_id, r.n_images) for r in again] == [("20240102_000000", 2)]
    got = jobs.results(spark, j.out, "models").collect()
    assert sorted(r.image_id for r in got) == [f"{k:02d}_img" for k in range(4)]  # one row an image
    assert all(first[r.image_id].col_num == r.col_num for r in got if r.image_id in first)  # held as they were
    assert seen == [1, 5]  # of six pairs one was there
    p = jobs.results(spark, j.out, "points")
    assert {r.step for r in p.select("step").distinct().collect()} == {"20240101_000000", "20240102_000000"}
    assert jobs.run(spark, jobs.Job(**{**j.__dict__, "reset": False}), images, models, kps).count() == 0
    # all anew, kept matches forgotten: what was there is replaced
    assert [r.n_images for r in jobs.run(spark, jobs.Job(**{**j.__dict__, "rematch": True}), images, models, kps).collect()] == [4] and seen == [1, 5, 6]
    assert jobs.results(spark, j.out, "models").count() == 4 and jobs.results(spark, j.out, "report").count() == 1


def test_a_run_that_dies_leaves_no_part_of_a_step(spark, series, tmp_path, monkeypatch):
    images, models, kps = series
    j = jobs.Job(out=f"{tmp_path}/d", method="by_date", **QUICK)
    plain, left = jobs.refine.refine, [1]

    def dies_later(*a, **b):
        out = plain(*a, **b)
        if left:
            left.pop()
            return out
        bad = out["errors"].withColumn("mean_after", F.raise_error(F.lit("lost")).cast("double"))
        return out | {"errors": bad.unionByName(out["errors"].where("false"))}

    monkeypatch.setattr(jobs.refine, "refine", dies_later)
    with pytest.raises(Exception, match="lost"):
        jobs.run(spark, j, images, models, kps)
    monkeypatch.setattr(jobs.refine, "refine", plain)
    s = jobs.Store(spark, j.out)
    assert list(s.owners()) == ["20240101_000000"] and s.read("models", "date_id").count() == 2
    rest = jobs.run(spark, jobs.Job(**{**j.__dict__, "reset": False}), images, models, kps).collect()
    assert [r.date_id for r in rest] == ["20240102_000000"]
    for t in ("models", "points", "errors", "report"):
        assert jobs.results(spark, j.out, t).count() > 0
    assert jobs.results(spark, j.out, "models").count() == 4 and jobs.results(spark, j.out, "report").count() == 2


def test_a_date_without_keypoints_does_not_stop_a_series(spark, series, tmp_path):
    images, models, kps = series
    j = jobs.Job(out=f"{tmp_path}/e", method="by_date", n_dates=0, **QUICK)
    r = jobs.run(spark, j, images, models, kps.where("image_id >= '02'")).collect()
    assert [(x.date_id, x.n_images, x.n_tracks > 0, x.mean_after is None) for x in r] == [("20240101_000000", 2, False, True), ("20240102_000000", 2, True, False)]
    assert jobs.results(spark, j.out, "models").count() == 4


def test_points_of_dates_that_are_done_stay(spark, series, tmp_path):
    """Tracks that only old cameras see keep the points that these give, and old models stay."""
    images, models, kps = series
    half = kps.where("image_id < '02' OR kp_id < 20")
    j = jobs.Job(out=f"{tmp_path}/f", method="by_date", **QUICK)
    r = jobs.run(spark, j, images, models, half).collect()
    n = r[0].n_tracks
    assert n > 35 and r[1].n_tracks == n
    s = jobs.results(spark, j.out, "points")
    assert s.where("step = '20240102_000000'").count() == n
    old = jobs.results(spark, j.out, "models").where("image_id < '02'").drop("date_id").withColumn("cam_id", F.substring("image_id", 1, 2).cast("long"))
    obs = half.where("image_id < '02' AND kp_id >= 20").select(F.col("kp_id").alias("track_id"), F.substring("image_id", 1, 2).cast("long").alias("cam_id"), "col", "row")
    pair = spark.createDataFrame([(0, 1)], "cam_i long, cam_j long")
    want = sorted(tuple(round(v, 3) for v in x) for x in refine.first_points(obs, pair, old).select("x", "y", "z").collect())
    got = {tuple(round(v, 3) for v in x) for x in s.where("step = '20240102_000000'").select("x", "y", "z").collect()}
    assert len(want) == 25 and len(set(want) & got) >= 25 - (45 - n)


@pytest.mark.parametrize("kind", ["perspective", "affine"])
def test_matrix_cameras_leave_matrices_and_files(spark, series, tmp_path, kind):
    images, models, kps = series
    j = jobs.Job(out=f"{tmp_path}/g", kind=kind, **(QUICK | {"ransac": None}))
    jobs.run(spark, j, images.where("ts < '2024-01-02'"), models, kps)
    m = jobs.results(spark, j.out, "matrices").collect()
    assert sorted(r.image_id for r in m) == ["00_img", "01_img"]
    x = kernels.ecef(10.001, 45.001, 310.0)
    for r in m:
        for p in (np.array(r.p), np.array(r.p_first)):
            u = p @ np.r_[x, 1]
            assert np.linalg.norm(u[:2] / u[2] - kernels.project(model(int(r.image_id[:2])), 10.001, 45.001, 310.0).ravel()) < 30
    jobs.write_files(spark, j.out, f"{tmp_path}/files")
    back = files.read_matrices(spark, f"{tmp_path}/files/matrices/*/*").count()
    assert back == 2 and spark.read.text(f"{tmp_path}/files/models").where("value LIKE 'LINE_OFF%'").count() == 2


def test_an_area_is_its_polygon_not_its_box(spark, series):
    images, models, kps = series
    cams = images.where("ts < '2024-01-02'").withColumn("cam_id", F.substring("image_id", 1, 2).cast("long"))
    m = models.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id")
    k = kps.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id")
    p = spark.createDataFrame([(0, 1, True)], "cam_i long, cam_j long, triangulate boolean")
    ring, hole = ((9.97, 44.97), (9.97, 45.03), (10.03, 44.97)), ((9.975, 44.975), (9.975, 45.0), (10.0, 44.975))
    n = lambda area: jobs.matched(k, cams, m, p, jobs.Job(out="", matcher="ratio", ransac=None, slack=None, area=area)).count()
    whole, box, half, less = n(None), n(((9.97, 44.97), (9.97, 45.03), (10.03, 45.03), (10.03, 44.97))), n(ring), n((ring, hole))
    assert whole >= box > half > less > 0


def test_all_dates_with_selected_tracks(spark, series, tmp_path):
    images, models, kps = series
    stored = spark.createDataFrame([(f"{i:02d}_img", f"{k:02d}_img", t, t) for i in range(4) for k in range(i) for t in range(45)], "image_i string, image_j string, kp_i long, kp_j long")
    j = jobs.Job(out=f"{tmp_path}/b", method="windowed", matcher="stored", filter_pairs=False, select=12, fit_grid=4, rounds=2, clean_outliers=False, most_first_error=500.0)
    r = jobs.run(spark, j, images, models, kps, stored).first()
    assert r.n_images == 4 and 5 <= r.n_tracks <= 45 and r.mean_after < r.mean_before
    e = jobs.results(spark, f"{tmp_path}/b", "errors")
    assert e.where("cam_id IS NULL").count() == 1 and e.count() == 5


def test_matchers_agree(spark, series):
    images, models, kps = series
    cams = images.where("ts < '2024-01-02'").withColumn("cam_id", F.substring("image_id", 1, 2).cast("long")).withColumns({"date_idx": F.lit(0), "adjusted": F.lit(False)})
    m = models.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id")
    k = kps.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id")
    p = spark.createDataFrame([(0, 1, True)], "cam_i long, cam_j long, triangulate boolean")
    for name in ("ratio", "epipolar", "window"):
        j = jobs.Job(out="", matcher=name, window=900.0, line_distance=30.0, ransac=None, slack=None)
        got = jobs.matched(k, cams, m, p, j).collect()
        # one that stands alone near a line is taken without a second to compare it with
        assert sum(r.kp_i == r.kp_j for r in got) >= 40 and sum(r.kp_i != r.kp_j for r in got) <= 3, name


def test_settings():
    j = jobs.Job.read({"out": "x", "correct": ["R", "T"], "allowed_pairs": [["a", "b"]], "other": 3})
    assert j.correct == ("R", "T") and j.allowed_pairs == (("a", "b"),) and j.more == {"other": 3} and j.ratio == 0.6
    with pytest.raises(ValueError):
        jobs.Job.read({"out": "x", "priority": ["length", "colour"]})
    for bad in ({"method": "none"}, {"matcher": "none"}, {"kind": "none"}, {"correct": ["Q"]}):
        with pytest.raises(ValueError):
            jobs.Job.read({"out": "x", **bad})


@pytest.mark.parametrize("kind", ["perspective", "affine"])
def test_matrices_start_near_the_models(spark, series, kind):
    images, models, _ = series
    m = models.withColumn("cam_id", F.substring("image_id", 1, 2).cast("long")).drop("image_id")
    theta = {r.cam_id: np.array(r.theta) for r in refine.starting(m, kind, 5).collect()}
    x = kernels.ecef(10.001, 45.001, 310.0)[None]
    for k, v in theta.items():
        assert np.linalg.norm(solve._see(None, x, v, None, kind)[0] - kernels.project(model(k), 10.001, 45.001, 310.0).ravel()) < 5
    fitted = refine.corrected_models(m.where("cam_id < 2"), None, {k: theta[k] for k in (0, 1)}, 5, kind).collect()
    assert len(fitted) == 2 and all(r.rmse < 0.1 and r.margin >= 10 for r in fitted)
