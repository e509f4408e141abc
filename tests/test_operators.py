"""Relational operators on small fixtures; the queries are held against DuckDB where it is there."""

import datetime
import glob
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.operators import graph, matching, outliers, pairs, polygons, tracks
from rayloom.plans import catalog, ground  # noqa: F401
from rayloom.session import kept

DATA = "/root/testdata/sf0.001"
rnd = random.Random(1)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    return repr(v + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    expected = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == expected


def test_covisibility_keeps_and_drops_the_bound(spark):
    obs = spark.createDataFrame([(t, c) for t in range(3) for c in (1, 2)] + [(9, 1), (9, 3)], "track_id int, cam_id int")
    assert [tuple(r) for r in tracks.covisibility(obs, 3).collect()] == [(1, 2, 3)]
    assert tracks.covisibility(obs, 3, strict=True).count() == 0


def test_components_do_not_depend_on_order(spark):
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    a = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    rnd.shuffle(edges)
    b = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([(y, x) for x, y in edges], "a long, b long")).collect()}
    assert a == b and all(a[x] == a[y] for x, y in edges) and all(a[100 + i] == 100 for i in range(31))


def test_spanning_forest(spark):
    e = [(i, j, rnd.randrange(5)) for i in range(12) for j in range(i) if rnd.random() < 0.5]
    got = graph.spanning_forest(spark.createDataFrame(e, "a long, b long, n long")).collect()
    up = list(range(12))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    weight = 0
    for a, b, n in sorted(e, key=lambda x: -x[2]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            weight += n
    assert sum(r.n for r in got) == weight and len(got) == 12 - len({root(i) for i in range(12)})


def test_tracks_from_matches(spark):
    m = spark.createDataFrame([(1, 2, 10, 20), (2, 3, 20, 30), (1, 3, 11, 31), (2, 3, 21, 30)], "cam_i long, cam_j long, kp_i long, kp_j long")
    t = tracks.tracks_from_matches(m, graph.connected_components).collect()
    assert sorted(sorted((r.cam_id, r.kp_id) for r in t if r.track_id == k) for k in {r.track_id for r in t}) == [[(1, 10), (2, 20), (3, 30)], [(1, 11), (3, 31)]]


def test_elbow_and_outliers(spark):
    e = spark.createDataFrame([("a", 0.01 * i) for i in range(95)] + [("a", 20.0 + i) for i in range(5)] + [("b", 2.0)] * 9, "grp string, err double")
    thr = {r.grp: r.thr for r in outliers.thresholds(e).collect()}
    assert 0.9 <= thr["a"] <= 1.0 and thr["b"] == 2.0
    assert outliers.inliers(e).count() == 95 + 9


def test_rescue_of_poor_cameras(spark):
    p = spark.createDataFrame([(1, 2, 0.5, 200_000.0), (2, 3, 0.5, 10.0), (3, 4, 0.05, 900_000.0), (3, 5, 0.1, 900_000.0)], "cam_i long, cam_j long, overlap double, baseline double")
    assert sorted((r.cam_i, r.cam_j, r.triangulate) for r in pairs.qualify_pairs(p).collect()) == [(1, 2, True), (2, 3, True)]


def test_hull_and_overlap(spark):
    pts = [(1, float(x), float(y)) for x in range(5) for y in range(4)]
    h = polygons.hulls(spark.createDataFrame(pts, "g long, x double, y double"), "g").orderBy("i").collect()
    assert [(r.x, r.y) for r in h] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    sq = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    df = spark.createDataFrame([(1, 2, sq(0.0), sq(1.0)), (1, 3, sq(0.0), sq(5.0))], "cam_i long, cam_j long, footprint_i array<struct<x:double,y:double>>, footprint_j array<struct<x:double,y:double>>")
    assert {r.cam_j: r.overlap for r in polygons.overlap(df).collect()} == {2: pytest.approx(0.5), 3: 0.0}


def test_ransac(spark):
    import numpy as np

    f = np.array([0.3, -0.8, 0.5, 0.4])
    rows = []
    for k in range(120):
        x = np.array([rnd.uniform(0, 500) for _ in range(4)])
        if k < 90:
            x[3] = -(x[:3] @ f[:3] + 2.0) / f[3] + rnd.gauss(0, 0.05)
        rows.append((1, 2, k, k, *map(float, x)))
    m = spark.createDataFrame(rows, "cam_i long, cam_j long, kp_i long, kp_j long, x1 double, y1 double, x2 double, y2 double")
    got = {r.kp_i for r in matching.ransac(m, 0.3, 300).collect()}
    assert len(got & set(range(90))) >= 88 and len(got - set(range(90))) <= 3
    assert matching.ransac(m.where("kp_i < 6")).count() == 0


def test_selected_tracks_span_the_cameras(spark):
    rows = [(t, c, 1.0, 0.1) for t, cs in enumerate([(1, 2), (2, 3), (1, 2), (3, 4), (5, 6), (2, 3, 4)]) for c in cs]
    obs = spark.createDataFrame(rows, "track_id int, cam_id int, scale double, err double")
    got = {(r.tree, r.track_id) for r in tracks.select_tracks(obs, tracks.rank_tracks(obs), 2, kept).collect()}
    assert {t for k, t in got if k == 0} == {5, 0} and {t for k, t in got if k == 1} == {1, 2, 3}


def test_shared_tracks_are_counted_by_more_tasks_where_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(tracks, "TASK", 100)
    seen = sorted({(rnd.randrange(300), rnd.randrange(40)) for _ in range(1500)})
    covis = tracks.covisibility(spark.createDataFrame(seen, "track_id int, cam_id int"), 1)
    assert "hashpartitioning(track_id#" in (plan := covis._jdf.queryExecution().toString()) and f", {math.ceil(len(seen) / 100)}), REPARTITION_BY_NUM" in plan
    want = {}
    for t, i in seen:
        for u, j in seen:
            if t == u and i < j:
                want[i, j] = want.get((i, j), 0) + 1
    assert {(r.cam_i, r.cam_j): r.n for r in covis.collect()} == want
    best = graph.best_neighbours(covis.select(F.col("cam_i").alias("a"), F.col("cam_j").alias("b"), "n"), 2)
    assert best._jdf.queryExecution().sparkPlan().toString().count("Join") == 1  # edges are made once
    of = lambda c: sorted((-n, i + j - c) for (i, j), n in want.items() if c in (i, j))[:2]
    assert {(r.a, r.b, r.n, r.place) for r in best.collect()} == {(c, b, -n, place) for c in range(40) for place, (n, b) in enumerate(of(c), 1)}


def test_window_match_is_strict(spark):
    kp = spark.createDataFrame([(1, 0.0, 0.0, [0.0, 0.0]), (2, 100.0, 0.0, [5.0, 5.0])], "kp_id long, x double, y double, desc array<double>")
    other = spark.createDataFrame([(7, 29.9, 0.0, [3.0, 4.0]), (8, 30.1, 0.0, [0.0, 0.0])], "kp_id long, x double, y double, desc array<double>")
    assert [tuple(r) for r in matching.window_match(kp, other, 30, 250).collect()] == [(1, 7, 5.0)]
    assert matching.window_match(kp, other, 30, 5).count() == 0


def test_windows_meet_what_their_radius_reaches(spark, monkeypatch):
    """On both axes: a strip along one of them would compare a fifth of all pairs here."""
    seen, meet = {}, matching._meet
    monkeypatch.setattr(matching, "_meet", lambda *a: seen.update(turns=a[5]) or meet(*a))
    kp = spark.createDataFrame([(1, 0.0, 0.0, [0.0])], "kp_id long, x double, y double, desc array<double>")
    assert matching.window_match(kp, kp, 5.0, 1.0).count() == 1
    g = np.random.default_rng(4)
    p, q = g.uniform(0, 100, (4000, 2)), g.uniform(0, 100, (3000, 2))
    met, cells = np.zeros((4000, 3000), np.int8), 0
    for i, j, ok in seen["turns"](p, q):
        met[np.ix_(i, j)] += ok
        cells += ok.size
    assert (met == (((p[:, None] - q[None]) ** 2).sum(axis=2) <= 25)).all() and cells < 0.1 * met.size


def test_plans_have_no_cartesian_product(spark, con):
    for name in ("covisibility", "idw", "ratio_match", "local_window_match", "date_window_pairs", "timeline_groups", "pair_qualification"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = catalog.QUERIES["bbox_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_streamed_groups_are_the_batch_groups(spark, tmp_path):
    from datetime import datetime, timedelta

    from rayloom.streaming import timeline

    t0 = datetime(2024, 1, 1)
    rows = sorted((t0 + timedelta(minutes=rnd.randrange(2000)), i, i % 3) for i in range(200))
    df = spark.createDataFrame([(s, i, t) for t, i, s in rows], "scene long, id long, ts timestamp")
    for k in range(4):
        spark.createDataFrame([(s, i, t) for t, i, s in rows[50 * k : 50 * k + 50]], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = timeline.stream_groups(stream).writeStream.format("memory").queryName("groups").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    expected = {r.id: r.anchor for r in pairs.timeline(df).collect()}
    assert {r.id: r.anchor for r in spark.table("groups").collect()} == expected
    w = timeline.windowed_errors(stream.select("ts", F.col("scene").alias("cam"), F.col("id").cast("double").alias("err")))
    q = w.writeStream.format("memory").queryName("errs").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("errs").collect()) == 200


def test_timeline_groups_all_folds_every_user(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(35, 60), start + datetime.timedelta(minutes=rnd.randrange(3000))) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    expected = {}
    for user in {r[1] for r in rows}:
        anchor = None
        for ts, i in sorted((r[2], r[0]) for r in rows if r[1] == user):
            anchor = ts if anchor is None or ts - anchor >= datetime.timedelta(minutes=120) else anchor
            expected[i] = anchor
    assert {r.event_id: r.anchor for r in catalog.QUERIES["timeline_groups_all"](spark, str(tmp_path)).collect()} == expected


def test_matches_all_pairs_of_images(spark, tmp_path):
    rows = [(i, i % 7, [rnd.uniform(-0.2, 0.2) for _ in range(4)]) for i in range(140)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ratio, top, window = set(), set(), set()
    for i in range(7):
        for j in range(i + 1, 7):
            found = []
            for k, label, v in rows:
                if label == i:
                    near = sorted((round(math.dist(v, w), 9), x) for x, other, w in rows if other == j)
                    if near[0][0] < 0.97 * near[1][0]:
                        found.append((near[0][0], k, near[0][1]))
                    beside = [(round(math.dist(v, w), 9), x) for x, other, w in rows if other == j and (v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2 <= 0.05**2]
                    window |= {(i, j, k, min(beside)[1])} if beside else set()
            ratio |= {(i, j, a, b) for _, a, b in found}
            top |= {(i, j, a, b, place) for place, (_, a, b) in enumerate(sorted(found)[:5], 1)}
    rows_of = lambda name, n: [tuple(r)[:n] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    for name, n, expected in (("ratio_match_all", 4, ratio), ("top_matches_all", 5, top), ("local_window_match_all", 4, window)):
        assert sorted(rows_of(name, n)) == sorted(expected)


def test_image_pairs_all_has_every_camera(spark, tmp_path):
    spark.createDataFrame([(i, i % 25) for i in range(60)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["image_pairs_all"](spark, str(tmp_path)).collect())
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_pairs_are_made_by_all_tasks(spark):
    """A camera table of one file, and few dates: pairs do not land in one task, and are not shuffled."""
    cams = spark.range(2000).coalesce(1).select(F.col("id").alias("cam_id"), (F.col("id") % 2).alias("date_idx"), F.col("id").alias("v"))
    for p, n in ((pairs.all_pairs(cams), 1999000), (pairs.date_window_pairs(cams), 1999000), (pairs.all_pairs(cams, "v").where("v_i = cam_i AND v_j = cam_j"), 1999000)):
        per = [r["count"] for r in p.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(per) == n and len(per) >= 8 and max(per) < n / 4
    q = pairs.qualify_pairs(pairs.all_pairs(cams, "v").select("cam_i", "cam_j", (F.col("v_j") / 2000).alias("overlap"), F.col("v_i").cast("double").alias("baseline")))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_pairs_come_by_tiles(spark, monkeypatch):
    """Rows of pairs near each other have few cameras, else a file of them takes some bytes a pair: each row of cameras ran through all others."""
    monkeypatch.setattr(pairs, "TILE", 8, raising=False)
    got = pairs.all_pairs(spark.range(600).select((F.col("id") * 7919).alias("cam_id"))).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.cam_i // 7919, r.cam_j // 7919) for r in got) == [(i, j) for i in range(600) for j in range(i + 1, 600)]
    runs = [got[k : k + 64] for k in range(0, len(got) - 64, 64)]
    few = [len({r.cam_j for r in run}) <= 24 and len({r.cam_i for r in run}) <= 24 for run in runs if len({r.task for r in run}) == 1]
    assert len(few) > 1000 and all(few)


def test_pairs_of_repeated_and_missing_cameras(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 4, raising=False)
    rows = [(f"c{k // 5:02d}", None if k % 7 == 0 else k) for k in range(60)] + [(None, 1)]
    got = pairs.all_pairs(spark.createDataFrame(rows, "cam_id string, v long"), "v").collect()
    every = [(a, v, b, w) for a, v in rows for b, w in rows if a and b and a < b]
    assert Counter(tuple(r) for r in got) == Counter(every) and got[0].asDict().keys() == {"cam_i", "v_i", "cam_j", "v_j"}
    assert pairs.all_pairs(spark.createDataFrame([], "cam_id long")).count() == 0


def test_pairs_are_qualified_in_one_pass(spark, monkeypatch):
    """Equal to `qualify_pairs` of all pairs, of which only those inside a block and those of cameras without a good one there are
    counted: poor cameras, cameras with a good pair far away, without a value, and of one name."""
    monkeypatch.setattr(pairs, "TILE", 8)
    r = random.Random(8)
    rows = [(k, None if k % 41 == 0 else r.choice([r.uniform(0, 5), 20 + r.uniform(0, 1)] + [-30.0] * (k % 5 == 0) if k < 150 else [60.0])) for k in range(200)] + [(7, 3.0), (None, 1.0), (300, 500.0), (301, float("nan"))]
    cams = spark.createDataFrame(rows, "cam_id long, v double")
    overlap, baseline = F.abs(F.col("v_i") - F.col("v_j")), F.when(F.col("v_j") < 400, F.abs(F.col("v_i") + F.col("v_j")))
    some = dict(least_overlap=2.5, least_baseline=0.5, orbit=100.0)
    every = pairs.qualify_pairs(pairs.all_pairs(cams, "v").withColumns({"overlap": overlap, "baseline": baseline}).select("cam_i", "cam_j", "overlap", "baseline"), **some)
    got = pairs.qualify_all(cams, overlap, baseline, "v", **some)
    assert Counter(map(str, got.collect())) == Counter(map(str, every.collect()))
    kinds = got.select("triangulate", (F.col("baseline") / 100.0 > 0.5).alias("good")).distinct().collect()
    assert {(True, True), (False, False), (True, False), (None, None)} <= {tuple(x) for x in kinds}


def test_all_pairs_are_qualified_without_counting_them(spark, tmp_path):
    """The ends of all pairs were counted, and all pairs made twice."""
    spark.createDataFrame([(i, i * 37 % 997 * 10.0) for i in range(400)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = catalog.QUERIES["pair_qualification"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
