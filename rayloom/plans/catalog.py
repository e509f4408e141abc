"""The queries over the star-schema tables, each with its SQL for DuckDB.

Tables stand in for the library's own: line items are observations (order = track, supplier =
camera), events are errors and acquisitions, embeddings are keypoints with descriptors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cameras, geodesy, rotation
from ..operators import geometry, graph, matching, outliers, pairs, polygons, tracks
from ..session import kept, table
from . import scene

QUERIES, ORACLES = {}, {}

OBS = "SELECT l_orderkey track_id, CAST(l_suppkey AS BIGINT) cam_id, min(l_quantity) scale, avg(l_tax) err FROM lineitem GROUP BY 1, 2"
COVIS = f"obs AS ({OBS}), covis AS (SELECT a.cam_id cam_i, b.cam_id cam_j, count(*) n FROM obs a JOIN obs b ON a.track_id = b.track_id AND a.cam_id < b.cam_id GROUP BY 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def obs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("cam_id")).agg(F.min("l_quantity").alias("scale"), F.avg("l_tax").alias("err"))


def cams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("cam_id"), "s_nationkey")


def errs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("err"))


def kps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("cam_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("desc"))


@query(f"WITH {COVIS} SELECT * FROM covis WHERE n >= 5")
def covisibility(spark, d):
    return tracks.covisibility(obs(spark, d), 5)


@query(f"WITH {COVIS} SELECT * FROM covis WHERE n > 5")
def connectivity_edges(spark, d):
    return tracks.covisibility(obs(spark, d), 5, strict=True)


@query(f"SELECT cam_id, count(*) n_obs FROM ({OBS}) GROUP BY 1")
def obs_per_camera(spark, d):
    return tracks.obs_per_camera(obs(spark, d))


@query(f"WITH o AS ({OBS}) SELECT s_suppkey cam_id, count(o.cam_id) n_obs FROM supplier LEFT JOIN o ON o.cam_id = s_suppkey GROUP BY 1 HAVING count(o.cam_id) < 580")
def weak_cameras(spark, d):
    return tracks.weak_cameras(obs(spark, d), cams(spark, d), 580)


@query(f"SELECT track_id, count(*) \"length\" FROM ({OBS}) GROUP BY 1")
def track_length(spark, d):
    return tracks.track_length(obs(spark, d))


@query(f"SELECT track_id, count(*) \"length\" FROM ({OBS}) GROUP BY 1 HAVING count(*) >= 2")
def valid_tracks(spark, d):
    return tracks.valid_tracks(obs(spark, d))


def _nation_pairs(spark, d):
    a = cams(spark, d)
    p = a.select(F.col("cam_id").alias("cam_i"), "s_nationkey").join(a.select(F.col("cam_id").alias("cam_j"), "s_nationkey"), "s_nationkey")
    return p.where("cam_i < cam_j").select("cam_i", "cam_j")


@query(f"WITH o AS ({OBS}) SELECT DISTINCT a.track_id FROM o a JOIN o b ON a.track_id = b.track_id AND a.cam_id < b.cam_id JOIN supplier x ON x.s_suppkey = a.cam_id JOIN supplier y ON y.s_suppkey = b.cam_id WHERE x.s_nationkey = y.s_nationkey")
def triangulable_tracks(spark, d):
    return tracks.triangulable_tracks(obs(spark, d), _nation_pairs(spark, d))


@query("SELECT s_suppkey cam_id FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_suppkey <> s.s_suppkey)")
def disconnected_cameras(spark, d):
    return tracks.disconnected_cameras(cams(spark, d), _nation_pairs(spark, d))


@query(f"WITH o AS ({OBS}) SELECT track_id, cam_id FROM o WHERE track_id IN (SELECT track_id FROM o WHERE cam_id % 7 = 0)")
def free_camera_tracks(spark, d):
    free = cams(spark, d).where("cam_id % 7 = 0").select("cam_id")
    return tracks.restrict_to_free(obs(spark, d), free).select("track_id", "cam_id")


RANKED = f"SELECT track_id, count(*) \"length\", round(avg(scale), 2) mean_scale, round(avg(err), 6) cost FROM ({OBS}) GROUP BY 1"
RANKED = f"SELECT *, row_number() OVER (ORDER BY \"length\" DESC, mean_scale, cost, track_id) \"rank\" FROM ({RANKED})"


@query(RANKED)
def track_ranking(spark, d):
    return tracks.rank_tracks(obs(spark, d))


@query(f"WITH r AS ({RANKED}), o AS ({OBS}), c AS (SELECT cam_id, track_id, \"rank\", row_number() OVER (PARTITION BY cam_id ORDER BY \"rank\") place FROM o JOIN r USING (track_id)) SELECT * FROM c WHERE place <= 20")
def camera_track_lists(spark, d):
    o = obs(spark, d)
    return tracks.camera_track_lists(o, tracks.rank_tracks(o), 20).select("cam_id", "track_id", "rank", "place")


@query(f"SELECT track_id, round(avg(err), 9) mean_err FROM ({OBS}) GROUP BY 1")
def track_mean_error(spark, d):
    return tracks.track_mean_error(obs(spark, d)).withColumn("mean_err", F.round("mean_err", 9))


WEIGHTS = f"""WITH {COVIS}, edges AS (SELECT * FROM covis WHERE n >= 5), deg AS (SELECT cam_id, count(*) degree FROM (SELECT cam_i cam_id FROM edges UNION ALL SELECT cam_j FROM edges) GROUP BY 1),
m AS (SELECT track_id, avg(err) e FROM obs GROUP BY 1), c AS (SELECT cam_id, avg(e) + 3 * stddev_pop(e) cost, count(*) n_obs FROM obs JOIN m USING (track_id) GROUP BY 1)"""


@query(WEIGHTS + " SELECT cam_id, coalesce(degree, 0) degree, round(CASE WHEN degree IS NULL THEN 1 ELSE degree + exp(-cost) END, 6) weight FROM c LEFT JOIN deg USING (cam_id)")
def camera_weights(spark, d):
    return tracks.camera_weights(obs(spark, d), 5).withColumn("weight", F.round("weight", 6))


@query(WEIGHTS + " SELECT cam_id, coalesce(degree, 0) degree, n_obs FROM c LEFT JOIN deg USING (cam_id) ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 1")
def reference_camera(spark, d):
    return tracks.reference_camera(obs(spark, d), 5)


@query("WITH k AS (SELECT l_suppkey cam_id, l_orderkey * 10 + l_linenumber kp_id, l_quantity scale FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY scale DESC, kp_id) place FROM k) SELECT * FROM r WHERE place <= 25")
def keypoint_topk(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cam_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp_id"), F.col("l_quantity").alias("scale"))
    return tracks.keypoint_top_k(k, 25)


MATCHES = "SELECT a.l_suppkey cam_i, b.l_suppkey cam_j, a.l_orderkey * 10 + a.l_linenumber kp_i, b.l_orderkey * 10 + b.l_linenumber kp_j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey"


def _matches(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cam"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp"))
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("cam").alias("cam_i"), F.col("kp").alias("kp_i"))
    b = li.select("l_orderkey", "l_linenumber", F.col("cam").alias("cam_j"), F.col("kp").alias("kp_j"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("cam_i <> cam_j").select("cam_i", "cam_j", "kp_i", "kp_j")


@query(f"WITH m AS ({MATCHES}), i AS (SELECT s_suppkey \"old\", 100000 - s_suppkey \"new\" FROM supplier WHERE s_nationkey < 15) SELECT least(x.\"new\", y.\"new\") cam_i, greatest(x.\"new\", y.\"new\") cam_j, CASE WHEN x.\"new\" > y.\"new\" THEN kp_j ELSE kp_i END kp_i, CASE WHEN x.\"new\" > y.\"new\" THEN kp_i ELSE kp_j END kp_j FROM m JOIN i x ON x.\"old\" = cam_i JOIN i y ON y.\"old\" = cam_j")
def match_reindex(spark, d):
    ids = cams(spark, d).where("s_nationkey < 15").select(F.col("cam_id").alias("old"), (F.lit(100000) - F.col("cam_id")).alias("new"))
    return tracks.reindex_matches(_matches(spark, d), ids)


@query(f"""WITH RECURSIVE m AS ({MATCHES}), e AS (SELECT kp_i a, kp_j b FROM m UNION SELECT kp_j, kp_i FROM m), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
k AS (SELECT cam_i cam_id, kp_i kp_id FROM m UNION SELECT cam_j, kp_j FROM m), root AS (SELECT x kp_id, min(y) track_id FROM r GROUP BY 1) SELECT track_id, cam_id, min(kp_id) kp_id FROM k JOIN root USING (kp_id) GROUP BY 1, 2""")
def tracks_from_matches(spark, d):
    m = _matches(spark, d)
    labels = graph.connected_components(m.select(F.col("kp_i").alias("a"), F.col("kp_j").alias("b")))
    k = m.select("cam_i", "kp_i").union(m.select("cam_j", "kp_j")).distinct().toDF("cam_id", "node")
    return k.join(labels, "node").groupBy(F.col("component").alias("track_id"), "cam_id").agg(F.min("node").alias("kp_id"))


ELBOW = """e AS (SELECT event_type grp, value err, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 i, count(*) OVER (PARTITION BY event_type) n, min(value) OVER (PARTITION BY event_type) lo, max(value) OVER (PARTITION BY event_type) hi FROM events WHERE value IS NOT NULL),
o AS (SELECT *, round(abs((hi - lo) * i - (n - 1) * (err - lo)), 6) off FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY off DESC, i) k FROM o),
q AS (SELECT event_type grp, quantile_cont(value, 0.8) c FROM events GROUP BY 1), el AS (SELECT grp, n, err elbow, hi high, err >= c found FROM b JOIN q USING (grp) WHERE k = 1)"""


@query(f"WITH {ELBOW} SELECT * FROM el")
def camera_elbow(spark, d):
    return outliers.elbows(errs(spark, d))


@query(f"WITH {ELBOW}, t AS (SELECT grp, round_even(CASE WHEN found THEN greatest(elbow, 1.0) ELSE high END, 2) thr FROM el) SELECT event_id, value err, thr FROM events JOIN t ON grp = event_type WHERE value <= thr")
def outlier_removal(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("grp"), F.col("value").alias("err"))
    return outliers.inliers(e).select("event_id", "err", "thr")


@query("WITH m AS (SELECT min(value) lo, max(value) hi FROM events) SELECT CAST(least(floor((value - lo) * 40 / (hi - lo)), 39) AS INTEGER) bin, count(*) n FROM events, m WHERE value IS NOT NULL GROUP BY 1")
def error_histogram(spark, d):
    return outliers.histogram(errs(spark, d).where("err IS NOT NULL"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.05) lo, quantile_cont(value, 0.95) hi FROM events GROUP BY 1) SELECT event_id, round(255 * (least(greatest(value, lo), hi) - lo) / (hi - lo), 6) scaled FROM events JOIN q USING (event_type)")
def equalize(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("grp"), F.col("value").alias("v"))
    return outliers.equalize(e).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("SELECT event_type cam, count(*) n FROM events WHERE value > 50 GROUP BY 1")
def high_error_counts(spark, d):
    return errs(spark, d).where("err > 50").groupBy(F.col("grp").alias("cam")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(power((l_quantity - 25) / (1 + l_tax), 2) + power((l_discount - 0.05) / (1 + l_tax), 2)), 9) err FROM lineitem")
def reproj_error(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("dx"), (F.col("l_discount") - 0.05).alias("dy"), (1 + F.col("l_tax")).alias("w"))
    return outliers.reprojection_error(r).select("l_orderkey", "l_linenumber", F.round("err", 9).alias("err"))


@query("SELECT round(avg(-l_extendedprice * l_discount), 4) dx, round(avg(l_tax), 6) dy, round(avg(CAST(l_linenumber AS DOUBLE)), 6) dz FROM lineitem")
def global_drift(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit(0.0).alias("z"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x1"), (F.col("l_quantity") + F.col("l_tax")).alias("y1"), F.col("l_linenumber").cast("double").alias("z1"))
    return outliers.drift(p).select(F.round("dx", 4).alias("dx"), F.round("dy", 6).alias("dy"), F.round("dz", 6).alias("dz"))


@query("SELECT a.s_suppkey cam_i, b.s_suppkey cam_j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def image_pairs(spark, d):
    return pairs.all_pairs(cams(spark, d))


@query()
def image_pairs_all(spark, d):
    """The name of the first round."""
    return image_pairs(spark, d)


@query("""WITH c AS (SELECT s_suppkey cam_id, CAST(s_nationkey AS INTEGER) date_idx FROM supplier) SELECT a.cam_id cam_i, b.cam_id cam_j, a.date_idx di, b.date_idx dj FROM c a JOIN c b ON b.date_idx BETWEEN a.date_idx AND a.date_idx + 1 WHERE b.date_idx > a.date_idx OR a.cam_id < b.cam_id""")
def date_window_pairs(spark, d):
    return pairs.date_window_pairs(cams(spark, d).select("cam_id", F.col("s_nationkey").alias("date_idx")))


@query("""WITH p AS (SELECT a.s_suppkey cam_i, b.s_suppkey cam_j, abs(a.s_acctbal - b.s_acctbal) / 10000 overlap, abs(a.s_acctbal + b.s_acctbal) * 20 baseline FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
m AS (SELECT *, baseline / 500000.0 > 0.25 good FROM p WHERE overlap > 0.1), e AS (SELECT cam_i c, good FROM m UNION ALL SELECT cam_j, good FROM m), poor AS (SELECT c FROM e GROUP BY 1 HAVING NOT bool_or(good))
SELECT cam_i, cam_j, good OR cam_i IN (SELECT c FROM poor) OR cam_j IN (SELECT c FROM poor) triangulate FROM m""")
def pair_qualification(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cam_id"), F.col("s_acctbal").alias("v"))
    overlap, baseline = F.abs(F.col("v_i") - F.col("v_j")) / 10000, F.abs(F.col("v_i") + F.col("v_j")) * 20
    return pairs.qualify_all(c, overlap, baseline, "v").select("cam_i", "cam_j", "triangulate")


@query("""WITH d AS (SELECT DISTINCT CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) date_idx FROM orders), a AS (SELECT *, date_idx % 3 = 0 adjusted FROM d),
r AS (SELECT x.date_idx, y.date_idx prev_idx, row_number() OVER (PARTITION BY x.date_idx ORDER BY y.date_idx DESC) place FROM a x JOIN a y ON y.date_idx < x.date_idx AND y.adjusted) SELECT * FROM r WHERE place <= 2""")
def nearest_adjusted(spark, d):
    o = table(spark, d, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("date_idx")).distinct()
    return pairs.nearest_dates(o.withColumn("adjusted", F.col("date_idx") % 3 == 0), 2).withColumn("place", F.col("place").cast("long"))


@query("""WITH RECURSIVE ev AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) k FROM (SELECT DISTINCT user_id, ts FROM events)),
f(user_id, k, ts, anchor) AS (SELECT user_id, k, ts, ts FROM ev WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.ts, CASE WHEN e.ts - f.anchor >= INTERVAL 120 MINUTE THEN e.ts ELSE f.anchor END FROM f JOIN ev e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, f.anchor FROM events JOIN f USING (user_id, ts)""")
def timeline_groups(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("scene"), "ts", F.col("event_id").alias("id"))
    return pairs.timeline(e, 120).select(F.col("id").alias("event_id"), "anchor")


@query()
def timeline_groups_all(spark, d):
    """The name of the first round."""
    return timeline_groups(spark, d)


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) x, round(CAST(embedding[2] AS DOUBLE), 6) y FROM embeddings WHERE embedding[1] > -0.1 AND embedding[1] < 0.1 AND embedding[2] > -0.1 AND embedding[2] < 0.1")
def bbox_filter(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    box = spark.range(1).select(F.lit(-0.1).alias("x0"), F.lit(0.1).alias("x1"), F.lit(-0.1).alias("y0"), F.lit(0.1).alias("y1"))
    return matching.inside(p, box).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


RATIO = """d AS (SELECT a.label cam_i, b.label cam_j, a.vec_id kp_i, b.vec_id kp_j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) dist FROM embeddings a JOIN embeddings b ON a.label < b.label),
r AS (SELECT *, row_number() OVER w k, lead(dist) OVER w nxt FROM d WINDOW w AS (PARTITION BY cam_i, cam_j, kp_i ORDER BY dist, kp_j)), m AS (SELECT cam_i, cam_j, kp_i, kp_j, dist FROM r WHERE k = 1 AND dist < 0.97 * nxt)"""


def _ratio(spark, d):
    k = kps(spark, d)
    return matching.ratio_match(k, pairs.all_pairs(k.select("cam_id").distinct()), 0.97)


@query(f"WITH {RATIO} SELECT cam_i, cam_j, kp_i, kp_j, round(dist, 6) dist FROM m")
def ratio_match(spark, d):
    return _ratio(spark, d).withColumn("dist", F.round("dist", 6))


@query(f"WITH {RATIO}, t AS (SELECT *, row_number() OVER (PARTITION BY cam_i, cam_j ORDER BY dist, kp_i, kp_j) place FROM m) SELECT cam_i, cam_j, kp_i, kp_j, place FROM t WHERE place <= 5")
def top_matches(spark, d):
    return matching.top_matches(_ratio(spark, d), 5).select("cam_i", "cam_j", "kp_i", "kp_j", "place")


@query()
def ratio_match_all(spark, d):
    """The name of the first round."""
    return ratio_match(spark, d)


@query()
def top_matches_all(spark, d):
    """The name of the first round."""
    return top_matches(spark, d)


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding AS DOUBLE[]) e FROM embeddings), m AS (SELECT a.label cam_i, b.label cam_j, a.vec_id kp_i, b.vec_id kp_j, round(list_distance(a.e, b.e), 9) dist FROM p a JOIN p b ON a.label < b.label AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.05 * 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY cam_i, cam_j, kp_i ORDER BY dist, kp_j) k FROM m) SELECT cam_i, cam_j, kp_i, kp_j, round(dist, 6) dist FROM r WHERE k = 1 AND dist < 250""")
def local_window_match(spark, d):
    p = kps(spark, d).withColumns({"x": F.col("desc")[0].cast("double"), "y": F.col("desc")[1].cast("double")})
    both = pairs.all_pairs(p.select("cam_id").distinct())
    a, b = (both.join(p.withColumnRenamed("cam_id", c), c) for c in ("cam_i", "cam_j"))
    return matching.window_match(a, b, 0.05, 250, ("cam_i", "cam_j")).withColumn("dist", F.round("dist", 6))


@query()
def local_window_match_all(spark, d):
    """The name of the first round."""
    return local_window_match(spark, d)


FUND = [[1e-4, 2e-3, -0.3], [-1e-3, 2e-4, 0.5], [0.2, -0.6, 0.1]]
EPI = """x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) x1, CAST(embedding[2] AS DOUBLE) y1, CAST(embedding[3] AS DOUBLE) x2, CAST(embedding[4] AS DOUBLE) y2 FROM embeddings),
l AS (SELECT *, 1e-4*x1+2e-3*y1-0.3 a, -1e-3*x1+2e-4*y1+0.5 b, 0.2*x1-0.6*y1+0.1 c, 1e-4*x2-1e-3*y2+0.2 p, 2e-3*x2+2e-4*y2-0.6 q, -0.3*x2+0.5*y2+0.1 r FROM x)"""


@query(f"WITH {EPI} SELECT vec_id, round(greatest(power(a*x2+b*y2+c, 2)/(a*a+b*b), power(p*x1+q*y1+r, 2)/(p*p+q*q)), 9) d2 FROM l WHERE greatest(power(a*x2+b*y2+c, 2)/(a*a+b*b), power(p*x1+q*y1+r, 2)/(p*p+q*q)) < 0.2*0.2")
def epipolar_inliers(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return matching.epipolar_inliers(m, FUND, 0.2).select("vec_id", F.round("d2", 9).alias("d2"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z, CAST(embedding[4] AS DOUBLE) u, CAST(embedding[5] AS DOUBLE) v FROM embeddings), m AS (SELECT q.vec_id q_id, p.z, sqrt(power(q.u - p.x, 2) + power(q.v - p.y, 2)) d, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(power(q.u - p.x, 2) + power(q.v - p.y, 2)), p.vec_id) k FROM p q, p)
SELECT q_id, round(coalesce(max(CASE WHEN k = 1 AND d < 1e-10 THEN z END), sum(z / greatest(d, 1e-300)) / sum(1 / greatest(d, 1e-300))), 6) z FROM m WHERE k <= 8 GROUP BY 1""")
def idw(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyzuv")])
    return matching.idw(e.select(F.col("vec_id").alias("p_id"), "x", "y", "z"), e.select(F.col("vec_id").alias("q_id"), F.col("u").alias("x"), F.col("v").alias("y"))).withColumn("z", F.round("z", 6))


CC = f"WITH RECURSIVE {COVIS}, e AS (SELECT cam_i a, cam_j b FROM covis WHERE n >= 9 UNION SELECT cam_j, cam_i FROM covis WHERE n >= 9), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)"


@query(CC + " SELECT x node, min(y) component FROM r GROUP BY 1")
def connected_components(spark, d):
    return graph.connected_components(tracks.covisibility(obs(spark, d), 9).select(F.col("cam_i").alias("a"), F.col("cam_j").alias("b")))


@query(CC + """, c AS (SELECT x, min(y) y FROM r GROUP BY 1), l AS (SELECT s_suppkey, coalesce(c.y, s_suppkey) y FROM supplier LEFT JOIN c ON x = s_suppkey), s AS (SELECT y, count(*) n FROM l GROUP BY 1)
SELECT (SELECT count(*) FROM covis WHERE n >= 9) n_edges, count(*) n_components, max(n) largest, CAST(sum(n) - max(n) AS BIGINT) outside FROM s""")
def connectivity_report(spark, d):
    e = tracks.covisibility(obs(spark, d), 9).select(F.col("cam_i").alias("a"), F.col("cam_j").alias("b"))
    return graph.connectivity_report(cams(spark, d).select(F.col("cam_id").alias("node")), e)


@query(f"WITH {COVIS}, b AS (SELECT cam_i a, cam_j b, n FROM covis UNION ALL SELECT cam_j, cam_i, n FROM covis), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) place FROM b) SELECT * FROM r WHERE place <= 3")
def best_neighbours(spark, d):
    return graph.best_neighbours(tracks.covisibility(obs(spark, d), 1).select(F.col("cam_i").alias("a"), F.col("cam_j").alias("b"), "n"), 3)


#: The heaviest forest by its definition: an edge is in it if no path of edges that come before it (heavier,
#: then by ids) joins its ends. Reached sets grow from each edge's first end over edges before it.
FOREST = f"""WITH RECURSIVE {COVIS}, e AS (SELECT *, row_number() OVER (ORDER BY n DESC, cam_i, cam_j) k FROM covis WHERE n >= 4), x AS (SELECT cam_i a, cam_j b, k FROM e UNION ALL SELECT cam_j, cam_i, k FROM e),
r(k, y) AS (SELECT k, cam_i FROM e UNION SELECT r.k, x.b FROM r JOIN x ON x.a = r.y AND x.k < r.k) SELECT cam_i a, cam_j b, n FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.y = e.cam_j)"""


@query(FOREST)
def spanning_forest(spark, d):
    return graph.spanning_forest(tracks.covisibility(obs(spark, d), 4).select(F.col("cam_i").alias("a"), F.col("cam_j").alias("b"), "n"))


def _angles(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("rpy")])


def _r(c, n=6):
    return F.round(c, n) + F.lit(0.0)  # no negative zero


EULER = "x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) r, CAST(embedding[2] AS DOUBLE) p, CAST(embedding[3] AS DOUBLE) y FROM embeddings)"
MAT = "m AS (SELECT vec_id, cos(y)*cos(p) m00, sin(y)*cos(p) m10, -sin(p) m20, cos(y)*sin(p)*sin(r)-sin(y)*cos(r) m01, sin(y)*sin(p)*sin(r)+cos(y)*cos(r) m11, cos(p)*sin(r) m21, cos(y)*sin(p)*cos(r)+sin(y)*sin(r) m02, sin(y)*sin(p)*cos(r)-cos(y)*sin(r) m12, cos(p)*cos(r) m22 FROM x)"


@query(f"WITH {EULER}, {MAT} SELECT vec_id, " + ", ".join(f"round(m{i}{j}, 6) + 0.0 m{i}{j}" for i in range(3) for j in range(3)) + " FROM m")
def euler_to_matrix(spark, d):
    a = _angles(spark, d)
    m = rotation.euler_to_matrix(F.col("r"), F.col("p"), F.col("y"))
    return a.select("vec_id", *[_r(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


@query(f"WITH {EULER} SELECT vec_id, round(r, 6) + 0.0 r, round(p, 6) + 0.0 p, round(y, 6) + 0.0 y FROM x")
def euler_roundtrip(spark, d):
    a = _angles(spark, d)
    q = rotation.euler_to_quaternion(F.col("r"), F.col("p"), F.col("y"))
    e = rotation.matrix_to_euler(rotation.quaternion_to_matrix(*q))
    return a.select("vec_id", *[_r(c).alias(k) for c, k in zip(e, "rpy", strict=True)])


@query(f"WITH {EULER} SELECT vec_id, round(cos(r/2)*cos(p/2)*cos(y/2)+sin(r/2)*sin(p/2)*sin(y/2), 6) + 0.0 w, round(sin(r/2)*cos(p/2)*cos(y/2)-cos(r/2)*sin(p/2)*sin(y/2), 6) + 0.0 x, round(cos(r/2)*sin(p/2)*cos(y/2)+sin(r/2)*cos(p/2)*sin(y/2), 6) + 0.0 y, round(cos(r/2)*cos(p/2)*sin(y/2)-sin(r/2)*sin(p/2)*cos(y/2), 6) + 0.0 z FROM x")
def euler_to_quaternion(spark, d):
    q = rotation.euler_to_quaternion(F.col("r"), F.col("p"), F.col("y"))
    return _angles(spark, d).select("vec_id", *[_r(c).alias(k) for c, k in zip(q, "wxyz", strict=True)])


@query(f"WITH {EULER}, {MAT} SELECT vec_id, round(atan2(sqrt(power(m21-m12,2)+power(m02-m20,2)+power(m10-m01,2)), m00+m11+m22-1), 6) + 0.0 angle FROM m")
def axis_angle(spark, d):
    m = rotation.euler_to_matrix(F.col("r"), F.col("p"), F.col("y"))
    return _angles(spark, d).select("vec_id", _r(rotation.matrix_to_axis_angle(m)[3]).alias("angle"))


LL = "g AS (SELECT c_custkey, (c_custkey % 360) - 180.0 + c_nationkey / 100.0 lon, (c_custkey % 160) - 80.0 + c_nationkey / 50.0 lat, c_acctbal alt FROM customer)"


def _lonlat(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_custkey") % 360 - 180.0 + F.col("c_nationkey") / 100.0).alias("lon"), (F.col("c_custkey") % 160 - 80.0 + F.col("c_nationkey") / 50.0).alias("lat"), F.col("c_acctbal").alias("alt"))


N_SQL = "(6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat)) * sin(radians(lat))))"


@query(f"WITH {LL} SELECT c_custkey, round(({N_SQL} + alt) * cos(radians(lat)) * cos(radians(lon)), 4) + 0.0 x, round(({N_SQL} + alt) * cos(radians(lat)) * sin(radians(lon)), 4) + 0.0 y, round(({N_SQL} * (1 - 0.0066943799901413165) + alt) * sin(radians(lat)), 4) + 0.0 z FROM g")
def geodetic_to_ecef(spark, d):
    x = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    return _lonlat(spark, d).select("c_custkey", *[_r(c, 4).alias(k) for c, k in zip(x, "xyz", strict=True)])


@query(f"WITH {LL} SELECT c_custkey, round(lat, 6) + 0.0 lat, round(lon, 6) + 0.0 lon, round(alt, 3) + 0.0 alt FROM g")
def ecef_roundtrip(spark, d):
    x = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    e = _lonlat(spark, d).select("c_custkey", *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])
    g = geodesy.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return e.select("c_custkey", _r(g[0]).alias("lat"), _r(g[1]).alias("lon"), _r(g[2], 3).alias("alt"))


@query(f"WITH {LL} SELECT c_custkey, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) \"zone\", CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + floor((lon + 180) / 6) + 1 AS INTEGER) epsg FROM g")
def utm_zone_epsg(spark, d):
    return _lonlat(spark, d).select("c_custkey", geodesy.utm_zone(F.col("lon")).alias("zone"), geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"WITH {LL} SELECT c_custkey, round(lon, 6) + 0.0 lon, round(lat, 6) + 0.0 lat FROM g")
def utm_roundtrip(spark, d):
    g = _lonlat(spark, d).withColumn("zone", geodesy.utm_zone(F.col("lon")))
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    u = g.select("c_custkey", "zone", (F.col("lat") < 0).alias("south"), e.alias("e"), n.alias("n"))
    lon, lat = geodesy.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return u.select("c_custkey", _r(lon).alias("lon"), _r(lat).alias("lat"))


@query("SELECT label, CAST(floor((max(CAST(embedding[2] AS DOUBLE)) - min(CAST(embedding[2] AS DOUBLE))) / 0.01) + 1 AS INTEGER) h, CAST(floor((max(CAST(embedding[1] AS DOUBLE)) - min(CAST(embedding[1] AS DOUBLE))) / 0.01) + 1 AS INTEGER) w FROM embeddings GROUP BY 1")
def utm_raster_shape(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    b = e.groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    h, w = geodesy.raster_shape(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 0.01)
    return b.select("label", h.alias("h"), w.alias("w"))


P = [[0.061, -0.044, -0.012, -81000.0], [-0.047, -0.058, -0.039, -240000.0], [3e-08, 6.5e-08, -1.3e-07, 1.0]]
_row = lambda r: " + ".join(f"({v!r}) * {c}" for v, c in zip(r, ("x", "y", "z", "1"), strict=True))


@query(f"WITH {LL}, e AS (SELECT c_custkey, ({N_SQL} + alt) * cos(radians(lat)) * cos(radians(lon)) x, ({N_SQL} + alt) * cos(radians(lat)) * sin(radians(lon)) y, ({N_SQL} * (1 - 0.0066943799901413165) + alt) * sin(radians(lat)) z FROM g) SELECT c_custkey, round(({_row(P[0])}) / ({_row(P[2])}), 3) + 0.0 col, round(({_row(P[1])}) / ({_row(P[2])}), 3) + 0.0 \"row\" FROM e")
def perspective_project(spark, d):
    x = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    c, r = cameras.project_matrix(P, [F.col(k) for k in "xyz"])
    return _lonlat(spark, d).select("c_custkey", *[v.alias(k) for v, k in zip(x, "xyz", strict=True)]).select("c_custkey", _r(c, 3).alias("col"), _r(r, 3).alias("row"))


RPC = {
    "lon_off": 0.0, "lat_off": 0.0, "alt_off": 0.0, "lon_scale": 180.0, "lat_scale": 90.0, "alt_scale": 10000.0, "col_off": 500.0, "row_off": 400.0, "col_scale": 510.0, "row_scale": 410.0,
    "col_num": [0.01 * i for i in range(1, 21)], "col_den": [1.0] + [0.001 * i for i in range(1, 20)], "row_num": [0.02 * (21 - i) for i in range(1, 21)], "row_den": [1.0] + [0.0005 * i for i in range(1, 20)],
}
_terms = ["1", "x", "y", "z", "x*y", "x*z", "y*z", "x*x", "y*y", "z*z", "x*y*z", "x*x*x", "x*y*y", "x*z*z", "x*x*y", "y*y*y", "y*z*z", "x*x*z", "y*y*z", "z*z*z"]
_poly = lambda c: "(" + " + ".join(f"{k!r} * {t}" for k, t in zip(c, _terms, strict=True)) + ")"


@query(f"WITH {LL}, n AS (SELECT c_custkey, lon / 180.0 x, lat / 90.0 y, alt / 10000.0 z FROM g) SELECT c_custkey, round({_poly(RPC['col_num'])} / {_poly(RPC['col_den'])} * 510.0 + 500.0, 6) col, round({_poly(RPC['row_num'])} / {_poly(RPC['row_den'])} * 410.0 + 400.0, 6) \"row\" FROM n")
def rpc_project(spark, d):
    c, r = cameras.project_rpc(RPC, F.col("lon"), F.col("lat"), F.col("alt"))
    return _lonlat(spark, d).select("c_custkey", F.round(c, 6).alias("col"), F.round(r, 6).alias("row"))


@query("SELECT CAST(a AS DOUBLE) * 10 x, CAST(b AS DOUBLE) * 5 y, CAST(c AS DOUBLE) * 100 z FROM range(11) t(a), range(9) u(b), range(5) v(c)")
def gcp_mesh(spark, d):
    side = lambda n, step, k: spark.range(n).select((F.col("id") * float(step)).alias(k))
    return side(11, 10, "x").crossJoin(side(9, 5, "y")).crossJoin(side(5, 100, "z"))


@query("""WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM embeddings), r AS (SELECT *, lead(x) OVER w nx, lead(y) OVER w ny, first_value(x) OVER w fx, first_value(y) OVER w fy FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6) area FROM r GROUP BY 1""")
def polygon_area(spark, d):
    p = table(spark, d, "embeddings").select(F.col("label"), F.col("vec_id").alias("i"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return polygons.areas(p, "label").withColumn("area", F.round("area", 6))


#: A point is a corner of the hull if all others fit into an angle of less than half a turn seen from it: the
#: largest gap between neighbouring directions is above pi. Corners stand in order of the angle about the mean.
HULLS = """WITH p AS (SELECT DISTINCT label, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM embeddings),
t AS (SELECT a.label, a.x, a.y, atan2(b.y - a.y, b.x - a.x) t FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
g AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w + 2 * pi()) - t gap FROM t WINDOW w AS (PARTITION BY label, x, y ORDER BY t)),
c AS (SELECT label, x, y FROM g GROUP BY 1, 2, 3 HAVING max(gap) > pi()), m AS (SELECT label, avg(x) mx, avg(y) my, min(x) lx FROM c GROUP BY 1),
o AS (SELECT c.*, atan2(y - my, x - mx) a, min(CASE WHEN x = lx THEN atan2(y - my, x - mx) END) OVER (PARTITION BY c.label) a0 FROM c JOIN m USING (label))
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY CASE WHEN a < a0 THEN a + 2 * pi() ELSE a END) - 1 AS INTEGER) i, x, y FROM o"""


@query(HULLS)
def convex_hulls(spark, d):
    p = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return polygons.hulls(p, "label")


@query(f"""WITH {COVIS}, e AS (SELECT cam_i c, n FROM covis UNION ALL SELECT cam_j, n FROM covis), g AS (SELECT x.s_suppkey a, y.s_suppkey b FROM supplier x, supplier y),
m AS (SELECT cam_i a, cam_j b, n FROM covis UNION ALL SELECT cam_j, cam_i, n FROM covis), f AS (SELECT g.a, coalesce(m.n, 0) n FROM g LEFT JOIN m ON g.a = m.a AND g.b = m.b)
SELECT a cam_id, count(*) FILTER (n > 0) neighbors, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) obs FROM f GROUP BY 1 HAVING count(*) FILTER (n > 0) > 0""")
def quick_camera_weights(spark, d):
    return tracks.quick_weights(obs(spark, d), cams(spark, d))


@query("WITH p AS (SELECT a.s_suppkey i, b.s_suppkey j, a.s_nationkey = b.s_nationkey t FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_nationkey - a.s_nationkey BETWEEN 0 AND 1), e AS (SELECT i c, t FROM p UNION ALL SELECT j, t FROM p), h AS (SELECT c, bool_or(t) t FROM e GROUP BY 1) SELECT s_suppkey cam_id, h.c IS NOT NULL matched, coalesce(h.t, false) triangulated FROM supplier LEFT JOIN h ON h.c = s_suppkey")
def pair_coverage(spark, d):
    c = cams(spark, d)
    a = c.select(F.col("cam_id").alias("cam_i"), F.col("s_nationkey").alias("na"), F.explode(F.sequence(F.col("s_nationkey"), F.col("s_nationkey") + 1)).alias("nb"))
    p = a.join(c.select(F.col("cam_id").alias("cam_j"), F.col("s_nationkey").alias("nb")), "nb").where("cam_i < cam_j")
    return tracks.pair_coverage(c, p, p.where("na = nb"))


CONS = """m AS (SELECT a.label cam_i, b.label cam_j, a.vec_id ki, b.vec_id kj, sqrt(power(CAST(a.embedding[1] AS DOUBLE) * 100 - CAST(b.embedding[1] AS DOUBLE) * 100, 2) + power(CAST(a.embedding[2] AS DOUBLE) * 100 - CAST(b.embedding[2] AS DOUBLE) * 100, 2)) err FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label < b.label),
e AS (SELECT *, row_number() OVER (PARTITION BY cam_i, cam_j ORDER BY err) - 1 i, count(*) OVER w n, min(err) OVER w lo, max(err) OVER w hi FROM m WINDOW w AS (PARTITION BY cam_i, cam_j)),
b AS (SELECT *, row_number() OVER (PARTITION BY cam_i, cam_j ORDER BY round(abs((hi - lo) * i - (n - 1) * (err - lo)), 6) DESC, i) k FROM e), q AS (SELECT cam_i, cam_j, quantile_cont(err, 0.8) c FROM m GROUP BY 1, 2),
t AS (SELECT cam_i, cam_j, CASE WHEN err >= c THEN err + 5 ELSE hi END thr FROM b JOIN q USING (cam_i, cam_j) WHERE k = 1)"""


@query(f"WITH {CONS} SELECT ki, kj, round(err, 6) err FROM m JOIN t USING (cam_i, cam_j) WHERE err <= thr")
def consistent_matches(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate("xy")])
    a = e.select(F.col("label").alias("cam_i"), F.col("vec_id").alias("ki"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = e.select(F.col("label").alias("cam_j"), F.col("vec_id").alias("kj"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    m = a.join(b, F.col("kj") == F.col("ki") + 1).where("cam_i < cam_j")
    return matching.consistent(m).select("ki", "kj", F.round("err", 6).alias("err"))


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM embeddings), c AS (SELECT label, avg(x) mx, avg(y) my FROM p GROUP BY 1), s AS (SELECT label, sqrt(2) / avg(sqrt(power(x - mx, 2) + power(y - my, 2))) s FROM p JOIN c USING (label) GROUP BY 1)
SELECT vec_id, round((x - mx) * s, 6) + 0.0 x, round((y - my) * s, 6) + 0.0 y FROM p JOIN c USING (label) JOIN s USING (label)""")
def normalized_points(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return matching.normalized(p, "label").select("vec_id", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


@query("SELECT label, round((max(CAST(embedding[1] AS DOUBLE)) - min(CAST(embedding[1] AS DOUBLE))) / 2, 6) scale, round((max(CAST(embedding[1] AS DOUBLE)) + min(CAST(embedding[1] AS DOUBLE))) / 2, 6) + 0.0 \"offset\" FROM embeddings GROUP BY 1")
def scaling_params(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return v.groupBy("label").agg(F.round((F.max("v") - F.min("v")) / 2, 6).alias("scale"), _r((F.max("v") + F.min("v")) / 2).alias("offset"))


RPC2 = {**RPC, "col_num": [0.011 * i for i in range(1, 21)], "row_num": [0.019 * (21 - i) for i in range(1, 21)]}


@query(f"WITH g AS (SELECT a * 10.0 lon, b * 5.0 lat, c * 100.0 alt FROM range(11) t(a), range(9) u(b), range(5) v(c)), n AS (SELECT *, lon / 180.0 x, lat / 90.0 y, alt / 10000.0 z FROM g) SELECT " + ", ".join(f"round({_poly(r[f'{a}_num'])} / {_poly(r[f'{a}_den'])} * {r[f'{a}_scale']} + {r[f'{a}_off']}, 6) {a}_{i}" for i, r in (("i", RPC), ("j", RPC2)) for a in ("col", "row")) + " FROM n")
def virtual_matches(spark, d):
    g = gcp_mesh(spark, d)
    one, two = (cameras.project_rpc(r, F.col("x"), F.col("y"), F.col("z")) for r in (RPC, RPC2))
    return g.select(*[F.round(c, 6).alias(k) for c, k in zip((*one, *two), ("col_i", "row_i", "col_j", "row_j"), strict=True)])


@query()
def selected_tracks(spark, d):
    o = obs(spark, d)
    return tracks.select_tracks(o, tracks.rank_tracks(o), 2, kept)


@query(f"SELECT id, lon, lat FROM ({scene.GROUND})")
def rpc_localize(spark, d):
    p = scene.ground(spark, d).withColumn("cam_id", F.col("id") % 2)
    seen = geometry.project(p, scene.models(spark)).join(p.select("id", "alt"), "id")
    return geometry.localize(seen, scene.models(spark)).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"SELECT id, lon, lat, alt FROM ({scene.GROUND})")
def rpc_triangulate(spark, d):
    p, m = scene.ground(spark, d), scene.models(spark)
    i, j = (geometry.project(p.withColumn("cam_id", F.lit(k).cast("long")), m).select(F.col("id").alias("track_id"), F.col("cam_id").alias(f"cam_{x}"), F.col("col").alias(f"c{x}"), F.col("row").alias(f"r{x}")) for k, x in enumerate("ij"))
    t = geometry.triangulate(i.join(j, "track_id").select("track_id", "cam_i", "cam_j", "ci", "ri", "cj", "rj"), m)
    lat, lon, alt = geodesy.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return t.select(F.col("track_id").alias("id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(alt, 1).alias("alt"))


@query("SELECT range cam_id, true fits FROM range(2)")
def rpc_refit(spark, d):
    return geometry.refit(scene.models(spark), 8).select("cam_id", (F.col("rmse") < 0.01).alias("fits"))


@query("SELECT CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.05) AS BIGINT) gx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.05) AS BIGINT) gy, count(*) n, round(avg(abs(CAST(embedding[3] AS DOUBLE))), 6) mean_err FROM embeddings GROUP BY 1, 2")
def error_grid(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.abs(F.col("embedding")[2].cast("double")).alias("err"))
    return outliers.error_grid(p, 0.05).withColumn("mean_err", F.round("mean_err", 6))


@query()
def footprint_overlap(spark, d):
    """Footprints of the made scene's cameras at one height, and what share of the first's the second covers."""
    m = scene.models(spark)
    corners = m.select("cam_id", F.posexplode(F.array(*[F.struct(F.lit(float(c)).alias("col"), F.lit(float(r)).alias("row")) for c, r in ((0, 0), (4000, 0), (4000, 4000), (0, 4000))])).alias("id", "p"))
    ground = geometry.localize(corners.select("cam_id", F.col("id").cast("long").alias("id"), "p.col", "p.row", F.lit(300.0).alias("alt")), m)
    f = ground.groupBy("cam_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("f"))  # four corners
    i, j = (f.select(F.col("cam_id").alias(f"cam_{k}"), F.col("f").alias(f"footprint_{k}")) for k in "ij")
    return polygons.overlap(i.join(j, F.col("cam_i") < F.col("cam_j")))
