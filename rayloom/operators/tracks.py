"""Feature tracks as a long table of observations: (track_id, cam_id, scale, err).

One row stands for one keypoint of one camera in one track; what is missing is a missing row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept as written
from .ranges import ranked


#: Observations of a task of the self-join on tracks, about.
TASK = 500_000


def covisibility(obs: DataFrame, least: int = 10, strict: bool = False) -> DataFrame:
    """(cam_i < cam_j, n): tracks that two cameras share, where there are `least` or more
    (`strict`: more). A self-join on the track, so its size is the sum of squared track lengths. A task sorts both sides and
    counts pairs in memory, so where tasks would have more than `TASK` observations there are more of them."""
    own = written(obs.select("track_id", "cam_id"), "obs")
    tasks = math.ceil(own.count() / TASK)
    if tasks > obs.sparkSession.sparkContext.defaultParallelism:
        own = own.repartition(tasks, "track_id")
    a, b = (own.select("track_id", F.col("cam_id").alias(c)) for c in ("cam_i", "cam_j"))
    n = a.join(b, "track_id").where("cam_i < cam_j").groupBy("cam_i", "cam_j").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > least if strict else F.col("n") >= least)


def obs_per_camera(obs: DataFrame) -> DataFrame:
    return obs.groupBy("cam_id").agg(F.count("*").alias("n_obs"))


def weak_cameras(obs: DataFrame, cameras: DataFrame, least: int) -> DataFrame:
    """Cameras with fewer than `least` observations, those with none included."""
    n = cameras.select("cam_id").join(obs_per_camera(obs), "cam_id", "left").fillna(0, ["n_obs"])
    return n.where(F.col("n_obs") < least)


def track_length(obs: DataFrame) -> DataFrame:
    return obs.groupBy("track_id").agg(F.count("*").alias("length"))


def valid_tracks(obs: DataFrame, least: int = 2) -> DataFrame:
    return track_length(obs).where(F.col("length") >= least)


def triangulable_tracks(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tracks with at least one pair of cameras from `pairs` (cam_i < cam_j)."""
    a, b = (obs.select("track_id", F.col("cam_id").alias(c)) for c in ("cam_i", "cam_j"))
    seen = a.join(b, "track_id").where("cam_i < cam_j")
    return seen.join(pairs, ["cam_i", "cam_j"], "left_semi").select("track_id").distinct()


def disconnected_cameras(cameras: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cameras that no pair holds."""
    ends = pairs.select(F.col("cam_i").alias("cam_id")).union(pairs.select("cam_j"))
    return cameras.select("cam_id").join(ends, "cam_id", "left_anti")


def restrict_to_free(obs: DataFrame, free: DataFrame) -> DataFrame:
    """Observations of the tracks that a free camera sees."""
    return obs.join(obs.join(free, "cam_id", "left_semi").select("track_id").distinct(), "track_id", "left_semi")


#: What tracks can be ranked by, and which end is the better one.
PRIORITY = {"length": F.desc, "scale": F.asc, "cost": F.asc}


def rank_tracks(obs: DataFrame, priority: tuple[str, ...] = ("length", "scale", "cost")) -> DataFrame:
    """Tracks from best to worst in the order of `priority`: long ones, those of a small mean scale (two
    places) and those of a small error come first; equal ones by their ids."""
    if not priority or set(priority) - PRIORITY.keys():
        raise ValueError(f"tracks are ranked by some of {tuple(PRIORITY)}, not by {priority}")
    t = obs.groupBy("track_id").agg(F.count("*").alias("length"), F.round(F.avg("scale"), 2).alias("mean_scale"), F.round(F.avg("err"), 6).alias("cost"))
    own = {"scale": "mean_scale"}
    return ranked(t, [*[PRIORITY[k](own.get(k, k)) for k in priority], F.asc("track_id")])


def camera_track_lists(obs: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The `k` best tracks of each camera."""
    w = W.partitionBy("cam_id").orderBy("rank")
    r = obs.select("cam_id", "track_id").join(ranked.select("track_id", "rank"), "track_id")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def track_mean_error(obs: DataFrame) -> DataFrame:
    return obs.groupBy("track_id").agg(F.avg("err").alias("mean_err"))


def camera_weights(obs: DataFrame, least: int = 10) -> DataFrame:
    """Neighbours with `least` shared tracks plus exp(-(mean + 3 * population deviation)) of the
    mean errors of the camera's tracks; a camera without neighbours has weight 1."""
    edges = covisibility(obs, least)
    ends = edges.select(F.col("cam_i").alias("cam_id")).unionAll(edges.select("cam_j"))
    degree = ends.groupBy("cam_id").agg(F.count("*").alias("degree"))
    cost = obs.join(track_mean_error(obs), "track_id").groupBy("cam_id").agg((F.avg("mean_err") + 3 * F.stddev_pop("mean_err")).alias("cost"))
    w = cost.join(degree, "cam_id", "left")
    return w.select("cam_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("degree").isNull(), 1.0).otherwise(F.col("degree") + F.exp(-F.col("cost"))).alias("weight"))


def reference_camera(obs: DataFrame, least: int = 10) -> DataFrame:
    """The camera with most neighbours, then most observations, then the highest id."""
    w = camera_weights(obs, least).join(obs_per_camera(obs), "cam_id")
    return w.select("cam_id", "degree", "n_obs").orderBy(F.desc("degree"), F.desc("n_obs"), F.desc("cam_id")).limit(1)


def keypoint_top_k(kp: DataFrame, k: int) -> DataFrame:
    """The `k` keypoints of each camera with the largest scale."""
    w = W.partitionBy("cam_id").orderBy(F.desc("scale"), F.asc("kp_id"))
    return kp.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def reindex_matches(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Camera numbers by `ids` (old, new); matches of cameras that are not there go, and each
    match is turned so that cam_i < cam_j, its keypoints with it."""
    m = matches.join(ids.select(F.col("old").alias("cam_i"), F.col("new").alias("ni")), "cam_i").join(ids.select(F.col("old").alias("cam_j"), F.col("new").alias("nj")), "cam_j")
    turn = F.col("ni") > F.col("nj")
    return m.select(F.least("ni", "nj").alias("cam_i"), F.greatest("ni", "nj").alias("cam_j"), F.when(turn, F.col("kp_j")).otherwise(F.col("kp_i")).alias("kp_i"), F.when(turn, F.col("kp_i")).otherwise(F.col("kp_j")).alias("kp_j"))


def tracks_from_matches(matches: DataFrame, components) -> DataFrame:
    """Links pairwise matches into tracks: each keypoint of a component is an observation; where
    one camera has several in a track, the smallest keypoint stays. Tracks number from 1."""
    node = lambda c, k: F.struct(F.col(c).alias("cam_id"), F.col(k).alias("kp_id"))
    ends = matches.select(F.explode(F.array(node("cam_i", "kp_i"), node("cam_j", "kp_j"))).alias("n")).distinct()
    code = lambda n: F.col(f"{n}.cam_id").cast("long") * (1 << 32) + F.col(f"{n}.kp_id")
    edges = matches.select(node("cam_i", "kp_i").alias("a"), node("cam_j", "kp_j").alias("b")).select(code("a").alias("a"), code("b").alias("b"))
    labels = components(edges)
    o = ends.select(code("n").alias("node"), "n.cam_id", "n.kp_id").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return o.groupBy("root", "cam_id").agg(F.min("kp_id").alias("kp_id")).withColumnRenamed("root", "track_id")


def quick_weights(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, neighbors, obs): cameras that share a track, and the whole-number median of the
    shared tracks over all cameras, itself and strangers (0) included."""
    edges = covisibility(obs, 1)
    ends = edges.select(F.col("cam_i").alias("cam_id"), "n").unionAll(edges.select("cam_j", "n"))
    per = ends.groupBy("cam_id").agg(F.count("*").alias("neighbors"), F.array_sort(F.collect_list("n")).alias("shared"))  # a row of cameras
    total = cameras.select("cam_id").distinct().count()
    at = lambda i: F.when(i < total - F.col("neighbors"), 0).otherwise(F.get("shared", (i - (total - F.col("neighbors"))).cast("int")))
    low, high = (total - 1) // 2, total // 2
    return per.select("cam_id", "neighbors", F.floor((at(F.lit(low)) + at(F.lit(high))) / 2).alias("obs"))


def pair_coverage(cameras: DataFrame, to_match: DataFrame, to_triangulate: DataFrame) -> DataFrame:
    """Cameras with whether a pair to match and one to triangulate holds them."""
    held = lambda p, c: p.select(F.explode(F.array("cam_i", "cam_j")).alias("cam_id")).distinct().withColumn(c, F.lit(True))
    r = cameras.select("cam_id").join(held(to_match, "matched"), "cam_id", "left").join(held(to_triangulate, "triangulated"), "cam_id", "left")
    return r.fillna(False, ["matched", "triangulated"])


def select_tracks(obs: DataFrame, ranked: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(track_id, tree): tracks that span the cameras `k` times over.

    A tree starts at the camera with most observations among the tracks that are left. In each
    layer every camera that is not reached takes the best-ranked track that it shares with a
    reached one; these tracks are selected, and the cameras are the next layer. A layer is one
    join and one aggregation, whatever the number of tracks. `keep` writes a table to the shared
    folder and reads it back.
    """
    left, chosen = obs.join(ranked.select("track_id", "rank"), "track_id").select("track_id", "cam_id", "rank"), None
    left = keep(left)
    for tree in range(k):
        root = left.groupBy("cam_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cam_id").select("cam_id").limit(1)
        reached, mine = keep(root), None
        front = reached
        while True:
            seen = left.join(front, "cam_id", "left_semi").select("track_id").distinct()
            new = left.join(seen, "track_id", "left_semi").join(reached, "cam_id", "left_anti")
            layer = keep(new.groupBy("cam_id").agg(F.min(F.struct("rank", "track_id")).alias("t")).select("cam_id", "t.track_id"))
            if layer.isEmpty():
                break
            mine = layer if mine is None else mine.unionByName(layer)
            front = layer.select("cam_id")
            reached = keep(reached.unionByName(front))
        if mine is None:
            break
        picked = keep(mine.select("track_id").distinct().withColumn("tree", F.lit(tree)))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        left = keep(left.join(picked, "track_id", "left_anti"))
    return chosen if chosen is not None else obs.limit(0).select("track_id", F.lit(0).alias("tree"))


def select_by_sensor(obs: DataFrame, sensors: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame], priority: tuple[str, ...] = tuple(PRIORITY)) -> DataFrame:
    """(track_id): tracks selected for the cameras (cam_id, sensor) of each sensor by themselves, and for
    all cameras together. The sensors have no camera in common, so one selection of tracks cut by
    sensor would start in one of them only; each sensor, a handful, is a run of its own."""
    names = [r.sensor for r in sensors.select("sensor").distinct().orderBy("sensor").limit(100).collect()]
    o = obs.join(sensors, "cam_id")
    chosen = select_tracks(obs, rank_tracks(obs, priority), k, keep).select("track_id")
    for name in names:
        own = o.where(F.col("sensor") == name).drop("sensor")
        own = keep(own.join(valid_tracks(own), "track_id", "left_semi"))
        chosen = chosen.unionByName(select_tracks(own, rank_tracks(own, priority), k, keep).select("track_id"))
    return chosen.distinct()


def tracks_of(obs: DataFrame, new: DataFrame) -> DataFrame:
    """Observations of the tracks that a new camera (cam_id) sees, by old cameras too."""
    seen = obs.join(new.select("cam_id").distinct(), "cam_id", "left_semi").select("track_id").distinct()
    return obs.join(seen, "track_id", "left_semi")
