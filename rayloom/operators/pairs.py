"""Image pairs: all, by dates, by overlap and baseline; timelines of acquisitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .ranges import running

#: Cameras of a block: two of them make a tile of pairs.
TILE = 256


def spread(cameras: DataFrame, key: str) -> DataFrame:
    """A camera table is one small file, but each of its rows stands for many pairs: dealt to all cores."""
    return cameras.repartition(4 * cameras.sparkSession.sparkContext.defaultParallelism, key)


def _blocks(cameras: DataFrame, *carried: str) -> tuple[DataFrame, int]:
    """(block, cam_id, carried) and the number of blocks: `TILE` cameras or less in order of cam_id, inside a block in order of the
    `carried` columns. Written, so that cameras of one id stand in the same blocks wherever these are read."""
    own = cameras.select("cam_id", *carried).where("cam_id IS NOT NULL").withColumn("__one", F.lit(1).cast("long"))
    own = running(own, ["cam_id"], "__one", "__at")
    n = own.count()
    size = max(1, min(TILE, -(-n // 64)))
    own = own.select(F.floor(F.col("__at") / size).alias("block"), "cam_id", *carried)
    return kept(own.repartition("block").sortWithinPartitions("block", *carried, "cam_id"), "cameras"), -(-n // size)


def _paired(tiles: DataFrame, tasks: int, blocks: DataFrame, *carried: str) -> DataFrame:
    """The pairs of the cameras of two blocks (k, l), which are in `tasks` partitions. Blocks come by broadcast, a row a camera in
    all. Between the joins nothing is fused, else Spark holds the pairs of a whole tile before it hands out the first."""
    i, j = (F.broadcast(blocks.select(F.col("block").alias(c), F.col("cam_id").alias(f"cam_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in carried])) for c, s in ("ki", "lj"))
    p = tiles.join(i, "k").drop("k")
    return p.coalesce(tasks).join(j, "l").where("cam_i < cam_j").drop("l")


def all_pairs(cameras: DataFrame, *carried: str) -> DataFrame:
    """(cam_i < cam_j) of a camera table, with the `carried` columns c of both as c_i and c_j, of kinds that have an order. Pairs of images are
    what is asked for, so they are quadratic. They come by tiles of two blocks of cameras: neighbouring rows have one cam_i, and
    the cam_j of the rows one block before, so a file of pairs takes a fraction of a byte a pair."""
    blocks, n = _blocks(cameras, *carried)
    spark, count = cameras.sparkSession, n * (n + 1) // 2
    # at most 480 tiles a task: its ids fit a file's dictionary of 1 MB
    tasks = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, -(-count // 480))))
    t = spark.range(0, count, 1, tasks)
    # the tile id = l (l + 1) / 2 + k; a root that is off by one is put right
    t = t.withColumn("l", F.floor((F.sqrt(8.0 * F.col("id") + 1.0) - 1.0) / 2.0))
    t = t.withColumn("l", F.expr("l + CASE WHEN l * (l + 1) > 2 * id THEN -1 WHEN (l + 1) * (l + 2) <= 2 * id THEN 1 ELSE 0 END"))
    return _paired(t.select(F.expr("id - l * (l + 1) div 2").alias("k"), "l"), tasks, blocks, *carried)


def date_window_pairs(cameras: DataFrame, ahead: int = 1) -> DataFrame:
    """Pairs of images of one date or of the next `ahead` dates; cameras (cam_id, date_idx).

    The date range is spelled out as an equality on each offset, so the join stays a hash join; dates are few, so
    the images of one are dealt to all tasks, which have, broadcast, a row a camera for cam_j.
    """
    a = cameras.select(F.col("cam_id").alias("cam_i"), F.col("date_idx").alias("di"), F.explode(F.sequence(F.col("date_idx"), F.col("date_idx") + ahead)).alias("dj"))
    b = cameras.select(F.col("cam_id").alias("cam_j"), F.col("date_idx").alias("dj"))
    p = spread(a, "cam_i").join(F.broadcast(b), "dj").where((F.col("dj") > F.col("di")) | (F.col("cam_i") < F.col("cam_j")))
    return p.select("cam_i", "cam_j", "di", "dj")


def _met(pairs: DataFrame, least_overlap: float, least_baseline: float, orbit: float) -> DataFrame:
    """Pairs with enough overlap, and whether they have enough baseline to triangulate (`good`)."""
    return pairs.where(F.col("overlap") > least_overlap).withColumn("good", F.col("baseline") / orbit > least_baseline)


def _poor(ends: DataFrame) -> DataFrame:
    """The cameras (cam_id) of `ends` (cam_id, good) without a good pair."""
    return ends.groupBy("cam_id").agg(F.max("good").alias("any")).where("not any").select("cam_id")


def qualify_pairs(pairs: DataFrame, least_overlap: float = 0.1, least_baseline: float = 0.25, orbit: float = 500_000.0) -> DataFrame:
    """Pairs (cam_i, cam_j, overlap, baseline) to match, with `triangulate`: overlap strictly above
    its least share; baseline over orbit height strictly above its own; a camera that would have
    no pair to triangulate keeps all its pairs."""
    m = _met(pairs, least_overlap, least_baseline, orbit)
    poor = _poor(m.select(F.explode(F.array("cam_i", "cam_j")).alias("cam_id"), "good"))
    # a row a camera, so that pairs are not shuffled
    i, j = (F.broadcast(poor.select(F.col("cam_id").alias(c), F.lit(True).alias(f"poor_{c[-1]}"))) for c in ("cam_i", "cam_j"))
    r = m.join(i, "cam_i", "left").join(j, "cam_j", "left")
    return r.select("cam_i", "cam_j", "overlap", "baseline", (F.col("good") | F.coalesce("poor_i", F.lit(False)) | F.coalesce("poor_j", F.lit(False))).alias("triangulate"))


def qualify_all(cameras: DataFrame, overlap: Column, baseline: Column, *carried: str, least_overlap: float = 0.1, least_baseline: float = 0.25, orbit: float = 500_000.0) -> DataFrame:
    """`qualify_pairs` of all pairs of cameras (cam_id, carried), whose `overlap` and `baseline` are made of the `carried` columns c as
    c_i and c_j. All pairs are gone through once: most cameras have a good pair in their own block already, and those that have none there
    are compared with all others alone. Whether a camera is poor is then one of its columns."""
    own = kept(cameras.select("cam_id", *carried).where("cam_id IS NOT NULL"), "cameras")
    met = lambda p: _met(p.withColumns({"overlap": overlap, "baseline": baseline}), least_overlap, least_baseline, orbit)
    blocks, n = _blocks(own, *carried)
    spark = cameras.sparkSession
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    near = met(_paired(spark.range(0, n, 1, tasks).select(F.col("id").alias("k"), F.col("id").alias("l")), tasks, blocks, *carried))
    sound = near.where("good").select(F.explode(F.array("cam_i", "cam_j")).alias("cam_id")).distinct()
    a = spread(own.join(F.broadcast(sound), "cam_id", "left_anti"), "cam_id").select(*[F.col(c).alias(f"__a_{c}") for c in ("cam_id", *carried)])
    b = F.broadcast(own.select(*[F.col(c).alias(f"__b_{c}") for c in ("cam_id", *carried)]))
    first = F.col("__a_cam_id") < F.col("__b_cam_id")
    ends = [F.when(first == (s == "i"), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(f"{c}_{s}") for s in "ij" for c in carried]
    rest = a.join(b, F.col("__a_cam_id") != F.col("__b_cam_id")).select(F.col("__a_cam_id").alias("cam_id"), *ends)
    poor = _poor(met(rest).select("cam_id", "good")).withColumn("__poor", F.lit(True))
    own = own.join(F.broadcast(poor), "cam_id", "left").withColumn("__poor", F.coalesce("__poor", F.lit(False)))
    return met(all_pairs(own, *carried, "__poor")).select("cam_i", "cam_j", "overlap", "baseline", (F.col("good") | F.col("__poor_i") | F.col("__poor_j")).alias("triangulate"))


def nearest_dates(dates: DataFrame, n: int = 1) -> DataFrame:
    """For each date index the `n` nearest earlier adjusted ones; dates (date_idx, adjusted).

    A date with c adjusted ones before it takes those numbered c - 1, c - 2, ...: a running count and a
    join on the number, so no row holds the dates before it.
    """
    d = running(dates.withColumn("one", F.col("adjusted").cast("long")), ["date_idx"], "one", "c")
    wanted = d.select("date_idx", "c", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("place")).withColumn("number", F.col("c") - F.col("place"))
    known = d.where("adjusted").select(F.col("c").alias("number"), F.col("date_idx").alias("prev_idx"))
    return wanted.join(known, "number").select("date_idx", "prev_idx", "place")


def timeline(acq: DataFrame, minutes: float = 30) -> DataFrame:
    """`acq` (scene, ts, id) with `anchor` and the group's number `g`: an acquisition opens a group
    where it is `minutes` or more after the first one of the latest group, else joins that group.

    The anchor depends on the anchor before, so a scene's times are folded once in order. The fold
    runs over sorted rows as they stream past and holds one anchor, however long a scene is; it
    jumps from group to group by binary search. Rows without a time have no group and go.
    """
    gap = np.timedelta64(int(minutes * 60e6), "us")
    rows = acq.where("ts IS NOT NULL").select("scene", "id", "ts").repartition("scene").sortWithinPartitions("scene", "ts", "id")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, anchor, g = None, None, -1
        for pdf in parts:
            t, anchors, groups = pdf["ts"].to_numpy(), [], []
            edges = np.flatnonzero(np.r_[True, pdf["scene"].to_numpy()[1:] != pdf["scene"].to_numpy()[:-1]]) if len(pdf) else []
            for lo, hi in zip(edges, [*edges[1:], len(pdf)], strict=True):
                if at is None or pdf["scene"].iloc[lo] != at[0]:
                    at, anchor, g = (pdf["scene"].iloc[lo],), None, -1
                while lo < hi:
                    if anchor is None or t[lo] - anchor >= gap:
                        anchor, g = t[lo], g + 1
                    end = lo + int(np.searchsorted(t[lo:hi], anchor + gap, "left"))
                    anchors.append(np.full(end - lo, anchor))
                    groups.append(np.full(end - lo, g))
                    lo = end
            if anchors:
                yield pdf.assign(anchor=np.concatenate(anchors), g=np.concatenate(groups))

    kind = {c: acq.schema[c].dataType.simpleString() for c in ("scene", "id", "ts")}
    return rows.mapInPandas(fold, f"scene {kind['scene']}, id {kind['id']}, ts {kind['ts']}, anchor {kind['ts']}, g long")
