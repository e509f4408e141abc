"""Acquisitions as a stream: groups by anchor, and windowed error statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_groups(acq: DataFrame, minutes: float = 30) -> DataFrame:
    """(scene, id, ts, anchor) in append mode for a stream (scene, id, ts).

    The state of a scene is the first time of its latest group. Times are taken in order inside a
    micro-batch; one that arrives after a later group was opened joins that group only if it is
    not before its anchor, else it stands alone under its own time. Batches in order of time give
    the same groups as `pairs.timeline`.
    """
    gap = pd.Timedelta(minutes=minutes)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        anchors = []
        for t in rows["ts"]:
            if anchor is None or t - anchor >= gap:
                anchor = t
            anchors.append(anchor if t >= anchor else t)
        state.update((anchor.to_pydatetime(),))
        yield rows[["scene", "id", "ts"]].assign(anchor=anchors)

    kind = acq.schema["ts"].dataType.simpleString()
    scene, ident = (acq.schema[c].dataType.simpleString() for c in ("scene", "id"))
    return acq.groupBy("scene").applyInPandasWithState(fold, f"scene {scene}, id {ident}, ts {kind}, anchor {kind}", f"anchor {kind}", "append", GroupStateTimeout.NoTimeout)


def windowed_errors(err: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest error of each camera and time window of a stream (ts, cam, err)."""
    e = err.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "cam").agg(F.count("*").alias("n"), F.avg("err").alias("mean_err"), F.max("err").alias("max_err")).select("w.start", "w.end", "cam", "n", "mean_err", "max_err")
