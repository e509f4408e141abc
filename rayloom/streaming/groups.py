"""Acquisition groups of a stream by event time: rows wait until the watermark has passed them.

What `streaming.timeline.stream_groups` decides when a row arrives, this decides when no earlier row can
come any more, so any order of arrival inside the watermark gives the groups of `pairs.timeline`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time_groups(acq: DataFrame, late: str, minutes: float = 30) -> DataFrame:
    """(scene, id, ts, anchor, g) in append mode for a stream (scene, id, ts) whose rows come at most `late` after
    later ones; rows that come later still are dropped, and so are those without a time or a scene.

    A scene's state is its rows after the watermark (times and ids), the first time of its latest group
    and that group's number. When the watermark passes, rows before it are final: they are grouped in order
    and leave the state. A scene whose latest group has ended (its first time and `minutes` are before the
    watermark) and that has no rows waiting has no state left; a group that it opens later counts from 0
    again, so `anchor` is what names a group.
    """
    gap = int(minutes * 60e6)
    kind = acq.schema["ts"].dataType.simpleString()
    scene, ident = (acq.schema[c].dataType.simpleString() for c in ("scene", "id"))
    rows = acq.where("ts IS NOT NULL AND scene IS NOT NULL").select("scene", "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("us", F.unix_micros("ts"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, anchor, g = state.get if state.exists else ([], [], None, -1)
        times, ids = list(times), list(ids)
        for pdf in parts:
            times += pdf["us"].tolist()
            ids += pdf["id"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(times)), key=lambda k: (times[k], ids[k] is not None, ids[k]))
        final = [k for k in order if times[k] < mark]
        wait = [k for k in order if times[k] >= mark]
        anchors, groups = [], []
        for k in final:
            if anchor is None or times[k] - anchor >= gap:
                anchor, g = times[k], g + 1
            anchors.append(anchor)
            groups.append(g)
        if wait or (anchor is not None and anchor + gap >= mark):
            state.update(([times[k] for k in wait], [ids[k] for k in wait], anchor, g))
            # again as soon as the watermark has passed the first row that waits, or the group's end
            due = times[wait[0]] if wait else anchor + gap
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if final:
            yield pd.DataFrame({"scene": key[0], "id": [ids[k] for k in final], "us": [times[k] for k in final], "anchor": anchors, "g": groups})

    out = f"scene {scene}, id {ident}, us long, anchor long, g long"
    held = f"times array<long>, ids array<{ident}>, anchor long, g long"
    done = rows.groupBy("scene").applyInPandasWithState(fold, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_micros(c).cast(kind).alias("ts" if c == "us" else c)
    return done.select("scene", "id", at("us"), at("anchor"), "g")
