"""Groups of a stream by event time."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from rayloom.operators import pairs
from rayloom.streaming import groups

g = np.random.default_rng(9)
T0 = datetime(2024, 1, 1)


def play(spark, folder, batches, schema, late="60 minutes"):
    """Each batch is one file and one trigger; what the stream has given, and what is left in its state."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = groups.event_time_groups(stream, late).writeStream.format("memory").queryName("event_groups").outputMode("append").option("checkpointLocation", f"{folder}/cp").start()
    try:
        q.processAllAvailable()
        left = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    finally:
        q.stop()
    return spark.table("event_groups").collect(), left


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rows_that_arrive_late_join_the_batch_groups(spark, tmp_path, kind):
    schema = f"scene long, id long, ts {kind}"
    rows = [(k % 2, k, T0 + timedelta(minutes=float(m), microseconds=k)) for k, m in enumerate(np.sort(g.uniform(0, 700, 120)))]
    # arrival: up to 50 minutes late
    order = np.argsort([(r[2] - T0).total_seconds() / 60 + g.uniform(0, 50) for r in rows])
    batches = [[rows[i] for i in part] for part in np.array_split(order, 8)]
    end = T0 + timedelta(days=2)
    got, left = play(spark, tmp_path, [*batches, [(99, 1000, end)], [(99, 1001, end + timedelta(days=2))], [(99, 1002, end + timedelta(days=4))]], schema)
    want = {r.id: (r.ts, r.anchor, r.g) for r in pairs.timeline(spark.createDataFrame(rows, schema)).collect()}
    assert {r.id: (r.ts, r.anchor) for r in got if r.id < 1000} == {k: v[:2] for k, v in want.items()}
    # groups that have ended are no state; the last scene alone is waiting
    assert max(left) >= 2 and left[-1] == 1


def test_a_row_behind_the_watermark_is_dropped(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    got, _ = play(spark, tmp_path, [[(1, 1, at(0)), (1, 2, at(200))], [(1, 3, at(400)), (None, 5, at(1)), (1, 6, None)], [(1, 4, at(10))], [(2, 9, at(2000))], [(2, 10, at(4000))]], "scene long, id long, ts timestamp")
    assert {r.id: r.anchor for r in got if r.scene == 1} == {1: at(0), 2: at(200), 3: at(400)}
