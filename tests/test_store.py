"""Batches that are committed as a whole, and kept matches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rayloom.sources.store import Store, kept_matches


def table(spark, *rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_batches_replace_by_key(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    assert s.batches() == [] and s.read("t") is None and s.sweep() == 0
    s.put({"t": table(spark, ("a", 1), ("b", 1))}, ["a", "b"])
    s.put({"t": table(spark, ("b", 2), ("c", 2))}, ["b", "c"])
    assert sorted(map(tuple, s.read("t", "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert s.read("t").count() == 4 and s.read("other") is None
    s.put({"t": table(spark, ("a", 3))}, ["a"])
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 3), ("b", 2), ("c", 2)]  # of the first batch no key is left
    s.put({"t": table(spark, ("z", 9))}, ["z"], reset=True)
    assert [tuple(r) for r in s.read("t", "k").collect()] == [("z", 9)]
    assert s.sweep() == 3 and [tuple(r) for r in s.read("t", "k").collect()] == [("z", 9)]


def test_only_committed_batches_count(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.put({"t": table(spark, ("a", 1))}, ["a"])
    bad = table(spark, ("a", 2)).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        s.put({"t": table(spark, ("a", 2)), "u": bad}, ["a"])
    open(f"{tmp_path}/s/log/00000001.json", "w").close()  # a writer died here
    assert [tuple(r) for r in s.read("t", "k").collect()] == [("a", 1)] and s.read("u") is None
    s.put({"t": table(spark, ("a", 3))}, ["a"])
    assert sorted(f for f in os.listdir(f"{tmp_path}/s/log") if f[0] != ".") == [f"0000000{k}.json" for k in range(3)]
    assert [tuple(r) for r in s.read("t", "k").collect()] == [("a", 3)]
    assert json.loads(open(f"{tmp_path}/s/log/00000002.json").read())["keys"] == ["a"]
    assert s.sweep() == 1


def test_two_writers_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    """Both look before either commits."""
    a, b = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    a.put({"t": table(spark, ("a", 1))}, ["a"])
    plain = Store._fs

    def late(self, path):
        if path.endswith("00000001.json") and self is b and not late.done:
            late.done = True
            a.put({"t": table(spark, ("b", 1))}, ["b"])
        return plain(self, path)

    late.done = False
    monkeypatch.setattr(Store, "_fs", late)
    b.put({"t": table(spark, ("c", 1))}, ["c"])
    assert set(a.owners()) == {"a", "b", "c"} and a.read("t", "k").count() == 3


def test_matches_are_found_in_either_direction(spark, tmp_path):
    s, asked = Store(spark, f"{tmp_path}/m"), []

    def match(new):
        asked.append(sorted(map(tuple, new.collect())))
        return new.where("image_i <> 'c'").select("image_i", "image_j", F.lit(1).cast("long").alias("kp_i"), F.lit(2).cast("long").alias("kp_j"))

    pairs = lambda *p: spark.createDataFrame(p, "image_i string, image_j string")
    empty, n = kept_matches(s, pairs(("a", "b")).where("false"), match)
    assert (empty.count(), n, asked) == (0, 0, [])
    m, n = kept_matches(s, pairs(("b", "a"), ("c", "d")), match)
    assert n == 2 and asked == [[("a", "b"), ("c", "d")]] and [tuple(r) for r in m.collect()] == [("b", "a", 2, 1)]
    m, n = kept_matches(s, pairs(("a", "b"), ("d", "c"), ("a", "d")), match)
    assert n == 1 and asked[1:] == [[("a", "d")]] and sorted(map(tuple, m.collect())) == [("a", "b", 1, 2), ("a", "d", 1, 2)]
    m, n = kept_matches(s, pairs(("d", "a")), match)
    assert n == 0 and len(asked) == 2 and [tuple(r) for r in m.collect()] == [("d", "a", 2, 1)]


def test_a_matching_that_fails_leaves_nothing(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/m")
    pairs = spark.createDataFrame([("a", "b")], "image_i string, image_j string")
    with pytest.raises(Exception, match="lost"):
        kept_matches(s, pairs, lambda new: new.select("image_i", "image_j", F.lit(1).alias("kp_i"), F.raise_error(F.lit("lost")).cast("long").alias("kp_j")))
    assert s.batches() == []


def test_a_series_from_folders(spark, tmp_path):
    """Images and models that stand in folders of their own, of two formats, with strays on both sides."""
    import os as _os

    from rayloom.operators import geometry
    from rayloom.sources import files

    image = lambda name: (_os.makedirs(_os.path.dirname(f"{tmp_path}/im/{name}"), exist_ok=True), open(f"{tmp_path}/im/{name}", "wb").write(b"II"))
    for name in ("a/20240101_101500_s1_x.tif", "b/deep/20240102_101500_s2_y.tif", "20240103_101500_s1_lone.tif", "nameless.tif"):
        image(name)
    _os.makedirs(f"{tmp_path}/rpc")
    lines = [f"{t}: {k + 1}.5" for k, t in enumerate(files.SCALARS)] + [f"{t}_{i}: {i}.25" for t in files.VECTORS for i in range(1, 21)]
    for name in ("20240101_101500_s1_x.rpc", "20240109_101500_s1_none.rpc"):
        open(f"{tmp_path}/rpc/{name}", "w").write("\n".join(lines))
    xml = "".join(f"<{t}>{k + 1}.5</{t}>" for k, t in enumerate(files.LISTED_SCALARS)) + "".join(f"<{t}>{' '.join(f'{i}.25' for i in range(1, 21))}</{t}>" for t in files.LISTED)
    open(f"{tmp_path}/rpc/20240102_101500_s2_y.xml", "w").write(f"<isd>{xml}</isd>")
    open(f"{tmp_path}/rpc/notes.txt", "w").write("nothing of this kind")
    images, models = files.series(spark, f"{tmp_path}/im", f"{tmp_path}/rpc")
    got = {r.image_id: r for r in images.collect()}
    assert {(k, r.sensor, str(r.ts)[:16]) for k, r in got.items()} == {("20240101_101500_s1_x", "s1", "2024-01-01 10:15"), ("20240102_101500_s2_y", "s2", "2024-01-02 10:15")}
    assert set(geometry.FIELDS) < set(models.columns) and {r.image_id for r in models.collect()} == set(got)
    assert {r.row_off for r in models.collect()} == {1.5} and all(r.width == 2 * m.col_scale for m in models.collect() for r in [got[m.image_id]])
