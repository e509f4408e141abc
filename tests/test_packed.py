"""Texts of many images in a few files, and tags that a text is searched for once."""

import glob
import time

from pyspark.sql import functions as F

from rayloom.sources import files


def test_packed_texts_come_back_whole(spark, tmp_path):
    rows = [("img 1/2", 1, 'b: "x"\\'), ("img 1/2", 0, "a\tä"), ("img 3", 0, "only"), (None, 0, "none")]
    files.write_packed(spark.createDataFrame(rows, "image_id string, i int, value string"), f"{tmp_path}/p")
    got = {r.image_id: r.value for r in files.read_packed(spark, f"{tmp_path}/p").collect()}
    assert got == {"img 1/2": 'a\tä\nb: "x"\\\n', "img 3": "only\n", None: "none\n"}


def test_many_images_make_few_files_that_are_searched_once(spark, tmp_path):
    """4000 images took a folder and a file each, and each tag another search of its text."""
    tags = [t for t in files.NUMBERED]
    body = F.concat(*[F.concat(F.lit(f"<{t}>"), (F.col("id") + k).cast("double").cast("string"), F.lit(f"</{t}>\n")) for k, t in enumerate(tags)])
    text = F.concat(F.lit("<D><Inverse_Model>\n"), body, F.lit("<LINE_OFF>-5</LINE_OFF></Inverse_Model></D>"))
    began = time.time()
    files.write_packed(spark.range(4000).select(F.concat(F.lit("img "), "id").alias("image_id"), F.lit(0).alias("i"), text.alias("value")), f"{tmp_path}/p")
    got = {r.image_id: r for r in files.parse_rpc_files(files.read_packed(spark, f"{tmp_path}/p")).collect()}
    assert time.time() - began < 60 and len(glob.glob(f"{tmp_path}/p/*.json")) <= 16
    assert len(got) == 4000
    for k in (0, 7, 3999):
        r = got[f"img {k}"]
        assert r.row_off == k + tags.index("LINE_OFF") - 1 and r.lat_off == k + tags.index("LAT_OFF")  # the first of equal tags
        assert r.col_den == [k + tags.index(f"SAMP_DEN_COEFF_{i}") for i in range(1, 21)]
