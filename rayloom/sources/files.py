"""File formats: sensor model texts, GeoJSON polygons, point clouds, pair and path lists.

Reading is by Spark's readers and column functions, so a folder of any number of files is one
table; writing gives one row of text a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tags of the text format and the fields they fill (fixed values of the format).
SCALARS = {
    "LINE_OFF": "row_off", "SAMP_OFF": "col_off", "LAT_OFF": "lat_off", "LONG_OFF": "lon_off", "HEIGHT_OFF": "alt_off",
    "LINE_SCALE": "row_scale", "SAMP_SCALE": "col_scale", "LAT_SCALE": "lat_scale", "LONG_SCALE": "lon_scale", "HEIGHT_SCALE": "alt_scale",
}
VECTORS = {"LINE_NUM_COEFF": "row_num", "LINE_DEN_COEFF": "row_den", "SAMP_NUM_COEFF": "col_num", "SAMP_DEN_COEFF": "col_den"}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def image_of(suffix: str = "") -> Column:
    """The image that a file is of: what its folder is named for where the sinks here wrote it
    (image_id=...), else its name without `suffix` and ending."""
    path = F.col("_metadata.file_path")
    own = F.url_decode(F.regexp_extract(path, r"/image_id=([^/]*)/[^/]*$", 1))
    return F.when(own != "", own).otherwise(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), rf"{suffix}(\.[^.]*)?$", "")).alias("image_id")


def read_rpc_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of `TAG: value` lines: image_id (file name without ending) and the model.

    Files are small and many: whole files are rows, and their lines become a map in one projection.
    """
    return parse_rpc_texts(spark.read.text(path, wholetext=True).select(image_of(), F.col("value")))


def _found(raw: DataFrame, text: Column, pattern: str, others: Column | None = None, *also: Column) -> DataFrame:
    """(image_id, also, m): tags and numbers that the pattern finds in a text, as a map; of equal tags the first. What was found
    is a column of its own, or each element would search the whole text again."""
    own = raw.select("image_id", *also, *[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(c) for i, c in ((1, "__t"), (2, "__n"))])
    first = F.filter(F.arrays_zip("__t", "__n"), lambda p, i: F.array_position(F.col("__t"), p["__t"]) == i + 1)
    if others is not None:
        first = F.filter(first, lambda p: F.array_contains(others, p["__t"]))
    return own.select(*[c for c in own.columns if c not in ("__t", "__n")], F.map_from_entries(first).alias("m"))


def parse_rpc_texts(raw: DataFrame) -> DataFrame:
    pattern = rf"([A-Z_0-9]+)\s*:\s*({NUMBER})"
    m = _found(raw, F.col("value"), pattern)
    get = lambda tag: F.try_element_at("m", F.lit(tag)).cast("double")
    vector = lambda tag: F.array(*[get(f"{tag}_{i}") for i in range(1, 21)])
    return m.select("image_id", *[get(t).alias(f) for t, f in SCALARS.items()], *[vector(t).alias(f) for t, f in VECTORS.items()])


#: Tags of the XML formats (fixed values): one number a tag and coefficient, or one list of 20 a tag.
NUMBERED = SCALARS | {f"{t}_{i}": f for t, f in VECTORS.items() for i in range(1, 21)}
LISTED = {"LINENUMCOEF": "row_num", "LINEDENCOEF": "row_den", "SAMPNUMCOEF": "col_num", "SAMPDENCOEF": "col_den"}
LISTED_SCALARS = {t.replace("_OFF", "OFFSET").replace("_SCALE", "SCALE"): f for t, f in SCALARS.items()}


def parse_rpc_xml(raw: DataFrame) -> DataFrame:
    """`parse_rpc_texts` for XML: (image_id, value) whose value has an Inverse_Model of numbered tags,
    with pixels counted from 1, or tags that end in OFFSET, SCALE and COEF, the latter with 20 numbers."""
    pattern = rf"<([A-Za-z_0-9]+)>\s*({NUMBER}(?:\s+{NUMBER})*)\s*</"
    inverse = F.locate("<Inverse_Model>", "value")
    # offsets and scales stand outside the inverse model, behind it or before
    own = F.when(inverse > 0, F.concat(F.expr("substring(value, locate('<Inverse_Model>', value))"), F.regexp_replace("value", r"(?s)<Direct_Model>.*?</Direct_Model>|<Inverse_Model>.*?</Inverse_Model>", ""))).otherwise(F.col("value"))
    r = raw.select("image_id", own.alias("v"), (inverse > 0).alias("numbered"))
    known = F.array(*[F.lit(t) for t in (*NUMBERED, *LISTED, *LISTED_SCALARS)])
    m = _found(r, F.col("v"), pattern, known, F.col("numbered"))
    get = lambda tag: F.try_element_at("m", F.lit(tag)).cast("double")
    other = {f: t for t, f in LISTED_SCALARS.items()}
    less = lambda f: F.when(F.col("numbered"), 1.0).otherwise(0.0) if f in ("row_off", "col_off") else F.lit(0.0)
    lists = {f: t for t, f in LISTED.items()}
    vector = lambda tag, f: F.when(F.col("numbered"), F.array(*[get(f"{tag}_{i}") for i in range(1, 21)])).otherwise(F.transform(F.split(F.try_element_at("m", F.lit(lists[f])), r"\s+"), lambda x: x.cast("double")))
    return m.select("image_id", *[(F.coalesce(get(t), get(other[f])) - less(f)).alias(f) for t, f in SCALARS.items()], *[vector(t, f).alias(f) for t, f in VECTORS.items()])


def read_rpc_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_rpc_files(spark.read.text(path, wholetext=True).select(image_of(), F.col("value")))


def parse_rpc_files(raw: DataFrame) -> DataFrame:
    """Sensor models of texts (image_id, value) of any of the three formats; XML is known by its first character."""
    xml = F.ltrim("value").startswith("<")
    return parse_rpc_texts(raw.where(~xml)).unionByName(parse_rpc_xml(raw.where(xml)))


def rpc_tags(models: DataFrame) -> DataFrame:
    """(image_id, tags): each model as a map from tag to text, a vector as its 20 numbers with spaces."""
    one = lambda t, v: (F.lit(t), v)
    pairs = [one(t, F.col(f).cast("string")) for t, f in SCALARS.items()] + [one(t, F.array_join(F.transform(f, lambda x: x.cast("string")), " ")) for t, f in VECTORS.items()]
    return models.select("image_id", F.create_map(*[x for p in pairs for x in p]).alias("tags"))


def rpc_lines(models: DataFrame) -> DataFrame:
    """(image_id, i, value): the lines of each model's text file."""
    one = lambda tag, v: F.concat(F.lit(f"{tag}: "), v.cast("string"))
    lines = [one(t, F.col(f)) for t, f in SCALARS.items()] + [one(f"{t}_{i + 1}", F.col(f)[i]) for t, f in VECTORS.items() for i in range(20)]
    return models.select("image_id", F.posexplode(F.array(*lines)).alias("i", "value"))


def write_rpc_texts(models: DataFrame, path: str) -> None:
    """One folder an image, in it its lines in order."""
    rpc_lines(models).repartition("image_id").sortWithinPartitions("image_id", "i").select("image_id", "value").write.partitionBy("image_id").mode("overwrite").text(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, x, y): outer rings of GeoJSON polygons, inside features and collections or bare."""
    schema = "type string, coordinates array<array<array<double>>>, geometry struct<coordinates: array<array<array<double>>>>, features array<struct<geometry: struct<coordinates: array<array<array<double>>>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    ring = F.coalesce(F.col("features")[0]["geometry"]["coordinates"], F.col("geometry.coordinates"), F.col("coordinates"))[0]
    return raw.select("file", F.posexplode(ring).alias("i", "p")).select("file", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, ring, i, x, y) for `operators.regions`: all rings of the polygons and multi-polygons of GeoJSON
    files, in collections, features or bare. Each polygon is a member; ring 0 is its outer one; the point
    that closes a ring is left out. Other geometries have no ring."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    inner = F.when(get("$.features", "array<variant>").isNotNull(), F.transform(get("$.features", "array<variant>"), lambda f: F.try_variant_get(f, "$.geometry", "variant")))
    inner = inner.when(get("$.geometries", "array<variant>").isNotNull(), get("$.geometries", "array<variant>")).when(get("$.geometry", "variant").isNotNull(), F.array(get("$.geometry", "variant"))).otherwise(F.array("v"))
    g = raw.select("path", F.posexplode(inner).alias("k", "g"))
    kind, one, many = F.try_variant_get("g", "$.type", "string"), *(F.try_variant_get("g", "$.coordinates", t) for t in ("array<array<array<double>>>", "array<array<array<array<double>>>>"))
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    p = g.select("path", "k", F.posexplode(polygons).alias("part", "rings")).select("path", "k", "part", F.posexplode("rings").alias("ring", "points"))
    closed = (F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1))
    p = p.withColumn("points", F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")))
    p = p.select("path", F.concat_ws(".", "k", "part").alias("member"), "ring", F.posexplode("points").alias("i", "p"))
    return p.select("path", "member", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def polygon_json(points: DataFrame, by: str) -> DataFrame:
    """(group, value): one GeoJSON polygon a group of (group, i, x, y)."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    return points.groupBy(by).agg(F.to_json(F.struct(F.array(ring).alias("coordinates"), F.lit("Polygon").alias("type"))).alias("value"))


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of ASCII point cloud files; lines before the end of the header are no numbers."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v"))
    number = lambda i: F.expr(f"try_cast(try_element_at(v, {i}) as double)")
    p = raw.select(*[number(i + 1).alias(c) for i, c in enumerate("xyz")])
    return p.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def point_cloud_lines(points: DataFrame) -> DataFrame:
    """(i, value): header and points, in order of `i`."""
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property float x", "property float y", "property float z", "end_header"]
    top = points.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "i long, value string")
    return top.unionByName(points.select(F.monotonically_increasing_id().alias("i"), F.concat_ws(" ", "x", "y", "z").alias("value")))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_predefined_matches(keypoints: DataFrame, matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Matches of a stored set for the images of a new one: both image lists (cam_id, image_id)
    meet by image, numbers follow the new list, and every match is turned to cam_i < cam_j. The
    keypoints' (cam_id, kp_id, col, row, scale) join to both ends."""
    from ..operators.tracks import reindex_matches

    ids = old.select(F.col("cam_id").alias("old"), "image_id").join(new.select(F.col("cam_id").alias("new"), "image_id"), "image_id")
    m = reindex_matches(matches, ids)
    moved = keypoints.join(ids, keypoints["cam_id"] == ids["old"]).select(F.col("new").alias("cam_id"), "kp_id", "col", "row", "scale")
    end = lambda i: moved.select(*[F.col(c).alias(f"{c}_{i}") for c in ("cam_id", "kp_id", "col", "row", "scale")])
    return m.join(end("i"), (F.col("cam_i") == F.col("cam_id_i")) & (F.col("kp_i") == F.col("kp_id_i"))).join(end("j"), (F.col("cam_j") == F.col("cam_id_j")) & (F.col("kp_j") == F.col("kp_id_j"))).drop("cam_id_i", "kp_id_i", "cam_id_j", "kp_id_j")


def latest(files: DataFrame) -> DataFrame:
    """The newest row of each image of (image_id, ts, ...)."""
    return files.withColumn("k", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("ts")))).where("k = 1").drop("k")


def discover(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, image_id, bytes, ts) of the files below a folder, however deep; contents are not read.
    `ts` is when the image was taken, by its name."""
    from ..functions import names

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return f.select("path", names.image_id(F.col("path")).alias("image_id"), F.col("length").alias("bytes"), names.acquired(F.lit(None).cast("string"), F.col("path")).alias("ts"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return parse_params(spark.read.text(path, wholetext=True).select(image_of(), F.col("value")))


def parse_params(raw: DataFrame) -> DataFrame:
    """(image_id, params: map of a name to numbers) of the texts (image_id, value) that `params_lines` makes."""
    raw = raw.select("image_id", F.split(F.rtrim("value"), "\n").alias("v"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda k: F.struct(F.get("v", 2 * k), F.transform(F.split(F.get("v", 2 * k + 1), " "), lambda x: x.cast("double"))))
    return raw.select("image_id", F.map_from_entries(pairs).alias("params"))


def write_packed(lines: DataFrame, path: str) -> None:
    """Rows (image_id, i, value) as a text an image, many texts a file: a JSON record a line with the image and its whole
    text. A file and a folder an image, as `write_lines` makes them, cost some milliseconds each to make, commit, list and
    open, which is what a job of many thousands of images would do and nothing else."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: F.concat(x["value"], F.lit("\n")))  # an image's own lines
    lines.groupBy("image_id").agg(F.array_join(text, "").alias("value")).write.mode("overwrite").json(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, value) of what `write_packed` wrote, for the parsers."""
    return spark.read.schema("image_id string, value string").json(path)


def write_lines(lines: DataFrame, path: str, by: str = "image_id") -> None:
    """Rows (by, i, value) as one folder a group of `by`, its lines in order of `i`."""
    lines.repartition(by).sortWithinPartitions(by, "i").select(by, "value").write.partitionBy(by).mode("overwrite").text(path)


def matrix_json(matrices: DataFrame) -> DataFrame:
    """(image_id, i, value): a JSON text for each matrix (image_id, p: 3 rows of 4, col0, row0, width, height)."""
    whole = lambda c: F.col(c).cast("long")
    v = F.to_json(F.struct(F.col("p").alias("P"), whole("height").alias("height"), whole("width").alias("width"), whole("col0").alias("col_offset"), whole("row0").alias("row_offset")))
    return matrices.select("image_id", F.lit(0).alias("i"), v.alias("value"))


def read_matrices(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(image_id, p, col0, row0, width, height): matrices divided by their last entry, and crops, of JSON files;
    `suffix` is what a file's name has behind the image's."""
    raw = spark.read.schema(MATRIX).json(path, multiLine=True)
    return _matrices(raw.select(image_of(suffix), *raw.columns))


MATRIX = "P array<array<double>>, height long, width long, col_offset long, row_offset long"


def parse_matrices(raw: DataFrame) -> DataFrame:
    """`read_matrices` for texts (image_id, value)."""
    return _matrices(raw.select("image_id", F.from_json("value", MATRIX).alias("v")).select("image_id", "v.*"))


def _matrices(raw: DataFrame) -> DataFrame:
    last = F.col("P")[2][3]
    p = F.transform("P", lambda r: F.transform(r, lambda x: x / last))
    return raw.select("image_id", p.alias("p"), F.col("col_offset").alias("col0"), F.col("row_offset").alias("row0"), "width", "height")


def params_lines(params: DataFrame) -> DataFrame:
    """(image_id, i, value): for each camera (image_id, params: map of a name to numbers) a line with each
    name and one with its numbers at 16 places."""
    e = params.select("image_id", F.posexplode(F.map_entries("params")).alias("k", "e"))
    two = F.array(F.col("e.key"), F.array_join(F.transform("e.value", lambda x: F.format_string("%.16f", x)), " "))
    return e.select("image_id", "k", F.posexplode(two).alias("j", "value")).select("image_id", (2 * F.col("k") + F.col("j")).alias("i"), "value")


def write_points(points: DataFrame, drift: DataFrame | None, path: str) -> None:
    """Points (x, y, z) less a drift of one row (dx, dy, dz), as one table of text lines with its header."""
    if drift is not None:
        points = points.crossJoin(F.broadcast(drift.limit(1))).select(*[(F.col(c) - F.col(f"d{c}")).alias(c) for c in "xyz"])
    point_cloud_lines(points).sort("i").select("value").write.mode("overwrite").text(path)


def write_list(paths: DataFrame, path: str) -> None:
    """Paths (path), one a line."""
    paths.select("path").write.mode("overwrite").text(path)


def write_predefined_matches(keypoints: DataFrame, matches: DataFrame, images: DataFrame, folder: str) -> None:
    """What `read_predefined_matches` takes: keypoints without descriptors, matches and the image list."""
    keypoints.select("cam_id", "kp_id", "col", "row", "scale").write.mode("overwrite").parquet(f"{folder}/keypoints")
    matches.select("cam_i", "cam_j", "kp_i", "kp_j").write.mode("overwrite").parquet(f"{folder}/matches")
    images.select("cam_id", "image_id").write.mode("overwrite").parquet(f"{folder}/images")


def series(spark: SparkSession, folder: str, models_folder: str | None = None, pattern: str = "*.tif", model_pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(images, models) for `plans.job`: the images below a folder, however deep, and the sensor models of the files below
    `models_folder` (the same folder where it is not given), of any of the three formats, by image. Of images that stand
    there more than once the newest file counts; an image without a model, or whose name has no time,
    is left out, and so is a model without an image.

    Image files are not opened: the crop is the whole of what the model covers, from 0; its height is the model's
    own; the sensor is what stands behind the time in the name.
    """
    found = discover(spark, folder, pattern).where("ts IS NOT NULL")
    one = latest(found).select("image_id", "ts")
    f = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", model_pattern).load(models_folder or folder)
    raw = f.select(image_of(), F.col("value")).where(F.col("value").rlike(r"LINE_OFF|LINEOFFSET"))
    xml = F.ltrim("value").startswith("<")
    every = parse_rpc_texts(raw.where(~xml)).unionByName(parse_rpc_xml(raw.where(xml)))
    models = every.withColumn("k", F.row_number().over(W.partitionBy("image_id").orderBy("col_off", "row_off"))).where("k = 1 AND row_off IS NOT NULL").drop("k").join(one.select("image_id"), "image_id", "left_semi")
    size = models.select("image_id", (2 * F.col("col_scale")).alias("width"), (2 * F.col("row_scale")).alias("height"), F.col("alt_off").alias("alt"))
    sensor = F.regexp_extract("image_id", r"^\d{8}_\d{6}_([^_]*)", 1)
    images = one.join(size, "image_id").select("image_id", sensor.alias("sensor"), F.lit(0).alias("scene"), "ts", F.lit(0.0).alias("col0"), F.lit(0.0).alias("row0"), "width", "height", "alt")
    return images, models
