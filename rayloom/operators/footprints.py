"""Footprints of images on the ground and what follows from them: boxes, areas, crops, areas of interest.

Rings are tables of points (group, i, x, y); unions are found edge by edge: an edge meets the rings
whose boxes touch its own ring's, which the cells of `regions.box_pairs` find, so that a union of any
number of footprints is joins and aggregations, and no task holds them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cameras, geodesy, kernels
from ..session import kept
from . import geometry, polygons, regions

CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))


def corners(crops: DataFrame, heights: Column) -> DataFrame:
    """(cam_id, id, col, row, alt): the corners of crops (cam_id, col0, row0, width, height, and
    what `heights`, an array, is made of), counted on over the heights."""
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(CORNERS)])).alias("p")
    c = crops.select("cam_id", "col0", "row0", "width", "height", F.posexplode(heights).alias("h", "alt")).select("*", place)
    return c.select("cam_id", (F.col("h") * len(CORNERS) + F.col("p.k")).cast("long").alias("id"), (F.col("col0") + F.col("width") * F.col("p.a")).alias("col"), (F.col("row0") + F.col("height") * F.col("p.b")).alias("row"), F.col("alt").cast("double").alias("alt"))


def footprints(crops: DataFrame, models: DataFrame) -> DataFrame:
    """(cam_id, i, x, y): longitudes and latitudes of each crop's corners at its height `alt`."""
    ground = geometry.localize(corners(crops, F.array("alt")), models)
    return ground.select("cam_id", F.col("id").cast("int").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"))


def height_range(models: DataFrame, factor: float = 1.0) -> DataFrame:
    """(cam_id, low, high): the heights for which a model is made."""
    return models.select("cam_id", (F.col("alt_off") - factor * F.col("alt_scale")).alias("low"), (F.col("alt_off") + factor * F.col("alt_scale")).alias("high"))


def geodesic_boxes(crops: DataFrame, models: DataFrame) -> DataFrame:
    """(cam_id, lon0, lon1, lat0, lat1) of each crop between the ends of its model's heights."""
    c = crops.drop("alt").join(height_range(models), "cam_id")
    g = geometry.localize(corners(c, F.array("low", "high")), models)
    return g.groupBy("cam_id").agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))


def crop_zones(crops: DataFrame, models: DataFrame) -> DataFrame:
    """(cam_id, zone): the UTM zone of the ground below each crop's middle, at the model's own height."""
    m = crops.drop("alt").join(models.select("cam_id", F.col("alt_off").alias("alt")), "cam_id")
    g = geometry.localize(m.select("cam_id", F.lit(0).cast("long").alias("id"), (F.col("col0") + F.col("width") / 2).alias("col"), (F.col("row0") + F.col("height") / 2).alias("row"), "alt"), models)
    return g.select("cam_id", geodesy.zone_string(F.col("lon"), F.col("lat")).alias("zone"))


def ground_control(crops: DataFrame, models: DataFrame, n: int = 5) -> DataFrame:
    """(cam_id, id, col, row, alt, lon, lat): n x n x n points in each crop and its model's heights,
    half a step away from the crop's border."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = crops.drop("alt").join(height_range(models), "cam_id").withColumn("a", at).withColumn("b", at).withColumn("c", at)
    mid = lambda k: (F.col(k) + 0.5) / n
    alt = F.col("low") + (F.col("high") - F.col("low")) * F.col("c") / max(n - 1, 1)
    rows = g.select("cam_id", ((F.col("a") * n + F.col("b")) * n + F.col("c")).cast("long").alias("id"), (F.col("col0") + F.col("width") * mid("a")).alias("col"), (F.col("row0") + F.col("height") * mid("b")).alias("row"), alt.alias("alt"))
    return geometry.localize(rows, models)


def ground_sampling(models: DataFrame, alt: float = 0.0) -> DataFrame:
    """(cam_id, gsd): metres between the ground points of two neighbouring pixels at the image's middle."""
    two = models.select("cam_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("id"), "col_off", F.col("row_off").alias("row"), F.lit(alt).alias("alt"))
    g = geometry.localize(two.select("cam_id", "id", (F.col("col_off") + F.col("id")).alias("col"), "row", "alt"), models)
    x = g.select("cam_id", "id", *[c.alias(k) for c, k in zip(geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), "xyz", strict=True)])
    end = lambda k, i: F.max(F.when(F.col("id") == i, F.col(k)))
    return x.groupBy("cam_id").agg(F.sqrt(sum((F.pow(end(k, 1) - end(k, 0), 2) for k in "xyz"), F.lit(0.0))).alias("gsd"))


def keypoints_to_utm(keypoints: DataFrame, crops: DataFrame, models: DataFrame) -> DataFrame:
    """(cam_id, kp_id, east, north) of keypoints (cam_id, kp_id, col, row) of crops, each at its crop's height."""
    k = keypoints.join(crops.select("cam_id", "col0", "row0", "alt"), "cam_id")
    g = geometry.localize(k.select("cam_id", F.col("kp_id").alias("id"), (F.col("col") + F.col("col0")).alias("col"), (F.col("row") + F.col("row0")).alias("row"), F.col("alt").cast("double").alias("alt")), models)
    east, north = geodesy.to_utm(F.col("lon"), F.col("lat"), geodesy.utm_zone(F.col("lon")))
    return g.select("cam_id", F.col("id").alias("kp_id"), east.alias("east"), north.alias("north"))


def crops_of(ring: DataFrame, models: DataFrame, alt: float) -> DataFrame:
    """(cam_id, col0, row0, width, height): where each image sees an area (i, x, y in degrees), in whole
    pixels. A ring has few points, so it is joined to every camera. Whole pixels are cut off, so the order of the
    sums counts where an area's corner stands on a pixel's border: it is the one of `cameras.project_model`."""
    every = models.crossJoin(F.broadcast(ring.select("i", "x", "y").limit(10_000)))  # a ring's bound
    col, row = cameras.project_model(F.col("x"), F.col("y"), F.lit(float(alt)))
    p = every.select("cam_id", col.alias("col"), row.alias("row"))
    b = p.groupBy("cam_id").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    return b.select("cam_id", whole(F.col("c0")).alias("col0"), whole(F.col("r0")).alias("row0"), whole(F.col("c1") - F.col("c0")).alias("width"), whole(F.col("r1") - F.col("r0")).alias("height"))


def utm_rings(rings: DataFrame, by: str) -> DataFrame:
    """Rings in degrees as rings in metres of the zone of their first point, with that `zone`; the
    northing of the south has no offset, so a ring may cross the equator."""
    first = F.min_by("x", "i").over(W.partitionBy(by))
    r = rings.withColumn("zone", geodesy.utm_zone(first))
    east, north = geodesy.to_utm(F.col("x"), F.col("y"), F.col("zone"))
    return r.select(by, "i", "zone", east.alias("e"), (north - F.when(F.col("y") < 0, geodesy.NORTH0).otherwise(0.0)).alias("n")).select(by, "i", "zone", F.col("e").alias("x"), F.col("n").alias("y"))


def degree_rings(rings: DataFrame, by: str) -> DataFrame:
    """Rings in metres (group, i, zone, x, y), as `utm_rings` makes them, in degrees again."""
    lon, lat = geodesy.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.lit(False))
    return rings.select(by, "i", lon.alias("lon"), lat.alias("lat")).toDF(by, "i", "x", "y")


def utm_boxes(rings: DataFrame, by: str) -> DataFrame:
    """(group, x0, x1, y0, y1): boxes of rings in degrees; northings below 0 get the southern offset."""
    u = utm_rings(rings, by).withColumn("y", F.when(F.col("y") < 0, F.col("y") + geodesy.NORTH0).otherwise(F.col("y")))
    return u.groupBy(by).agg(*[f(k).alias(f"{k}{j}") for k in "xy" for j, f in enumerate((F.min, F.max))])


def square_kilometres(rings: DataFrame, by: str) -> DataFrame:
    """(group, km2): areas of rings in degrees."""
    return polygons.areas(utm_rings(rings, by), by).select(by, (F.col("area") / 1e6).alias("km2"))


def _edges(rings: DataFrame, by: str) -> DataFrame:
    w = W.partitionBy(by).orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return rings.withColumns({"u": nxt("x"), "v": nxt("y")})


def centres(rings: DataFrame, by: str) -> DataFrame:
    """(group, cx, cy): centroids of the rings' areas."""
    cross = F.col("x") * F.col("v") - F.col("u") * F.col("y")
    s = _edges(rings, by).groupBy(by).agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("u")) * cross).alias("p"), F.sum((F.col("y") + F.col("v")) * cross).alias("q"))
    return s.select(by, (F.col("p") / (3 * F.col("a"))).alias("cx"), (F.col("q") / (3 * F.col("a"))).alias("cy"))


def repaired(rings: DataFrame, by: str) -> DataFrame:
    """(group, i, x, y, cx, cy): rings with their centres; where two edges of a ring cross, its
    points are put in order of the angle at which they stand about the centre."""
    e = _edges(rings, by).select(by, "i", "x", "y", "u", "v")
    f = e.select(by, *[F.col(c).alias(f"{c}2") for c in "ixyuv"])
    side = lambda a, b, c, d, p, q: (F.col(c) - F.col(a)) * (F.col(q) - F.col(b)) - (F.col(d) - F.col(b)) * (F.col(p) - F.col(a))
    one, two = ("x", "y", "u", "v"), ("x2", "y2", "u2", "v2")
    crosses = (side(*one, "x2", "y2") * side(*one, "u2", "v2") < 0) & (side(*two, "x", "y") * side(*two, "u", "v") < 0)
    w, boxed = (F.least, F.greatest), []
    for c, d in (("x", "u"), ("y", "v")):
        boxed += [w[k](c, d).alias(f"{c}{k}") for k in (0, 1)]
    near = regions.box_pairs(e.select(by, "i", *boxed), [by], "i").toDF(by, "i", "i2")  # edges whose boxes meet
    bad = near.join(e, [by, "i"]).join(f, [by, "i2"]).where(crosses).select(by).distinct().withColumn("bad", F.lit(True))
    r = rings.select(by, "i", "x", "y").join(centres(rings, by), by).join(bad, by, "left")
    order = F.when(F.col("bad"), F.atan2(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).otherwise(F.col("i").cast("double"))
    return r.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(order, "i")) - 1).select(by, F.col("k").alias("i"), "x", "y", "cx", "cy")


def union_border(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(group, x, y, u, v): the pieces of edges that make the border of the union of a group's convex
    rings (group, member, i, x, y), each ring to the left of its own pieces.

    An edge is cut by every other ring of its group whose box it meets; what no ring covers is border.
    Of two edges on one line and in one direction, the one of the smaller member counts.
    """
    ring = W.partitionBy(by, member).orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    e = rings.select(by, member, "i", "x", "y").withColumns({"u": nxt("x"), "v": nxt("y")})
    turn = F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")).over(W.partitionBy(by, member))
    e = e.withColumn("left", turn > 0)
    flip = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b))
    e = e.select(by, member, "i", flip("x", "u").alias("x"), flip("y", "v").alias("y"), flip("u", "x").alias("u"), flip("v", "y").alias("v"))
    walls = e.groupBy(by, F.col(member).alias("other")).agg(F.collect_list(F.struct("x", "y", "u", "v")).alias("walls"), *[f(k).alias(f"{k}{j}") for k in "xy" for j, f in enumerate((F.min, F.max))])
    near = regions.box_pairs(walls.drop("walls"), [by], "other")
    near = near.select(by, F.explode(F.array(F.struct(F.col("a").alias(member), F.col("b").alias("other")), F.struct(F.col("b").alias(member), F.col("a").alias("other")))).alias("__p")).select(by, f"__p.{member}", "__p.other")
    met = e.join(near, [by, member]).join(walls, [by, "other"])
    met = met.where((F.least("x", "u") <= F.col("x1")) & (F.greatest("x", "u") >= F.col("x0")) & (F.least("y", "v") <= F.col("y1")) & (F.greatest("y", "v") >= F.col("y0")))
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    # inside a wall's left: s0 + t (s1 - s0) > 0
    start = lambda w: (w["u"] - w["x"]) * (F.col("y") - w["y"]) - (w["v"] - w["y"]) * (F.col("x") - w["x"])
    slope = lambda w: (w["u"] - w["x"]) * dy - (w["v"] - w["y"]) * dx
    along = lambda w: (w["u"] - w["x"]) * dx + (w["v"] - w["y"]) * dy
    flat = lambda w: F.abs(slope(w)) <= 1e-12 * (F.abs(along(w)) + 1e-300)
    on_line = lambda w: (start(w) > 0) | ((start(w) == 0) & (along(w) > 0) & (F.col("other") < F.col(member)))
    low = lambda w: F.when(flat(w), F.when(on_line(w), 0.0).otherwise(2.0)).when(slope(w) > 0, -start(w) / slope(w)).otherwise(0.0)
    high = lambda w: F.when(flat(w), F.lit(1.0)).when(slope(w) < 0, -start(w) / slope(w)).otherwise(1.0)
    met = met.select(by, member, "i", F.greatest(F.lit(0.0), F.array_max(F.transform("walls", low))).alias("a"), F.least(F.lit(1.0), F.array_min(F.transform("walls", high))).alias("b")).where("a < b")
    covered = met.groupBy(by, member, "i").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("c"))  # the rings that one edge meets
    e = e.join(covered, [by, member, "i"], "left")
    c = F.coalesce("c", F.array().cast("array<struct<a:double,b:double>>"))
    ends = F.concat(F.transform(c, lambda s: s["a"]), F.array(F.lit(1.0)))
    reach = F.transform(F.sequence(F.lit(0), F.size(c)), lambda k: F.coalesce(F.array_max(F.transform(F.slice(c, 1, k), lambda s: s["b"])), F.lit(0.0)))
    gaps = F.filter(F.zip_with(reach, ends, lambda s, t: F.struct(s.alias("s"), t.alias("t"))), lambda g: g["s"] < g["t"])
    p = e.select(by, "x", "y", "u", "v", F.explode(gaps).alias("__g"))
    at = lambda p0, p1, t: F.col(p0) + (F.col(p1) - F.col(p0)) * F.col(f"__g.{t}")
    return p.select(by, at("x", "u", "s").alias("x"), at("y", "v", "s").alias("y"), at("x", "u", "t").alias("u"), at("y", "v", "t").alias("v"))


def union_areas(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(group, area) of the union of a group's rings."""
    b = regions.covered_border(rings.withColumn("ring", F.lit(0)), by, member)
    return b.groupBy(by).agg((F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2).alias("area"))


def shared_parts(rings: DataFrame, by: str, member: str) -> DataFrame:
    """(group, member, i, x, y): what two convex rings of a group have in common, one ring for each pair
    that has an area in common; `member` numbers the pairs of a group."""
    r = rings.groupBy(by, member).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"), *[f(k).alias(f"{k}{j}") for k in "xy" for j, f in enumerate((F.min, F.max))])
    a, b = (r.select(by, *[F.col(c).alias(f"{c}_{s}") for c in (member, "r", "x0", "x1", "y0", "y1")]) for s in "ab")
    near = regions.box_pairs(r.drop("r"), [by], member).toDF(by, f"{member}_a", f"{member}_b")
    m = near.join(a, [by, f"{member}_a"]).join(b, [by, f"{member}_b"]).where("x0_a < x1_b and x0_b < x1_a and y0_a < y1_b and y0_b < y1_a")
    kind = rings.schema[by].dataType.simpleString()

    def cut(parts):
        for pdf in parts:
            out = []
            for g, i, j, p, q in zip(pdf[by], pdf["i"], pdf["j"], pdf["r_a"], pdf["r_b"], strict=True):
                ring = kernels.clip(*(kernels.hull(np.array([(z["x"], z["y"]) for z in s], float)) for s in (p, q)))
                if kernels.area(ring) > 0:
                    out += [(g, f"{i}|{j}", k, *map(float, z)) for k, z in enumerate(ring)]
            yield pd.DataFrame(out, columns=[by, "member", "i", "x", "y"])

    return m.select(by, F.col(f"{member}_a").cast("string").alias("i"), F.col(f"{member}_b").cast("string").alias("j"), "r_a", "r_b").mapInPandas(cut, f"{by} {kind}, member string, i int, x double, y double")


def seen_twice(rings: DataFrame, by: str, member: str) -> DataFrame:
    """The border of the area that two rings of a group or more cover, as `regions.covered_border` gives it: from one
    overlay, not from the rings of all pairs."""
    return regions.covered_border(rings.withColumn("ring", F.lit(0)), by, member, 2)


def footprint_pairs(rings: DataFrame, centres_: DataFrame) -> DataFrame:
    """(cam_i, cam_j, overlap, baseline) for `pairs.qualify_pairs`: the share of i's footprint that j
    covers too, and the distance of the cameras' centres (cam_id, cx, cy, cz). Pairs whose boxes do
    not meet have no overlap and no row."""
    r = rings.groupBy("cam_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"), *[f(k).alias(f"{k}{j}") for k in "xy" for j, f in enumerate((F.min, F.max))])
    r = r.join(centres_, "cam_id").withColumn("footprint", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    r = kept(r, "footprints")
    a, b = (r.select(*[F.col(c).alias(f"{c.removesuffix('_id')}_{s}") for c in ("cam_id", "footprint", "x0", "x1", "y0", "y1", "cx", "cy", "cz")]) for s in "ij")
    near = regions.box_pairs(r.select("cam_id", "x0", "x1", "y0", "y1"), [], "cam_id").toDF("cam_i", "cam_j")
    m = near.join(a, "cam_i").join(b, "cam_j").where("x0_i < x1_j and x0_j < x1_i and y0_i < y1_j and y0_j < y1_i")
    far = F.sqrt(sum((F.pow(F.col(f"{c}_i") - F.col(f"{c}_j"), 2) for c in ("cx", "cy", "cz")), F.lit(0.0)))
    return polygons.overlap(m.select("cam_i", "cam_j", "footprint_i", "footprint_j")).join(m.select("cam_i", "cam_j", far.alias("baseline")), ["cam_i", "cam_j"])
