"""Grids of heights as tables of tiles, and their values at points.

A grid is a table of nodes (ix, iy, h); node (ix, iy) stands at (lon0 + ix * step, lat0 + iy * step).
A tile holds the nodes of `size` x `size` cells and the next row and column besides, so that a point
needs its own tile only: one equi-join on the tile, whatever the grid's size. A grid that goes
round the earth has `round` columns, after which the first comes again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 32


def tiled(nodes: DataFrame, size: int = SIZE, round_: int | None = None) -> DataFrame:
    """(tx, ty, h): nodes (ix, iy, h) as tiles; `h` is a list of (size + 1)² heights, row by row, null where there is
    no node. Of nodes that repeat the largest counts."""
    n = size + 1
    own = nodes.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("h").cast("double").alias("h"))
    if round_:
        own = own.withColumn("ix", F.pmod("ix", F.lit(round_)))
        # the first columns stand behind the last one as well
        own = own.unionByName(own.where("ix = 0").withColumn("ix", F.lit(round_).cast("long")))
    home = lambda c: F.floor(F.col(c) / size)
    # a node on a tile's lower edge is the upper edge of the tile before
    sides = lambda c: F.explode(F.when(F.pmod(F.col(c), F.lit(size)) == 0, F.array(home(c), home(c) - 1)).otherwise(F.array(home(c))))
    t = own.withColumn("tx", sides("ix")).withColumn("ty", sides("iy"))
    place = (F.col("iy") - F.col("ty") * size) * n + F.col("ix") - F.col("tx") * size
    m = t.groupBy("tx", "ty", place.cast("int").alias("k")).agg(F.max("h").alias("h")).groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("k", "h"))).alias("m"))
    return m.select("tx", "ty", F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.try_element_at("m", k)).alias("h"))


def heights_at(points: DataFrame, tiles: DataFrame, lon0: float, lat0: float, step: float, size: int = SIZE, round_: int | None = None, name: str = "height") -> DataFrame:
    """`points` (lon, lat) with the bilinear height of the four nodes around. Null where one that counts is
    missing, or the point has no place; a point on a node or an edge needs only what it stands on."""
    n = size + 1
    x = (F.col("lon") - lon0) / step
    x = x - F.floor(x / round_) * round_ if round_ else x
    y = (F.col("lat") - lat0) / step
    p = points.withColumns({"__x": x, "__y": y}).withColumns({"__tx": F.floor(F.floor("__x") / size), "__ty": F.floor(F.floor("__y") / size)})
    t = tiles.select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), F.col("h").alias("__h"))
    j = p.join(t, ["__tx", "__ty"], "left")
    col, row = F.floor("__x") - F.col("__tx") * size, F.floor("__y") - F.col("__ty") * size
    fx, fy = F.col("__x") - F.floor("__x"), F.col("__y") - F.floor("__y")

    def node(i: int, k: int) -> Column:
        weight = (fx if i else 1 - fx) * (fy if k else 1 - fy)
        return F.when(weight == 0, 0.0).otherwise(weight * F.get("__h", ((row + k) * n + col + i).cast("int")))

    return j.withColumn(name, node(0, 0) + node(1, 0) + node(0, 1) + node(1, 1)).select(*points.columns, name)


def ellipsoidal(points: DataFrame, geoid: DataFrame, lon0: float, lat0: float, step: float, size: int = SIZE, round_: int | None = None) -> DataFrame:
    """`points` (lon, lat, alt above the geoid) with `ellipsoid`, the height above the ellipsoid; `geoid`: the tiles of
    the geoid's heights. A null altitude stays one."""
    p = heights_at(points, geoid, lon0, lat0, step, size, round_, "__n")
    return p.withColumn("ellipsoid", F.col("alt") + F.col("__n")).drop("__n")
