"""Polygons as points (group, i, x, y) in ring order, or as arrays of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels


def areas(points: DataFrame, by: str) -> DataFrame:
    """Shoelace area of the ring of each group, closed from its last point to its first."""
    w = W.partitionBy(by).orderBy("i")
    p = points.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(w)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(w))})
    return p.groupBy(by).agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"))


def hulls(points: DataFrame, by: str, most: int = 50_000) -> DataFrame:
    """(group, i, x, y): convex hulls. A hull of partial hulls is the hull, so groups are cut by a
    hash first into parts of about `most` points, and no task holds a whole group's points."""
    schema = f"{by} {points.schema[by].dataType.simpleString()}, i int, x double, y double"

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = kernels.hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pdf[by].iloc[0], "i": np.arange(len(ring), dtype=np.int32), "x": ring[:, 0], "y": ring[:, 1]})

    own = points.where("x IS NOT NULL AND y IS NOT NULL").select(by, "x", "y")
    per = own.groupBy(by).agg(F.ceil(F.count("*") / most).alias("parts"))
    part = own.join(per, by).select(by, "x", "y", F.pmod(F.xxhash64("x", "y"), "parts").alias("salt"))
    part = part.groupBy(by, "salt").applyInPandas(hull, schema)
    return part.select(by, "x", "y").groupBy(by).applyInPandas(hull, schema)


def overlap(pairs: DataFrame) -> DataFrame:
    """Pairs with `footprint_i`, `footprint_j` (arrays of points, convex) and `overlap`: the area
    that both cover over that of i."""

    def share(parts):
        for pdf in parts:
            out = []
            for a, b in zip(pdf["footprint_i"], pdf["footprint_j"], strict=True):
                a, b = (kernels.hull(np.array([(p["x"], p["y"]) for p in r], dtype=float)) for r in (a, b))
                out.append(kernels.area(kernels.clip(a, b)) / max(kernels.area(a), 1e-300))
            yield pdf[["cam_i", "cam_j"]].assign(overlap=out)

    return pairs.mapInPandas(share, "cam_i long, cam_j long, overlap double")
