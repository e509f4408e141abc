"""A small made scene, for the geometry queries: two cameras over one area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import FIELDS
from ..session import table

BASE = {"lon_off": 10.0, "lat_off": 45.0, "alt_off": 300.0, "lon_scale": 0.05, "lat_scale": 0.05, "alt_scale": 500.0, "col_off": 2000.0, "row_off": 2000.0, "col_scale": 2000.0, "row_scale": 2000.0}
TILTS = ((0.25, 0.05), (-0.25, 0.1))


def _padded(*v: float) -> list[float]:
    return [*v, *[0.0] * (20 - len(v))]


def models(spark: SparkSession) -> DataFrame:
    rows = [
        BASE | {"cam_id": k, "col_num": _padded(0.01, 1.0, 0.02, a, 0.001), "col_den": _padded(1.0, 0.001, 0.0005, 0.0002), "row_num": _padded(-0.02, 0.03, -1.0, b, 0.0, 0.001), "row_den": _padded(1.0, 0.0003, -0.001, 0.0001)}
        for k, (a, b) in enumerate(TILTS)
    ]
    schema = "cam_id long, " + ", ".join(f"{f} {'array<double>' if f.endswith(('num', 'den')) else 'double'}" for f in FIELDS)
    return spark.createDataFrame([tuple(r[c] for c in ("cam_id", *FIELDS)) for r in rows], schema)


def ground(spark: SparkSession, d: str) -> DataFrame:
    """(id, lon, lat, alt): a point of the area for each customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (10 + (k % 61 - 30) / 1000).alias("lon"), (45 + (k % 53 - 26) / 1000).alias("lat"), (k % 200 + 200).cast("double").alias("alt"))


#: The same in SQL.
GROUND = "SELECT c_custkey id, round(10 + (c_custkey % 61 - 30) / 1000, 6) lon, round(45 + (c_custkey % 53 - 26) / 1000, 6) lat, CAST(c_custkey % 200 + 200 AS DOUBLE) alt FROM customer"
