"""Order over whole tables without one task for all: rows are ranged over partitions, summed or counted
there, and numbered behind the partitions before theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """`df` with the column `name`: the sum of `value` over all rows that stand before in `order`.

    Only one sum a partition is put in order as a whole, so neither a task nor a group holds all rows,
    however they are spread over the keys.
    """
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")  # the ranges come from a sample; both uses below must see the same ones
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # one row a shuffle partition
    return out.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__before", "__own")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """`rank` from 1 over all rows in the given order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__p": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = kept(ranged, "ranges")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__p").withColumn("rank", F.col("__before") + F.col("__i") + 1).drop("__id", "__p", "__i", "__n", "__before")


def placed(df: DataFrame, by: str, value: str) -> DataFrame:
    """`df` with its place `i` (from 0) among the values of its group, and the group's `n`, `lo` and `hi`;
    rows without a value go. A group of any size is ranged over partitions like all others."""
    r = ranked(df.where(F.col(value).isNotNull() & ~F.isnan(value)), [F.col(by), F.col(value)])
    g = r.groupBy(F.col(by).alias("__by")).agg(F.min("rank").alias("__first"), F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return r.join(g, r[by].eqNullSafe(g["__by"])).withColumn("i", F.col("rank") - F.col("__first")).drop("__by", "__first", "rank")


def quantile(p: float, value: str) -> Column:
    """The p-quantile as an aggregate over rows of `placed`, between its two neighbours in proportion."""
    at = F.lit(float(p)) * (F.col("n") - 1)
    low, high = (F.max(F.when(F.col("i") == f(at), F.col(value))) for f in (F.floor, F.ceil))
    return low + (high - low) * F.max(at - F.floor(at))
