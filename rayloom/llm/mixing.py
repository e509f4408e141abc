"""Mixing sources to target weights by capped water-filling.

Targets: the total is shared out by weight; a source whose share is above `cap` times its size
is clamped there and its excess goes to the others by weight, until none is above. With sources
in order of size / weight the clamped ones come first, so the final level is found in one pass
of running sums over the (few) sources: no loop, no driver.

Taking: every document of a source with target / size = r is taken floor(r) times whole, and
once more with the fraction that is left. Which documents get the additional repetition is a
systematic sample in the order of document size: within a source, the i-th document (sizes
ascending, ties in the order of a seeded hash) is drawn where floor(f * (i + 1) + u) exceeds
floor(f * i + u), u being the source's seeded offset. The share of the words is then within one
document's size of the target, and reruns agree. The order is found without a global sort: rows
of equal (source, size, salt, first letters of the draw) are counted first, and the running sums of
these counts are taken over ranges of all of them, so that no task holds a source; rows are then
ranked inside their own group, of which a source with one size alone has 65,536.

A column `mix` of the input gives way to the result's.

Defined results: a null or empty text has size 0 and is taken as 0 words; a null source is the
last source, one of its own; sources of size 0 have target 0; repeated rows are separate
documents, drawn separately only by their number. Empty input gives no rows. A text of any length
counts whole; one that is longer than its source's target is taken or left as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import running, words

WEIGHTS, CAP, SEED, SALTS = (5, 2, 1), 3, "mix-1", 256


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with `weight` and `target`; one row a source.

    The total is the sum of all sizes. `weights` repeat over the sources in code point order,
    null last.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("total", F.sum("source_size").over(everything))
    # in the order in which they reach their cap; what stands before is clamped
    reach = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = reach.rowsBetween(W.unboundedPreceding, -1), reach.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    # the first free level holds for all that are not clamped
    level = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("i"), F.col("source").alias("s"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.coalesce(level, F.lit(float("inf"))), cap * F.col("source_size").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(df: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """`df` with the struct column `mix`: size, source_size, weight, target, times, taken."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))  # never null: the join and the ranks share one exchange
    d = df.withColumns({"__name": name, "__size": size, "__draw": draw}).withColumns({"__salt": F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long") % salts})
    # ranks follow the draw's letters inside a salt, so its first two cut the groups without changing the order
    d = d.withColumn("__sub", F.substring("__draw", 1, 2))
    group = ["__name", "__size", "__salt", "__sub"]
    groups = d.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = groups.groupBy("__name").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("__name") != "n", F.expr("substring(__name, 2)")))
    t = targets(sizes, weights, cap).withColumn("__name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    placed = running(groups, group, "n", "before")
    start = placed.groupBy("__name").agg(F.min("before").alias("start"))
    # the rows of one source meet their target sixteen ways
    slots = F.explode(F.array(*[F.lit(f"{k:x}") for k in range(16)])).alias("__slot")
    sources = t.join(start, "__name").select("*", slots)
    plan = placed.withColumn("__slot", F.substring("__sub", 1, 1)).join(sources, ["__name", "__slot"]).withColumn("first", F.col("before") - F.col("start"))
    plan = plan.select(*group, *[F.col(c).alias(f"__p_{c}") for c in ("first", "source_size", "weight", "target")])
    own = d.join(plan, group)
    inside = F.row_number().over(W.partitionBy(*group).orderBy("__draw", key)) - 1
    own = own.withColumn("__i", F.col("__p_first") + inside)
    r = F.coalesce(F.try_divide(F.col("__p_target"), F.col("__p_source_size").cast("double")), F.lit(0.0))
    whole, part = F.floor(r), r - F.floor(r)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))), 1, 8), 16, 10).cast("double") / float(2**32)
    extra = F.floor(part * (F.col("__i") + 1) + u) - F.floor(part * F.col("__i") + u)
    own = own.withColumn("__times", (whole + extra).cast("long"))
    return own.select(
        *[c for c in df.columns if c != "mix"],
        F.struct(F.col("__size").alias("size"), *[F.col(f"__p_{c}").alias(c) for c in ("source_size", "weight", "target")], F.col("__times").alias("times"), (F.col("__times") * F.col("__size")).alias("taken")).alias("mix"),
    )


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says; rows with 0 go."""
    return df.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("__copy")
