"""Sharding by a two-pass external shuffle of whole records, in DataFrame functions only.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of the
whole record, so that a key with a third of all rows spreads like any other; Spark's exchange is
the external file of this pass. Pass 2 takes each bucket as one task's array, Fisher-Yates-shuffles
it (Spark's own seeded `shuffle`), lays it behind the buckets before it and writes it to its
shards. Row number `g` of the `n` rows goes to shard floor(g * shards / n): shards are runs of
shuffled buckets, and their counts differ by one at most (law `rows`).

The number of buckets follows rows and bytes, so a bucket has about `bucket_rows` rows or
`bucket_bytes` bytes at most, at any size. Where a task has many buckets, Spark's aggregation holds 128 arrays
(half a gigabyte) at most before it sorts what is left by bucket and takes one after the other. Records that are equal in all columns share a bucket;
where they make it more than twice too large it is cut into parts by place (after the records were
written once, so that both uses see the same parts). Where a record goes depends on nothing but
the records, not on how files are split. Each array is sorted by the seeded hash before it is
shuffled, the arrays of a partition stand in order of their bucket, and no exchange follows, so a
task that is run again after the loss of an executor makes the same order. The offsets are one
number for a bucket.

Defined results: null keys and null texts are rows like any other (size 16, crc 0); repeated
rows get a place each; an empty table gives no rows; a record longer than a bucket is a bucket of
its own or shares one; other columns ride along in the record, but for input columns named
`shard` or `slot`, which the result's own replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running, scratch

SHARDS, SEED, BUCKET_ROWS, BUCKET_BYTES, PARTS, TOGETHER, MOST_TASKS = 40, 20240, 2_500, 1 << 22, 1 << 20, 8, 20_000


def byte_size(text: Column) -> Column:
    """The contract's size of a row: UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def external_shuffle(df: DataFrame, size: Column | None = None, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of `df` with `shard` (int) and `slot` (long, gapless from 0 in each shard); `size` is a
    row's bytes, 0 where it is not given."""
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    size = F.lit(0) if size is None else size
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil(total / bucket_bytes))
    rows = df.select(F.struct(F.xxhash64(F.lit(seed), *cols).alias("draw"), F.struct(*cols).alias("row")).alias("rec"), size.cast("long").alias("size"))
    # one key of bucket and part, so that the exchange below serves the join too
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("rec.draw")), F.lit(buckets)) * PARTS)
    tally = lambda r: cut(r.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "buckets")
    counts = tally(rows)
    parts = F.ceil(F.greatest(F.col("n") / (2 * bucket_rows), F.col("bytes") / (2 * bucket_bytes)))
    crowded = counts.select("bucket", F.least(parts, F.lit(PARTS)).alias("parts")).where("parts > 1")
    if not crowded.isEmpty():
        place = F.pmod(F.xxhash64(F.lit(seed + 2), F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
        rows = cut(rows.join(crowded, "bucket", "left").withColumn("bucket", F.col("bucket") + place).drop("parts"), "scatter")
        counts = tally(rows)
    offsets = running(counts, ["bucket"], "n", "before").select(F.col("bucket").alias("b"), "before")
    # Spark gathers at most 128 arrays at once and goes on by sorting, so a task may have any number of buckets
    rows = rows.repartition(min(math.ceil(buckets / TOGETHER), MOST_TASKS), "bucket")
    dealt = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("rec"), lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).otherwise(0)).alias("recs"))
    # both sides are dealt by bucket already; the merge join leaves the buckets in order
    ordered = dealt.join(offsets.hint("merge"), dealt["bucket"] == offsets["b"])
    mixed = ordered.select("before", F.posexplode(F.shuffle("recs", F.lit(seed))).alias("i", "rec"))
    placed = mixed.withColumn("g", F.col("before") + F.col("i"))
    placed = placed.withColumn("shard", F.expr(f"(g * {shards}) div {max(n, 1)}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {max(n, 1)} + {shards - 1}) div {shards}")
    return placed.select(*[F.col("rec.row")[c].alias(c) for c in cols], "shard", (F.col("g") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The whole records, shuffled, in one folder a shard below `path`; the table as it is read back."""
    out = external_shuffle(docs, byte_size(F.col(text)), shards, seed, bucket_rows, bucket_bytes)
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)


def shard_documents(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Writes the documents to shards and reads from these where each one went: doc_id, size,
    text_crc32, law, shard, slot, grown_shard."""
    out = write_shards(docs, path or scratch(docs.sparkSession, "shards"), shards=shards, seed=seed)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
