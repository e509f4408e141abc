"""Importance resampling of documents towards a target distribution.

Features are runs of one to two words, hashed into buckets. Arrow batches count the buckets of
all documents and of all target texts; the counts of tasks are merged by a grouped shuffle. A bucket's
gain is the log ratio of its smoothed shares, an integer; the gains stand in one array of
`BUCKETS` numbers, which goes to every task, and a document's weight is the floored mean of the
gains of its features. A seeded draw for each document id (Gumbel noise) is added to it: the highest
scores of all are a sample without replacement in proportion to the weights.

The highest scores are found without a sort of all rows: scores are integers, whose possible number is
bounded by the logarithms of counts (about 120,000 values), so an exact histogram of them is small. Its counts
summed from the top give each score's first rank, and the score at which the sample is full. Only rows at
that score or above are ranked, inside their own score, by id.

Defined results: a null or empty text has no features, weight 0, and counts for no bucket. A null id
draws as the text `null` and stands last among equal scores. Rows that repeat are separate documents; their order
among each other is any. An empty table gives no rows; an empty target counts nothing. Texts are taken
whole. Only the id of a row is kept, so clashing names are no matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, tidy

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, "7"
#: Letters of A-Z to lower case; any other ASCII character that is no digit or letter parts words.
_TO = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TO).split()


def features(text: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all single words, then of all pairs of neighbours."""
    n = len(text)
    one = list(map(zlib.crc32, text))
    two = map(zlib.crc32, text[1:], map(zlib.crc32, repeat(b" ", max(0, n - 1)), one))
    return np.r_[np.array(one, np.int64), np.fromiter(two, np.int64, max(0, n - 1))] % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The texts one by one as bytes; null is empty."""
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for raw in _texts(batch.column(0).slice(lo, 500)):
                    n += np.bincount(features(words(raw), buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    found = df.select(F.col(text).cast("string").alias("__text")).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, a bucket each."""
    s, t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((y + 1) * (s + b)) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key -> (n_words, n_features, weight)."""
    schema = "key {}, n_words long, n_features long, weight long".format(df.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                for raw in _texts(part.column(1)):
                    w = words(raw)
                    f = features(w, len(gain))
                    rows.append((len(w), len(f), int(gain[f].sum()) // len(f) if len(f) else 0))
                cols = np.array(rows, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=["key", "n_words", "n_features", "weight"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u by the first 32 bits of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(scored: DataFrame, able: Column, percent: int = PERCENT) -> DataFrame:
    """`scored` (a written table with key and score) with `rank` from 1 for the highest scores among the
    rows that are `able`, `percent` of a hundred of them; null for all others."""
    histogram = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()  # bounded: see above
    histogram.sort(key=lambda r: -r.score)
    n = np.array([r.n for r in histogram], np.int64)
    want = percent * int(n.sum()) // 100
    above = np.cumsum(n) - n
    held = int(np.searchsorted(above, want))  # scores with fewer than `want` rows above them
    spark = scored.sparkSession
    if not held:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    table = pa.table({"score": pa.array([r.score for r in histogram[:held]], pa.int64()), "__above": pa.array(above[:held])})
    last = histogram[held - 1].score
    in_score = W.partitionBy("score").orderBy(F.col("key").asc_nulls_last())
    high = scored.where(able & (F.col("score") >= last)).withColumn("__nth", F.row_number().over(in_score))
    high = high.join(F.broadcast(spark.createDataFrame(table)), "score").withColumn("rank", (F.col("__above") + F.col("__nth")).cast("long"))
    high = high.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank"))).select(*scored.columns, "rank")
    rest = scored.where(~(able & (F.col("score") >= last))).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score, rank; a row for each document."""
    gain = gains(counts(docs, text, buckets), counts(target, text, buckets))
    scored = weigh(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    return draw(cut(scored, "scored"), F.col("n_words") >= min_words, percent)
