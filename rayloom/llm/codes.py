"""Product codes of vectors with integer codebooks.

Each component x becomes floor(4096 * x); a vector is cut into equal parts, and each part position has
a codebook. The codebooks start as the parts of the vectors with the smallest ids. In a
round, Arrow batches assign every part to its nearest entry: all distances come from the expansion
|v|^2 - 2 v.c + |c|^2 in exact 64-bit integers (one matrix product a part position), and the first minimum
wins. The batches' sums and counts of each entry are merged by a grouped shuffle, a row for each part,
entry and position; an entry becomes the floor of its mean, and one without parts stays.

Only codebooks (parts x entries x positions) pass through the driver and are broadcast: their size
is a parameter, whatever the number of vectors. Vectors are read again in each round; the codes of
the last one are a written table. Sums over labels are joined back in two ways: labels that hold more
than 1 / `MANY` of all rows are fewer than `MANY`, so their totals are broadcast; no other label is large.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are
dropped, and so are vectors of another length than that of the smallest id (ids in order, null last,
equal ids by their vectors), or all of them where that length is no multiple of the parts. With fewer vectors
than entries the codebooks have as many entries as vectors. Components are exact up to `MOST`
(floor(4096 * x) beyond it is taken as the nearest of `MOST`, -`MOST`); errors that pass 2^63 - 1
stop there. Rows that repeat are separate vectors. Empty input gives no rows. Columns to keep are named by the
caller; columns called `code` or `error` are left out for the operator's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tidy

SCALE, PARTS, ENTRIES, ROUNDS, MANY = 4096, 8, 16, 6, 1000
#: With components below SAFE all distances and a batch's sums stay in 64 bits; others are Python's integers.
SAFE, MOST, TOP = 1 << 24, 10**24, (1 << 63) - 1


def whole(vector: Column) -> Column:
    """The vector is not null, not empty, and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all are small, else as Python's."""
    y = np.floor(np.asarray(x, np.float64) * scale)  # a power of two: no rounding
    if y.size == 0 or np.abs(y).max() < SAFE:
        return y.astype(np.int64)
    return np.array([max(-MOST, min(MOST, int(v) if math.isfinite(v) else (MOST if v > 0 else -MOST))) for v in y.ravel()], object).reshape(y.shape)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: vectors x parts x positions; books: parts x entries x positions. The first nearest entry
    of each part, and its squared distance."""
    if books.dtype == object:
        x = x.astype(object)
    elif x.dtype == object:
        books = books.astype(object)
    code = np.zeros(x.shape[:2], np.int64)
    least = np.zeros(x.shape[:2], x.dtype)
    for p, book in enumerate(books):
        v = x[:, p]
        d = (book * book).sum(axis=1) - 2 * (v @ book.T)
        code[:, p] = d.argmin(axis=1)
        least[:, p] = (v * v).sum(axis=1) + np.take_along_axis(d, code[:, p : p + 1], axis=1)[:, 0]
    return code, least


def _read(column: pa.Array, parts: int) -> np.ndarray:
    return integers(np.asarray(column.flatten(), np.float64)).reshape(len(column), parts, -1)


def sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place) -> total and n over all vectors; `n` rows stand at place 0 as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                x = _read(batch.column(0).slice(lo, 2000), books.shape[0])
                code, _ = nearest(x, books)
                for p in range(books.shape[0]):
                    n[p] += np.bincount(code[:, p], minlength=books.shape[1])
                    own = np.zeros(books.shape[1:], x.dtype)
                    np.add.at(own, code[:, p], x[:, p])
                    total[p] += own
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, books.shape))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(a.astype(np.int32)) for a in (part, entry, place)), pa.array([str(v) for v in total[part, entry, place]], pa.string()), pa.array(n[part, entry])],
            names=["part", "entry", "place", "total", "n"],
        )

    found = vectors.select("__vector").mapInArrow(tidy(run), "part int, entry int, place int, total string, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def train(df: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray | None, int]:
    """(codebooks, length of the vectors); no codebooks where no vector is left."""
    usable = df.where(whole(F.col(vector))).select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector"))
    order = [F.col("__key").asc_nulls_last(), F.col("__vector")]
    first = usable.orderBy(*order).limit(1).collect()
    size = len(first[0]["__vector"]) if first else 0
    if not size or size % parts:
        return None, size
    usable = usable.where(F.size("__vector") == size)
    start = [r["__vector"] for r in usable.orderBy(*order).limit(entries).collect()]
    books = integers(np.array(start)).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = books.astype(object)
        for r in sums(usable, narrow(books)).collect():  # parts x entries x positions at most
            books[r.part, r.entry, r.place] = int(r.total) // r.n
        books = narrow(books)
    return books, size


def narrow(books: np.ndarray) -> np.ndarray:
    """64-bit integers where all are small."""
    return books.astype(np.int64) if all(abs(v) < SAFE for v in books.ravel().tolist()) else books.astype(object)


def assign(df: DataFrame, vector: str, books: np.ndarray, size: int, keep: list[str]) -> DataFrame:
    """`keep`, with `code` (binary, a byte a part; `books` has 256 entries at most) and `error` (long)."""
    keep = [c for c in keep if c not in ("code", "error")]
    at, parts = len(keep), len(books)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                code, least = nearest(_read(b.column(at), parts), books)
                error = [min(TOP, int(v)) for v in least.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(error, pa.int64())], names=schema.names)

    rows = df.where(whole(F.col(vector))).where(F.size(vector) == size)
    return rows.select(*keep, F.col(vector).cast("array<double>").alias("__vector")).mapInArrow(tidy(run), schema)


def label_totals(coded: DataFrame, label: str, many: int = MANY) -> DataFrame:
    """`coded` (a written table) with `label_error`, the sum of its label's errors."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("long").alias("label_error")
    totals = cut(coded.groupBy(F.col(label).alias("__label")).agg(total, F.count("*").alias("__n")), "labels")
    n = totals.agg(F.sum("__n")).first()[0] or 0
    large = F.col("__n") * many > n
    met = F.col(label).eqNullSafe(F.col("__label"))
    hot = coded.join(F.broadcast(totals.where(large)), met, "left")  # fewer than `many` labels
    rest = hot.where(F.col("__n").isNull()).select(*coded.columns).join(totals.where(~large), met)
    return hot.where(F.col("__n").isNotNull()).unionByName(rest).drop("__label", "__n")


def digest(books: np.ndarray) -> str:
    """All components by part, entry, position, as decimals between commas; its sha256."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, label, code (binary), error, label_error, codebooks_sha256."""
    books, size = train(df, key, vector, parts, entries, rounds)
    if books is None:
        none = df.select(key, label).where(F.lit(False))
        return reduce(lambda d, c: d.withColumn(c[0], F.lit(None).cast(c[1])), [("code", "binary"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string")], none)
    coded = cut(assign(df, vector, books, size, [key, label]), "codes")
    return label_totals(coded, label).withColumn("codebooks_sha256", F.lit(digest(books)))
