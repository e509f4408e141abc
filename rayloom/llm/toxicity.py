"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between them, in
lower case, hashed into 2^`bits` places. Each place has its own learning rate, and the L1 term
leaves most weights at exactly zero, so the model is a short list of (place, weight) with a
size bound of 2^`bits` whatever the corpus, which is what is broadcast to score all texts.

Learning takes labelled rows only, never those of the held-out fold, and of these a seeded
sample of `sample` rows at most (a fixed parameter of the method, the same at every size; their
ids are broadcast, so that only their texts are looked at).
Features are made where the texts are; one task then runs FTRL over the sample's places for
`epochs` passes, leaving out one fold, on which a logistic curve sets slope and intercept, so
that 0.5 is where the odds are even. Scoring reads every whole text.

Defined results: null and empty texts have no features and score by the intercept alone; with
no labelled row of either class the score is 0.5. A doc_id that repeats among the documents is
learnt from once, by the text that comes first in order; columns named `score` or `__text` give way
to the operator's own. Scores depend on nothing but the text, which is taken whole at any length. Without
documents there are no scores, and without labels on them nothing is learnt.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SAMPLE, EPOCHS = 20, 16_000, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.5, 0.1
FOLDS = 5
CACHE_WORDS = 500_000
#: Odd multipliers that tell the kinds of features apart.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


class Features:
    """The hashed places of texts, remembering the hashes of words."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.clear()

    def clear(self) -> None:
        self.code, self.hashes = defaultdict(count().__next__), np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.code) > CACHE_WORDS:
            self.clear()
        see = self.code.__getitem__
        codes = [np.fromiter(map(see, (t or "").encode().lower().split()), np.int64) for t in texts]
        new = list(islice(self.code, len(self.hashes), None))
        h = np.fromiter(map(crc32, new), np.uint64, len(new)) * MIX[0] + np.fromiter(map(len, new), np.uint64, len(new))
        self.hashes = np.r_[self.hashes, (h ^ (h >> np.uint64(31))) * MIX[1]]
        out = []
        for c in codes:
            w = self.hashes[c]
            grams = np.concatenate([w * MIX[3], (w[:-1] * MIX[1] + w[1:]) * MIX[2], (w[:-2] * MIX[2] + w[2:] * MIX[1]) * MIX[0]])
            out.append(np.unique(grams >> self.shift).astype(np.int64))
        return out


def scale(n: int) -> float:
    """The value of each of a text's n places: between presence and share."""
    return (n + 1) ** -0.25


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """The weights after `epochs` passes over (places, label); the last one is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    draw = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            places, label = rows[k]
            i = np.append(places, size - 1)
            x = np.full(len(i), scale(len(places)))
            x[-1] = 1.0
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size))


def margin(w: np.ndarray, places: np.ndarray) -> float:
    return w[-1] + w[places].sum() * scale(len(places))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve a * z + b through labels, by damped Newton steps."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    m, s = z.mean(), z.std() + 1e-9
    x = np.c_[(z - m) / s, np.ones(len(z))]
    w = np.array([1.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - y) + np.array([1e-2, 0]) * w), -2, 2)
    return float(w[0] / s), float(w[1] - w[0] * m / s)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights learnt from the labelled rows outside the held-out fold, calibrated on one of the
    other folds: with (a, b) from there, a * (w . x) + b is again a linear score."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & (fold(F.col("k")) != 0))
    chosen = known.withColumn("draw", F.xxhash64(F.lit(11), F.col("k"))).orderBy("draw", "k", "y").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("draw", "k", "y").agg(F.min("t").alias("t"))  # an id that repeats is one row, so the sample's bound holds
    rows = rows.select("draw", F.col("k").cast("string").alias("id"), "t", "y")

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = Features(bits)
        for b in parts:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                found = pa.array([x.astype(np.int32) for x in see(c.column(2).to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), found, c.column(3)], names=["draw", "id", "places", "y"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in parts:
            at = b.column(2)
            got += [(d, i, np.asarray(at[k].values, dtype=np.int64), y) for k, (d, i, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True))]
        if not got:
            return
        got.sort(key=lambda r: (r[0], r[1], r[3], len(r[2])))
        held = [crc32(i.encode()) % FOLDS == 1 for _, i, _, _ in got]
        w = ftrl([(p, y) for (_, _, p, y), h in zip(got, held, strict=True) if not h], bits)
        rest = [(margin(w, p), y) for (_, _, p, y), h in zip(got, held, strict=True) if h]
        a, b = calibrate(*map(np.array, zip(*rest, strict=True))) if len(rest) >= 20 else (1.0, 0.0)
        if a <= 0:  # too little to go by
            a, b = 1.0, 0.0
        w = w * a
        w[-1] += b
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    seen = rows.mapInArrow(places, "draw long, id string, places array<int>, y int")
    model = seen.repartition(1).mapInArrow(learn, "place long, weight double").toPandas()  # `sample` rows in, 2^bits out at most
    w = np.zeros((1 << bits) + 1)
    w[model["place"].to_numpy()] = model["weight"].to_numpy()
    return w


def score(df: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """`keep` and `score`."""
    keep = [c for c in keep if c not in ("score", "__text")]
    at, names = len(keep), [*keep, "score"]
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = df.select(*keep, F.lit(0.0).alias("score")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see, w = Features(bits), model.value
        for b in parts:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                z = np.array([margin(w, p) for p in see(part.column(at).to_pylist())], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))], names=names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
