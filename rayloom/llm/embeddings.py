"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. A rotation is learnt on a bounded sample (`FIT_ROWS` vectors): principal directions, then
   alternating between signs and the orthogonal matrix nearest to them, so that the bits of the
   codes are balanced. Every vector is indexed.
2. Equal vectors are one vector with a weight. Vectors with the same code make a class, and
   classes are cut into cells of about `CELL` vectors.
3. The bits are cut into tables of about log2(classes) bits. Two codes at a Hamming distance of
   `REACH` or less differ in REACH // tables bits or less of some table, so that many flips,
   shared out between the values a class is stored under and those it looks up, bring all such
   codes together, however many tables there are. Of the codes found, those farther apart than
   `RADIUS` bits go.
4. Cells of a class, and cells of two classes that were found, meet in one task, which reranks
   with the original vectors by blocks: it returns for each vector the weight that it links
   with and the smallest vector of its part of the link graph, never the pairs.

Links are exact (cosine >= `least` in double precision); what may be missed are links between
codes that no table brings together. The test against brute force measures that.

Defined results: a vector that is null, empty, zero, of another length than most, or holds null
or non-finite components links with nothing and is its own component. Rows with a null id count
as links but name no component. Rows that repeat are linked vectors. Empty input gives no rows.
Only the key and the vector are read, so other columns and their names are no matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

LEAST, FIT_ROWS, BITS, ROUNDS, RADIUS, CELL = 0.95, 10_000, 64, 50, 16, 256
#: All codes up to this distance are found; it holds 0.998 of made pairs at cosine 0.95 exactly.
REACH = 11


def fit(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors: a code bit is the sign of a column of (x - mean) @ projection."""
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    main = vectors[:, np.argsort(-values)[: min(bits, x.shape[1])]]
    v = (x - mean) @ main
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(main.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, main @ r


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    top = np.abs(x).max(axis=1, keepdims=True)  # first, so that no square leaves the range
    x = x / np.where(top > 0, top, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(reps: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`reps` (row, w, v) with the bits of each code as a long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = model
        for b in parts:
            if b.num_rows:
                bits = (_matrix(b.column(2)) - mean) @ projection > 0
                code = (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=["row", "w", "v", "code"])

    return reps.mapInArrow(run, reps.select("row", "w", "v", F.lit(0).cast("long").alias("code")).schema)


def neighbours(classes: DataFrame, bits: int, n: int) -> DataFrame:
    """Pairs (a, b) of different codes that share a table's value up to REACH // tables flips."""
    tables = min(bits, max(2, round(bits / math.log2(max(n, 4)))))
    edges = [bits * i // tables for i in range(tables + 1)]
    part = lambda lo, hi: F.shiftrightunsigned("code", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else F.col("code")
    cuts = list(zip(edges, edges[1:], strict=False))

    def near(most: int):
        """A row for each table and each value up to `most` flips from the code's own."""

        def values(t: int, lo: int, hi: int):
            flips = [sum(1 << i for i in some) for k in range(most + 1) for some in combinations(range(hi - lo), k)]
            masks = F.from_json(F.lit(str(flips)), "array<long>")  # one literal, folded when planned
            return F.transform(masks, lambda f: F.struct(F.lit(t).alias("t"), part(lo, hi).bitwiseXOR(f).alias("key")))

        return F.explode(F.concat(*[values(t, lo, hi) for t, (lo, hi) in enumerate(cuts)]))

    flips = max(1, REACH // tables)
    stored = classes.select(F.col("code").alias("a"), near(flips // 2).alias("k")).select("a", "k.t", "k.key")
    asked = classes.select(F.col("code").alias("b"), near(flips - flips // 2).alias("k")).select("b", "k.t", "k.key")
    met = stored.join(asked, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    return met.select("a", "b").distinct()


def rerank(cells: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(row, n, low): for each vector of a pair of cells the weight it links with there, and the
    smallest vector that links inside these two cells reach."""
    member = cells.select("code", "cell", "row", "w", "v")
    sides = pairs.select("a", "ca", "b", "cb", F.explode(F.when((F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumns({"code": F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")), "cell": F.when(F.col("side") == 0, F.col("ca")).otherwise(F.col("cb"))})
    rows = sides.join(member, ["code", "cell"]).select("a", "ca", "b", "cb", "side", "row", "w", "v")
    rows = rows.repartition("a", "ca", "b", "cb").sortWithinPartitions("a", "ca", "b", "cb", "side", "row")

    def meet(own: bool, x: np.ndarray, xi: np.ndarray, xw: np.ndarray, y: np.ndarray, yi: np.ndarray, yw: np.ndarray):
        linked = x @ y.T >= least
        if own:
            np.fill_diagonal(linked, False)
        n = np.r_[linked @ yw] if own else np.r_[linked @ yw, linked.T @ xw]
        low = xi.copy() if own else np.r_[xi, yi]
        far = np.iinfo(np.int64).max
        while len(low):
            left, right = (low, low) if own else (low[: len(x)], low[len(x) :])
            up = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1, initial=far))
            new = up if own else np.r_[up, np.minimum(right, np.where(linked, up[:, None], far).min(axis=0, initial=far))]
            if (new == low).all():
                break
            low = new
        rows = xi if own else np.r_[xi, yi]
        return pa.RecordBatch.from_arrays([pa.array(rows[n > 0]), pa.array(n[n > 0].astype(np.int64)), pa.array(low[n > 0])], names=["row", "n", "low"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def flush():
            left, right = (tuple(np.concatenate(z) for z in zip(*h, strict=True)) if h else None for h in held)
            same = at[:2] == at[2:]
            if left and (right or same):
                yield meet(same, *left, *(left if same else right))

        for b in parts:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(i)) for i in range(5)], axis=1)
            rows, w, x = np.asarray(b.column(5)), np.asarray(b.column(6)), _matrix(b.column(7))
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for lo, hi in zip(heads, [*heads[1:], len(key)], strict=True):
                pair, side = tuple(key[lo, :4].tolist()), int(key[lo, 4])
                if pair != at:
                    if at is not None:
                        yield from flush()
                    at, held = pair, ([], [])
                held[side].append((x[lo:hi], rows[lo:hi], w[lo:hi]))
        if at is not None:
            yield from flush()

    return rows.mapInArrow(run, "row long, n long, low long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """A row for each row of `df`: key, n_links, component (smallest key that links reach), first."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = df.select(F.col(key).cast("long").alias("key"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    own = cut(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    most = own.where("usable").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return own.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("first"))
    good = own.where(F.col("usable") & (F.size("v") == most["d"]))
    reps = good.groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("w")).select("row", "w", "v")
    share = min(1.0, 1.2 * FIT_ROWS / most["n"])
    sample = good.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(FIT_ROWS).select("v").toArrow()
    model = fit(_matrix(sample.column(0).combine_chunks()))
    coded = codes(reps, model)
    per = coded.groupBy("code").agg(F.count("*").alias("n"))
    coded = cut(coded.join(per, "code").withColumn("cells", F.ceil(F.col("n") / CELL)).withColumn("cell", F.pmod(F.xxhash64("row"), "cells")).drop("n"), "codes")
    cells = coded.select("code", "cell").distinct()
    classes = coded.select("code").distinct()
    found = neighbours(classes, model[1].shape[1], classes.count())
    within = cells.select(F.col("code").alias("a"), F.col("cell").alias("ca")).join(cells.select(F.col("code").alias("b"), F.col("cell").alias("cb")), F.col("a") == F.col("b")).where("ca <= cb")
    across = found.join(cells.select(F.col("code").alias("a"), F.col("cell").alias("ca")), "a").join(cells.select(F.col("code").alias("b"), F.col("cell").alias("cb")), "b")
    met = cut(rerank(coded, within.select("a", "ca", "b", "cb").unionByName(across.select("a", "ca", "b", "cb")), least), "links")
    links = met.groupBy("row").agg(F.sum("n").alias("n"))
    labels = components(met.select(F.col("row").alias("a"), F.col("low").alias("b")))
    member = own.join(reps.select(F.col("row").alias("rep"), "w", F.col("v").alias("rv")), (F.col("v") == F.col("rv")) & (F.size("v") == most["d"]) & F.col("usable"), "left").select("row", "key", "rep", "w")
    member = member.join(links.withColumnRenamed("row", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("row", "key", (F.coalesce("n", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep", "row").alias("c"))
    named = member.groupBy("c").agg(F.min("key").alias("component"), F.min(F.struct(F.col("key").isNull().alias("i"), "key", "row")).alias("f")).select("c", "component", F.col("f.row").alias("f"))
    return member.join(named, "c").select("key", "n_links", "component", (F.col("row") == F.col("f")).alias("first"))
