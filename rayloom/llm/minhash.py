"""MinHash near-dedup by an inverted join over signature coordinates.

1. Each text's set of word shingles gives a signature of `coords` minima. Texts with the same
   set (a 128-bit digest) are one class; only its first row goes on.
2. Every (coordinate, value) pair is a posting list. Two signatures that agree in at least
   `match` coordinates share one in any `coords - match + 1` coordinates of each that are taken
   in one common order; that order is from the shortest posting list to the longest. So a row
   is posted under that many of its rarest pairs (the prefix), long lists are skipped where
   short ones do, and pairs that nobody shares cost nothing after they are counted.
3. In each list the row with the smallest set is the pivot, and the others are held against it:
   collisions over the whole signatures are counted, pairs with `match` or more are confirmed on
   the full shingle sets of the whole texts. Confirmed links are joined into components.
4. What the pivots leave open is only pairs of rows of one list in different components. Rows
   that such lists connect make a family; its rows are cut into cells of neighbouring set sizes,
   and cells whose sizes can be similar enough meet in one task. There collisions are counted by
   array comparison, pairs of rows already in one component are skipped, the rest is confirmed on
   the full sets, and only each row's smallest linked row comes back: no pair is ever listed.

A pair at similarity 0.8 agrees in fewer than 38 of 64 coordinates with a probability of about
1e-4, and more similar pairs less often; nothing else is left to chance.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a
text with fewer words than a shingle is one shingle; rows with a null id are compared like any
other, but only ids name components (null where a component has no id); rows that repeat an id
are told apart by their text. Texts are taken whole at any length; an empty table gives no rows.
Only the key and the text are read, so other columns and their names are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, tidy
from .components import components

COORDS, MATCH, PERCENT = 64, 38, 80
CACHE_WORDS = 300_000
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_draw = np.random.default_rng(8)
FACTORS = _draw.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2)


class Shingles:
    """The sorted 64-bit hashes of a text's distinct shingles."""

    def __init__(self, length: int):
        self.length, self.words = length, WordHashes(CACHE_WORDS)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        # bytes: lower() knows the ASCII letters only
        return [self.combine(w) for w in self.words([(t or "").encode().lower() for t in texts])]

    def combine(self, w: np.ndarray) -> np.ndarray:
        k = min(self.length, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ (h >> np.uint64(29))) * _M[i % 3] + w[i : len(w) - k + 1 + i]
        h = (h ^ (h >> np.uint64(33))) * _M[3]
        return np.unique(h ^ (h >> np.uint64(29)))


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def minima(s: np.ndarray) -> np.ndarray:
    """The signature: each coordinate's minimum, its number in the lowest bits."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 2048):
        np.minimum(out, (FACTORS[:, None] * s[None, lo : lo + 2048] + TERMS[:, None]).min(axis=1), out=out)
    low = np.uint64(COORDS - 1)
    return ((out & ~low) | np.arange(COORDS, dtype=np.uint64)).view(np.int64)


def signatures(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """row, key, md5 (of the text), n (size of the set), same (digest), sig; row numbers are settled by a cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = Shingles(length)
        for b in parts:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                sets = see(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([md5((t or "").encode()).digest() for t in texts], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([minima(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["key", "md5", "n", "same", "sig"],
                )

    seen = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), "key long, md5 binary, n long, same binary, sig array<long>")
    return cut(seen.withColumn("row", F.monotonically_increasing_id()), "signatures")


def postings(reps: DataFrame) -> DataFrame:
    """(token, row, n): each row under the rarest of its coordinate-value pairs."""
    every = reps.select("row", "n", F.explode("sig").alias("token"))
    shared = every.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    mine = every.join(shared, "token").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))  # COORDS entries at most
    # pairs that no other row has come first and lead nowhere
    left = F.lit(COORDS - MATCH + 1) - (F.lit(COORDS) - F.size("t"))
    return mine.where(left > 0).select("row", "n", F.explode(F.slice("t", 1, left)).alias("t")).select(F.col("t.token").alias("token"), "row", "n")


def colliding(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole signatures agree in `MATCH` coordinates or more, with the
    ids and digests that find their texts."""
    side = lambda x: sigs.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("key", "same", "sig")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("sig_a", "sig_b")) >= MATCH).drop("sig_a", "sig_b")


def confirmed(pairs: DataFrame, df: DataFrame, key: str, text: str, length: int, percent: int, block: int = 400) -> DataFrame:
    """The pairs with 100 * |A and B| >= percent * |A or B| over the full sets of the texts.

    Blocks of at most about `block` partners of one row travel with one copy of its text.
    """
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    p = cut(pairs.join(per, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / block))).drop("n"), "pairs")
    ids = p.select(F.col("key_a").alias("k")).union(p.select("key_b")).distinct()
    texts = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    texts = texts.join(ids, texts["k"].eqNullSafe(ids["k"]), "left_semi")
    first = p.select("a", "block", F.lit(None).cast("long").alias("b"), F.col("key_a").alias("k2"), F.col("same_a").alias("same")).distinct()
    rest = p.select("a", "block", "b", F.col("key_b").alias("k2"), F.col("same_b").alias("same"))
    wanted = first.unionByName(rest)
    rows = wanted.join(texts, wanted["k2"].eqNullSafe(texts["k"])).select("a", "block", "b", "same", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see, at, own = Shingles(length), None, None
        for batch, lo in ((b, lo) for b in parts for lo in range(0, b.num_rows, 500)):
            found = []
            a_, block_, b_, same_, texts_ = (batch.column(i).slice(lo, 500).to_pylist() for i in range(5))
            for a, block, b, same, s in zip(a_, block_, b_, same_, see(texts_), strict=True):
                if digest(s) != same:
                    continue  # another text under the same id
                if b is None:
                    at, own = (a, block), s
                elif at == (a, block):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _meet(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """(row, smallest row of its part) for the rows (row, label, set) of one or two cells."""
    rows = left + (right or [])
    # 32 bits of each minimum; a number's lowest bits are its coordinate
    low = np.stack([(minima(s) >> 6).astype(np.uint32) for _, _, s in rows])
    size = np.array([len(s) for _, _, s in rows], np.int64)
    names: dict[int, int] = {}
    part = np.array([names.setdefault(label, len(names)) for _, label, _ in rows], np.int64)
    first, width = (0, len(left)) if right is None else (len(left), len(right))
    found = []
    for lo in range(0, len(left), 64):
        hi, other = min(lo + 64, len(left)), slice(first, first + width)
        n = np.zeros((hi - lo, width), np.uint8)
        for k in range(COORDS):
            n += low[lo:hi, k, None] == low[None, other, k]
        small, large = np.minimum(size[lo:hi, None], size[None, other]), np.maximum(size[lo:hi, None], size[None, other])
        ok = (n >= MATCH) & (part[lo:hi, None] != part[None, other]) & (100 * small >= percent * large)
        if right is None:
            ok &= np.arange(lo, hi)[:, None] < np.arange(width)[None, :]
        i, j = np.nonzero(ok)
        found.append(((i + lo).astype(np.int32), (j + first).astype(np.int32), n[i, j]))
    i, j, n = (np.concatenate(z) for z in zip(*found, strict=True))
    likely = np.argsort(COORDS - n, kind="stable")
    i, j = i[likely], j[likely]
    parent = list(range(len(names)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    done = 0
    while done < len(i):
        roots = np.array([root(a) for a in range(len(parent))], np.int64)[part]
        todo = np.flatnonzero(roots[i[done:]] != roots[j[done:]])[:5000] + done
        if not len(todo):
            break
        for k in todo.tolist():
            a, b = root(part[i[k]]), root(part[j[k]])
            if a != b:
                s, t = rows[i[k]][2], rows[j[k]][2]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    parent[max(a, b)] = min(a, b)
        done = int(todo[-1]) + 1
    least: dict[int, int] = {}
    for (row, _, _), p in zip(rows, part.tolist(), strict=True):
        least[root(p)] = min(least.get(root(p), row), row)
    return [(row, least[root(p)]) for (row, _, _), p in zip(rows, part.tolist(), strict=True) if least[root(p)] != row]


def families(rest: DataFrame, sigs: DataFrame, df: DataFrame, key: str, text: str, length: int, percent: int, cell: int = 1500) -> DataFrame:
    """(a, b): links between rows of `rest` (token, row, n, label) in different components."""
    heads = rest.groupBy("token").agg(F.min("row").alias("b"))
    kin = components(rest.join(heads, "token").select(F.col("row").alias("a"), "b"))
    rows = rest.select("row", "n", "label").distinct().join(kin, F.col("row") == F.col("node"), "left")
    # similar sets differ in size by a factor below 100 / percent, so by one step at most
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = rows.select(F.coalesce("component", "row").alias("f"), step.alias("step"), "row", "label")
    per = rows.groupBy("f", "step").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).withColumn("cells", F.ceil(F.col("k") / cell))
    rows = cut(rows.join(per.select("f", "step", "cells"), ["f", "step"]).withColumn("cell", F.pmod(F.xxhash64("row"), "cells")).drop("cells"), "cells")
    cells = per.select("f", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    x, y = (cells.select("f", F.col("step").alias(f"s{i}"), F.col("cell").alias(f"c{i}")) for i in "12")
    pairs = x.join(y, "f").where(((F.col("s1") == F.col("s2")) & (F.col("c1") <= F.col("c2"))) | (F.col("s2") == F.col("s1") + 1))
    own = (F.col("s1") == F.col("s2")) & (F.col("c1") == F.col("c2"))
    sides = pairs.withColumn("side", F.explode(F.when(own, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    sides = sides.withColumns({"step": F.when(F.col("side") == 1, F.col("s1")).otherwise(F.col("s2")), "cell": F.when(F.col("side") == 1, F.col("c1")).otherwise(F.col("c2"))})
    texts = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    named = rows.join(sigs.select("row", "key", "same"), "row")
    found = named.join(texts, named["key"].eqNullSafe(texts["k"])).select("f", "step", "cell", "row", "label", "same", "text")
    met = sides.join(found, ["f", "step", "cell"]).select("f", "s1", "c1", "s2", "c2", "side", "row", "label", "same", "text")
    met = met.repartition("f", "s1", "c1", "s2", "c2").sortWithinPartitions("f", "s1", "c1", "s2", "c2", "side")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see, at, held = Shingles(length), None, ([], [])

        def flush():
            out = _meet(held[0], None if at[1:3] == at[3:] else held[1], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch, lo in ((b, lo) for b in parts for lo in range(0, b.num_rows, 500)):
            cols = [batch.column(i).slice(lo, 500).to_pylist() for i in range(10)]
            for f, s1, c1, s2, c2, side, row, label, same, s in zip(*cols[:9], see(cols[9]), strict=True):
                if (f, s1, c1, s2, c2) != at:
                    if at and held[0]:
                        yield flush()
                    at, held = (f, s1, c1, s2, c2), ([], [])
                if digest(s) == same:
                    held[side - 1].append((row, label, s))
        if at and held[0]:
            yield flush()

    return met.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 5, percent: int = PERCENT) -> DataFrame:
    """A row for each row of `df`: key, md5 (of its text), n (size of its set), component (the smallest key of the
    rows that links reach), first (this row is its component's row to keep)."""
    sigs = signatures(df, key, text, length)
    classes = sigs.where("n > 0").groupBy("same").agg(F.min("row").alias("rep"))
    reps = sigs.join(classes, (sigs["same"] == classes["same"]) & (sigs["row"] == classes["rep"])).select(sigs["*"])
    posted = cut(postings(reps), "postings")
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    pivots = posted.groupBy("token").agg(F.min(F.struct("n", "row")).alias("p")).select("token", F.col("p.row").alias("a"), F.col("p.n").alias("na"))
    stars = posted.join(pivots, "token").where(F.col("row") != F.col("a")).withColumns({"b": F.col("row"), "nb": F.col("n")}).where(fits).select("a", "b").distinct()
    links = cut(confirmed(colliding(stars, sigs), df, key, text, length, percent), "links")

    labels = components(links)
    named = posted.join(labels, posted["row"] == labels["node"], "left").select("token", "row", "n", F.coalesce("component", "row").alias("label"))
    open_ = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rest = cut(named.join(open_, "token"), "open")
    links = links.unionByName(cut(families(rest, sigs, df, key, text, length, percent), "links"))
    labels = components(links)

    member = sigs.join(classes, "same", "left").select("row", "key", "md5", "n", "rep")
    member = member.join(labels, member["rep"] == labels["node"], "left").select("row", "key", "md5", "n", F.coalesce("component", "rep", "row").alias("c"))
    named = member.groupBy("c").agg(F.min("key").alias("component"), F.min(F.struct(F.col("key").isNull().alias("i"), "key", "row")).alias("f")).select("c", "component", F.col("f.row").alias("f"))
    return member.join(named, "c").select("key", "md5", "n", "component", (F.col("row") == F.col("f")).alias("first"))
