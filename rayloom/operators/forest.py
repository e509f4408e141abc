"""Approximate matching of descriptors by a forest of random cuts; the exact way is `matching.ratio_match`.

Each tree cuts the space of descriptors by one component at a time: at a node, a component is drawn
from those that vary most there, and its median is the place of the cut. The trees are learnt on a bounded
sample (`SAMPLE` descriptors) and are small arrays; every descriptor is put into a leaf of each tree. A
query also looks into the `probes` other leaves of each tree that the cuts nearest to it hold, which is
backtracking with a bound. The trees are those of all images, so descriptors and queries meet by part of a tree
(what is below one of its upper nodes), not by pair of images: a query goes once to each part that it has leaves
in, with the images that it asks. Parts that hold more than `BLOCK` descriptors are cut into
blocks, so no task has more at once. The two nearest of each image and part go on, and the two nearest of these that
differ are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import nearest

TREES, PROBES, LEAF, SAMPLE, BLOCK, WIDEST = 6, 12, 48, 20_000, 65_536, 5
#: Levels of a tree above its parts, at least, so that all tasks have some; and how many queries are compared at once.
PARTS, ASKED = 3, 16_384


def learn(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree (component, cut) of its nodes in level order, 2^depth - 1 of them."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        dim, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        held = {0: np.arange(len(sample))}
        for k in range(len(dim)):
            rows = held.pop(k)
            x = sample[rows] if len(rows) else sample[:1]
            dim[k] = rng.choice(np.argsort(-x.var(axis=0), kind="stable")[:WIDEST])
            cut[k] = np.median(x[:, dim[k]])
            above = sample[rows, dim[k]] > cut[k]
            held[2 * k + 1], held[2 * k + 2] = rows[~above], rows[above]
        out.append((dim, cut))
    return out


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, probes: int = 0) -> list[np.ndarray]:
    """The leaf of each row, and then, for each probe, the leaf behind the next nearest cut on its way; -1 where
    there are no more cuts."""
    dim, cut = tree

    def down(node: np.ndarray, levels: int) -> np.ndarray:
        for _ in range(levels):
            node = np.where(node < 0, -1, 2 * node + 1 + (x[np.arange(len(x)), dim[np.maximum(node, 0)]] > cut[np.maximum(node, 0)]))
        return node

    node, way = np.zeros(len(x), np.int64), []
    for _ in range(depth):
        way.append(node)
        node = down(node, 1)
    out = [node]
    if probes and depth:
        off = np.stack([np.abs(x[np.arange(len(x)), dim[n]] - cut[n]) for n in way], axis=1)
        order = np.argsort(off, axis=1, kind="stable")
        for k in range(min(probes, depth)):
            found = np.full(len(x), -1, np.int64)
            for level in range(depth):
                here = order[:, k] == level
                if here.any():
                    after = way[level + 1] if level + 1 < depth else node
                    other = np.where(here, ((after - 1) ^ 1) + 1, -1)  # the sibling
                    found = np.where(here, down(other, depth - level - 1), found)
            out.append(found)
    return out


def _array(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _placed(kp: DataFrame, trees: list, depth: int, top: int, probes: int) -> DataFrame:
    """The rows of kp (desc, ...), one for each part of each tree that they have leaves in, with tree, part and leaves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo in range(0, len(whole), 2000):
                batch = whole.slice(lo, 2000)
                x = _array(batch.column("desc"))
                for t, tree in enumerate(trees):
                    found = np.stack(leaves(x, tree, depth, probes), axis=1)
                    row, k = np.nonzero(found >= 0)
                    leaf = found[row, k] - (1 << depth) + 1
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    part = leaf >> (depth - top)
                    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(row)], pa.int32()), pa.array(leaf, pa.int32()))
                    own = batch.take(pa.array(row[head]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(head), t), pa.int32()), pa.array(part[head], pa.int32()), lists], names=[*own.schema.names, "tree", "part", "leaves"])

    kind = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kp.schema)
    return kp.mapInArrow(run, f"{kind}, tree int, part int, leaves array<int>")


class _Held:
    """A block of descriptors in order of image and id, and which of them a leaf has of each image."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.y, self.ids, self.cams = np.concatenate([_array(b.column("desc")) for b in rows]), *(pa.concat_arrays([b.column(c) for b in rows]) for c in ("kp_id", "cam_id"))
        self.images, code = np.unique(self.cams.to_numpy(zero_copy_only=False), return_inverse=True)
        leaf = np.concatenate([b.column("leaves").flatten().to_numpy() for b in rows])
        order = np.lexsort((code, leaf))  # stable, so ids stay in order
        leaf, code = leaf[order], code[order]
        heads = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (code[1:] != code[:-1])])
        self.leaves: dict[int, list[tuple[int, np.ndarray]]] = {}
        for lo, hi in zip(heads, [*heads[1:], len(leaf)], strict=True):
            self.leaves.setdefault(int(leaf[lo]), []).append((int(code[lo]), order[lo:hi]))

    def nearest(self, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query (cam_id, kp_id, desc, others, leaves) the two nearest in each of the images `others`."""
        x, ids, cams = np.concatenate([_array(b.column("desc")) for b in rows]), *(pa.concat_arrays([b.column(c) for b in rows]) for c in ("kp_id", "cam_id"))
        others, lists = (pa.concat_arrays([b.column(c) for b in rows]) for c in ("others", "leaves"))
        _, one, code = np.unique(cams.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        asks = np.stack([np.isin(self.images, others[int(k)].values.to_numpy(zero_copy_only=False)) for k in one])
        row, leaf = np.repeat(np.arange(len(x)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        heads = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        asked, out = asks.any(axis=0), []
        for lo, hi in zip(heads, [*heads[1:], len(leaf)], strict=True):
            for image, there in self.leaves.get(int(leaf[lo]), ()):
                own = row[lo:hi]
                own = own[asks[code[own], image]] if asked[image] else own[:0]
                if len(own):
                    r, c, d = nearest(x[own], self.y[there])
                    out.append((own[r], np.full(len(r), image), there[c], d))
        if out:
            i, image, j, d = (np.concatenate(v) for v in zip(*out, strict=True))
            order = np.lexsort((j, d, image, i))
            i, image, j, d = i[order], image[order], j[order], d[order]
            one = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (image[1:] != image[:-1])])
            many = np.diff(np.r_[one, len(i)]) > 1
            two = np.where(many, one + 1, one)
            take = lambda a, k, none=None: a.take(pa.array(k, mask=none))
            yield pa.RecordBatch.from_arrays(
                [take(cams, i[one]), take(self.cams, j[one]), take(ids, i[one]), take(self.ids, j[one]), pa.array(d[one]), take(self.ids, j[two], ~many), pa.array(d[two], mask=~many)],
                names=["cam_i", "cam_j", "kp_i", "kp_j", "d", "kp_2", "d_2"],
            )


def two_nearest(kp: DataFrame, pairs: DataFrame, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, seed: int = 3) -> DataFrame:
    """(cam_i, cam_j, kp_i, t): the two nearest descriptors (d, kp_j) of cam_j found for each keypoint of cam_i.
    kp (cam_id, kp_id, desc), pairs (cam_i, cam_j). Distances count to nine places, ties by the smaller kp_j.
    Null descriptors and those of another length than most of the sample meet nothing."""
    kp = kp.where(F.col("desc").isNotNull() & ~F.exists("desc", lambda v: v.isNull() | F.isnan(v.cast("double"))))
    # a bounded sample: it moves the cuts, not what is found among them
    n = kp.count()
    if not n:
        return pairs.limit(0).select("cam_i", "cam_j").join(kp.select(F.col("kp_id").alias("kp_i"), F.array(F.struct(F.lit(0.0).alias("d"), F.col("kp_id").alias("kp_j"))).alias("t")).limit(0))
    share = min(1.0, 1.2 * SAMPLE / n)
    rows = kp.where(F.pmod(F.xxhash64("cam_id", "kp_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(SAMPLE).select("desc").toPandas()["desc"]
    size = int(rows.map(len).mode()[0])
    sample = np.stack([v for v in rows if len(v) == size]).astype(float)
    kp = kp.where(F.size("desc") == size)
    largest = kp.groupBy("cam_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    depth = max(0, min(int(np.ceil(np.log2(max(largest / leaf, 1)))), int(np.log2(max(len(sample) / 4, 1)))))
    forest = learn(sample, depth, trees, seed)
    top = min(depth, max(PARTS, int(np.ceil(np.log2(max(n / BLOCK, 1))))))
    kp = kp.select("cam_id", "kp_id", "desc" if kp.schema["desc"].dataType.simpleString() == "array<float>" else F.col("desc").cast("array<double>").alias("desc"))
    stored = _placed(kp.join(pairs.select(F.col("cam_j").alias("cam_id")).distinct(), "cam_id", "left_semi"), forest, depth, top, 0)
    # a row for each part
    per = F.broadcast(stored.groupBy("tree", "part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    asks = pairs.groupBy(F.col("cam_i").alias("cam_id")).agg(F.collect_set("cam_j").alias("others"))  # a row has a result for each of them
    asked = _placed(kp.join(asks, "cam_id"), forest, depth, top, probes)
    keys = ["tree", "part", "b"]
    columns = ["cam_id", "kp_id", "desc", "others", "leaves"]
    right = stored.withColumn("others", F.array().cast(asks.schema["others"].dataType)).join(per, ["tree", "part"]).withColumn("b", F.pmod(F.xxhash64("cam_id", "kp_id"), "blocks"))
    left = asked.join(per, ["tree", "part"]).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = right.select(*keys, F.lit(0).alias("side"), *columns).unionByName(left.select(*keys, F.lit(1).alias("side"), *columns))
    met = met.repartition(*keys).sortWithinPartitions(*keys, "side", "cam_id", "kp_id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held, waiting = None, None, [], []  # a block stands before its queries, which stream past
        for batch in parts:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in (*keys, "side")], axis=1)
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for lo, hi in zip(heads, [*heads[1:], len(key)], strict=True):
                if tuple(key[lo, :3]) != at:
                    if waiting:
                        yield from block.nearest(waiting)
                    at, block, held, waiting = tuple(key[lo, :3]), None, [], []
                rows = batch.slice(int(lo), int(hi - lo))
                if key[lo, 3] == 0:
                    held.append(rows)
                elif held:
                    block = block or _Held(held)
                    waiting.append(rows)
                    if sum(map(len, waiting)) >= ASKED:
                        yield from block.nearest(waiting)
                        waiting = []
        if waiting:
            yield from block.nearest(waiting)

    kind = {c: kp.schema[c].dataType.simpleString() for c in ("cam_id", "kp_id")}
    schema = f"cam_i {kind['cam_id']}, cam_j {kind['cam_id']}, kp_i {kind['kp_id']}, kp_j {kind['kp_id']}, d double, kp_2 {kind['kp_id']}, d_2 double"
    two = F.array_compact(F.array(F.struct("d", "kp_j"), F.when(F.col("d_2").isNotNull(), F.struct(F.col("d_2").alias("d"), F.col("kp_2").alias("kp_j")))))
    own = ["cam_i", "cam_j", "kp_i"]
    # two a part; a neighbour may stand in a part of every tree
    best = met.mapInArrow(run, schema).repartition(*own).groupBy(*own).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(two)))), 1, 2).alias("t"))
    return best.select(*own, "t")


def forest_match(kp: DataFrame, pairs: DataFrame, ratio: float = 0.6, **settings: int) -> DataFrame:
    """`matching.ratio_match` over the neighbours that the forest finds."""
    t = two_nearest(kp, pairs, **settings)
    return t.where((F.size("t") == 2) & (F.col("t")[0]["d"] < ratio * F.col("t")[1]["d"])).select("cam_i", "cam_j", "kp_i", F.col("t")[0]["kp_j"].alias("kp_j"), F.col("t")[0]["d"].alias("dist"))
