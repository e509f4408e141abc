"""Suffix-array dedup: removal of all bytes under a `WINDOW`-byte string that starts elsewhere too.

A suffix array of a whole corpus has one round for each byte of its longest text, so the work is
first cut into small collections that together hold every possible match:

1. Anchors. Of every window the leftmost of the smallest hashed 32-grams is its anchor; that
   depends on the window alone, so equal windows have equal anchors at equal places. The windows
   of one anchor are neighbours; with their bytes they are its context. Contexts whose anchor
   occurs nowhere else cannot repeat; contexts that occur twice repeat as a whole.
2. Blocks. Where an anchor has several contexts, their windows are cut into blocks of `BLOCK`
   starts relative to the anchor. All windows of a block share its middle bytes, the core, so
   only blocks with the same core can have equal windows. A block is a short document: the bytes
   left of the core, the core as one symbol of its own weight, the bytes right of it. Blocks of
   a core that more than `HOT` documents share are halved, which makes the core longer, until
   the group is small or a block is a single window.
3. Column-wise construction. The documents of many groups make a collection. Each round puts one
   symbol of each document in front of its latest suffix: the symbol goes into the collection's
   Burrows-Wheeler transform, its rank there is the place of the new suffix, and the common
   prefixes with the new neighbours follow from the weight of the symbol and the range minimum
   of the old common prefixes. Documents with one text stand for each other, and only one of them
   goes in. Transform, common prefixes and suffix numbers are columns that each round goes
   through from front to back; a collection has fewer than `BATCH` + `HOT` documents of less than
   2 `BLOCK` symbols, so its columns stand in memory. A window repeats if the common prefix of
   its suffix with a neighbour reaches `WINDOW` bytes.
4. The repeated windows of a context hold at all its occurrences; each text's ranges are joined
   and cut out of it.

A passage of `PASSAGE` words is often shorter than `WINDOW` bytes, so texts that share one are
marked too (`shares_passage`), though nothing of it is removed: the anchors of all windows of
`PASSAGE` words are taken (32 words each), and a text is marked where another row has one of its
anchors. Equal windows have equal anchors, so every passage of `PASSAGE` words that two rows share
is found, and none of less than an anchor's words is.

Defined results: a passage shared with a row of an equal text counts as shared, one that only
repeats inside its own text does not; a null text is an empty one; texts shorter than a window lose nothing; rows with
equal texts are occurrences of each other, whatever their ids, so their texts of `WINDOW` bytes or
more go as a whole. Texts are taken whole at any length: above 2^22 bytes (words) they are read in
overlapping pieces. Hashes of contexts and cores have 128 bits, those
of anchors of words 63 and more. Columns
of `keep` named like a result (n_bytes, n_removed, n_spans, kept, shares_passage) give way to it.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, discard, tidy

PASSAGE = 50
WINDOW, GRAM, BLOCK, HOT, BATCH = 400, 32, 64, 4_000, 2_000
PIECE = 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def anchors(b: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of window starts [first, last] with one anchor: hash, place, first, last.
    `b`: the bytes of a text, or the hashes of its words."""
    gram = 1 << (min(gram, window).bit_length() - 1)
    h, p, size = b.astype(np.uint64) + np.uint64(1), _P, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * p + h[size:]
            p, size = p * p, size * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    low, n, size = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - gram + 1, 1
    while size * 2 <= n:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < n:
        low = np.minimum(low[: -(n - size)], low[n - size :])
    at = (low & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]].view(np.int64), at[first], first, np.r_[first[1:], len(at)] - 1


def pieces(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Ranges of a text's bytes that together hold every window once."""
    for lo in range(0, max(n - window + 1, 0), PIECE):
        yield lo, min(lo + PIECE + window - 1, n)


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """same (digest of the text), start, n (windows), rel (start less anchor), anchor, ctx."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in parts:
            for lo_ in range(0, batch.num_rows, 200):
                same, start, n, rel, anchor, ctx = ([] for _ in range(6))
                for t in batch.column(0).slice(lo_, 200):
                    raw = (t.as_py() or "").encode()
                    mine = hashlib.md5(raw).digest()
                    for lo, hi in pieces(len(raw), window):
                        h, at, first, last = anchors(np.frombuffer(raw, np.uint8, hi - lo, lo), window)
                        same += [mine] * len(h)
                        anchor.append(h)
                        start.append(first + lo)
                        n.append(last - first + 1)
                        rel.append(first - at)
                        ctx += [xxh3_128_digest(raw[lo + i : lo + j + window], seed=r) for i, j, r in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)]
                whole = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), kind)
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), whole(start, pa.int32()), whole(n, pa.int32()), whole(rel, pa.int32()), whole(anchor, pa.int64()), pa.array(ctx, pa.binary())], names=["same", "start", "n", "rel", "anchor", "ctx"])

    return docs.select("text").mapInArrow(tidy(run), "same binary, start int, n int, rel int, anchor long, ctx binary")


def blocks(reps: DataFrame, docs: DataFrame, window: int, block: int) -> DataFrame:
    """The blocks of contexts: anchor, ctx, at (its first window, counted in the context), size (of
    the full block), key (of its core), left and right bytes."""
    wanted = reps.groupBy("same").agg(F.collect_list(F.struct("anchor", "ctx", "start", "n", "rel")).alias("c"))
    # one row a text: copies meet before the shuffle, and no context is handed out twice
    texts = docs.withColumn("same", F.unhex(F.md5("text"))).groupBy("same").agg(F.first("text").alias("text"))
    rows = texts.join(wanted, "same").select("same", "text", "c")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for text, cs in zip(*(x.slice(lo, 200).to_pylist() for x in batch.columns[1:]), strict=True):
                    raw = text.encode()
                    for c in cs:
                        s, n, rel = c["start"], c["n"], c["rel"]
                        for k in range(rel // block, (rel + n - 1) // block + 1):
                            x0, x1 = max(k * block, rel), min((k + 1) * block, rel + n) - 1
                            a, b = s - rel + (k + 1) * block - 1, s - rel + k * block + window
                            core = hashlib.md5(raw[a:b] + b"%d,%d" % (c["anchor"], k)).digest()
                            out.append((c["anchor"], c["ctx"], x0 - rel, x0 - k * block, block, core, raw[s - rel + x0 : a], raw[b : s - rel + x1 + window]))
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["anchor", "ctx", "at", "off", "size", "key", "left", "right"])

    return rows.mapInArrow(tidy(run), "anchor long, ctx binary, at int, off int, size int, key binary, left binary, right binary")


def halved(b: DataFrame) -> DataFrame:
    """Each block as its two halves, with the bytes that all windows of a half share in its key."""
    half = F.expr("size div 2").cast("int")
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    # windows of the block that are there: starts off .. off + count - 1 of 0 .. size - 1
    lo = F.col("off")
    hi = F.when(n_right > 0, n_right).otherwise(F.lit(0))
    first_part = b.where(lo < half).withColumns({"to": F.least(hi, half - 1)})
    second_part = b.where(hi >= half).withColumns({"from": F.greatest(lo, half)})
    left = lambda skip, n: F.substring(F.col("left"), skip + 1, n)
    # first half: its windows start before `half`, so they share left bytes half - 1 .. last - 1
    one = first_part.select(
        "anchor", "ctx", "at", "off", half.alias("size"),
        F.unhex(F.md5(F.concat(F.col("key"), F.lit(b"a"), left(F.greatest(half - 1 - lo, F.lit(0)), n_left)))).alias("key"),
        left(F.lit(0), F.greatest(half - 1 - lo, F.lit(0))).alias("left"),
        F.substring(F.col("right"), F.lit(1), F.col("to")).alias("right"),
    )
    # second half: its windows start at `half` or later, so they share right bytes 0 .. half - 1
    two = second_part.select(
        "anchor", "ctx", (F.col("at") + F.col("from") - lo).alias("at"), (F.col("from") - half).alias("off"), (F.col("size") - half).alias("size"),
        F.unhex(F.md5(F.concat(F.col("key"), F.lit(b"b"), F.substring(F.col("right"), F.lit(1), half)))).alias("key"),
        left(F.col("from") - lo, n_left).alias("left"),
        F.substring(F.col("right"), half + 1, n_right).alias("right"),
    )
    return one.unionByName(two)


class Columnwise:
    """Transform, common prefixes and suffix numbers of a collection of short documents."""

    def __init__(self, docs: list[tuple[bytes, int, int, bytes]], folder: str | None = None):
        """docs: left bytes, number of the core, its weight, right bytes. folder: where the columns
        stand between rounds; without one they stay in memory."""
        self.folder, self.n = folder, len(docs)
        sizes = np.array([len(a) + 1 + len(b) for a, _, _, b in docs], np.int64)
        raw = np.frombuffer(b"".join(x for a, _, _, b in docs for x in (a, b"\0", b)), np.uint8)
        symbols = raw.astype(np.uint16) + np.uint16(1)  # 0 stands for a document's end
        ends = np.cumsum(sizes)
        core = ends - np.array([len(b) for _, _, _, b in docs], np.int64) - 1
        symbols[core] = np.array([257 + c for _, c, _, _ in docs], np.uint16)
        weights = np.ones(258 + max((c for _, c, _, _ in docs), default=0), np.int64)
        weights[[257 + c for _, c, _, _ in docs]] = [w for _, _, w, _ in docs]
        self.write(bwt=np.zeros(self.n, np.uint16), lcp=np.zeros(self.n, np.uint16), doc=np.arange(self.n, dtype=np.int32), size=np.zeros(self.n, np.uint16))
        place = np.arange(self.n)
        for j in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > j)
            place[live] = self.insert(place[live], symbols[ends[live] - 1 - j], weights, live, j + 1)

    def write(self, **arrays: np.ndarray) -> None:
        if self.folder is None:
            self.held = arrays
            return
        self.kinds = {k: v.dtype for k, v in arrays.items()}
        for k, v in arrays.items():
            # a new file each time: some file systems wait for the disk where one takes another's place
            Path(self.folder, k).unlink(missing_ok=True)
            v.tofile(f"{self.folder}/{k}")

    def read(self, name: str) -> np.ndarray:
        return self.held[name] if self.folder is None else np.fromfile(f"{self.folder}/{name}", self.kinds[name])

    def insert(self, place: np.ndarray, symbol: np.ndarray, weights: np.ndarray, live: np.ndarray, size: int) -> np.ndarray:
        """Put a symbol in front of each live document's latest suffix; the new suffixes' places."""
        bwt, lcp = self.read("bwt"), self.read("lcp")
        bwt[place] = symbol
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[place]
        ended = np.count_nonzero(bwt == 0)
        before, after = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        has_before, has_after = (at > 0) & (bwt[before] == symbol), (at + 1 < len(order)) & (bwt[after] == symbol)
        least = _range_minima(lcp, np.r_[np.where(has_before, before + 1, place), np.where(has_after, place + 1, place)], np.r_[place, np.where(has_after, after, place)])
        up = np.where(has_before, weights[symbol] + least[: len(place)], 0)
        down = np.where(has_after, weights[symbol] + least[len(place) :], 0)
        new = self.n + at - ended
        total = len(bwt) + len(new)
        old = np.ones(total, bool)
        old[new] = False
        source = np.cumsum(old) - 1

        def merged(x: np.ndarray, values) -> np.ndarray:
            out = x.take(source, mode="clip")
            out[new] = values
            return out

        prefixes = merged(lcp, up)
        follows = has_after & (new + 1 < total)
        prefixes[new[follows] + 1] = down[follows]
        self.write(bwt=merged(bwt, 0), lcp=prefixes, doc=merged(self.read("doc"), live), size=merged(self.read("size"), size))
        return new

    def repeated(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and symbol counts of the suffixes that share `window` bytes with a neighbour."""
        lcp = self.read("lcp")
        hit = np.maximum(lcp, np.r_[lcp[1:], 0]) >= window
        return self.read("doc")[hit], self.read("size")[hit]


def _range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo], ..., x[hi] for each pair of places."""
    level = (np.frexp((hi - lo + 1).astype(np.float64))[1] - 1).astype(np.uint8)
    order = np.argsort(level, kind="stable")
    out, at = np.empty(len(lo), np.int64), 0
    for k, n in enumerate(np.bincount(level).tolist()):
        if k:
            x = np.minimum(x[: -(1 << (k - 1))], x[1 << (k - 1) :])  # of 2^k places in a row
        i = order[at : at + n]
        out[i] = np.minimum(x[lo[i]], x[hi[i] - (1 << k) + 1])
        at += n
    return out


def construct(groups: DataFrame, window: int, batch: int = BATCH) -> DataFrame:
    """(anchor, ctx, lo, hi): the windows lo .. hi - 1 of a context repeat."""
    rows = groups.select("anchor", "ctx", "at", "size", "key", "left", "right").repartition("key").sortWithinPartitions("key")

    def solve(held: list[list[tuple]]) -> list[tuple]:
        docs = [(r[5], k, window - r[3] + 1, r[6]) for k, g in enumerate(held) for r in g]
        flat = list(chain.from_iterable(held))
        doc, size = Columnwise(docs).repeated(window)
        left, right = (np.array([len(r[i]) for r in flat]) for i in (5, 6))
        start = left[doc] + 1 + right[doc] - size  # symbols before the suffix
        ok = (start >= 0) & (start <= left[doc])
        doc, start = doc[ok], start[ok]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else []
        tails = [*heads[1:], len(doc)] if len(doc) else []
        return [(flat[doc[a]][0], flat[doc[a]][1], flat[doc[a]][2] + int(start[a]), flat[doc[a]][2] + int(start[b - 1]) + 1) for a, b in zip(heads, tails, strict=True)]

    def distinct(group: list[tuple], out: list[tuple]) -> list[tuple]:
        """One document for each text of a group; documents with one text repeat as a whole."""
        texts: dict[tuple, list[tuple]] = {}
        for r in group:
            texts.setdefault(r[5:7], []).append(r)
        for (left, right), same in texts.items():
            if len(same) > 1:
                out += [(r[0], r[1], r[2], r[2] + len(left) + len(right) - r[3] + 2) for r in same]
        return [same[0] for same in texts.values()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, n, found = [], [], 0, []

        def flush():
            out = found + (solve(held) if held else [])
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "ctx", "lo", "hi"])

        def close():
            docs = distinct(group, found)
            if len(docs) > 1:
                held.append(docs)
            return len(docs) if len(docs) > 1 else 0

        for b in parts:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][4] != r[4]:
                    n += close()
                    group = []
                    if n >= batch or len(found) >= 50_000:
                        yield flush()
                        held, n, found = [], 0, []
                group.append(r)
        close()
        yield flush()

    return rows.mapInArrow(tidy(run), "anchor long, ctx binary, lo int, hi int")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(same, ranges): for each text with repeats, the byte ranges [a, b) that go."""
    block = min(block, window)
    occ = cut(occurrences(docs, window), "occurrences")
    ctxs = occ.groupBy("anchor", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("same", "start", "n", "rel")).alias("r"))
    per = ctxs.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("times").alias("all"))
    shared = per.where("all > 1").select("anchor", "contexts")
    ctxs = cut(ctxs.join(shared, "anchor").select("anchor", "ctx", "times", "contexts", "r.*"), "contexts")
    whole = ctxs.where("times > 1").select("anchor", "ctx", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    level = cut(blocks(ctxs.where("contexts > 1").select("anchor", "ctx", "same", "start", "n", "rel"), docs, window, block), "blocks")
    found, levels = whole, [level]
    while True:
        per = level.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        sized = level.join(per, "key")
        found = found.unionByName(construct(sized.where((F.col("members") <= hot) & (F.col("size") > 1)), window))
        found = found.unionByName(sized.where("size = 1").select("anchor", "ctx", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
        crowd = sized.where((F.col("members") > hot) & (F.col("size") > 1)).drop("members")
        if crowd.isEmpty():
            break
        level = cut(halved(crowd), "blocks")
        levels.append(level)
    found = cut(found, "found")
    discard(ctxs, *levels)
    # a window of this context repeats at all its occurrences
    spans = occ.join(found, ["anchor", "ctx"]).select("same", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") - 1 + window).alias("b")).distinct()
    return spans.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def word_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, same) of each text with `window` words or more: the anchors of its windows of words, even
    numbers, and an odd one for the text itself; `same` is 64 bits of the text's digest."""
    gram = 1 << ((2 * window // 3).bit_length() - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = WordHashes()
        for batch in parts:
            for lo_ in range(0, batch.num_rows, 500):
                raws = [(t.as_py() or "").encode() for t in batch.column(0).slice(lo_, 500)]
                found, same = [np.zeros(0, np.int64)], []
                for raw, w in zip(raws, see(raws), strict=True):
                    if len(w) >= window:
                        mine = np.frombuffer(hashlib.md5(raw).digest()[:8], ">i8").astype(np.int64)
                        own = [mine | 1, *(np.unique(anchors(w[lo:hi], window, gram)[0] & ~1) for lo, hi in pieces(len(w), window))]
                        found += own
                        same.append(np.repeat(mine, sum(map(len, own))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(same) if same else found[0])], names=["anchor", "same"])

    return docs.select("text").mapInArrow(tidy(run), "anchor long, same long")


def passages(docs: DataFrame, window: int = PASSAGE) -> DataFrame:
    """(same): 64 bits of the digests of the texts that share an anchor of `window` words with another row."""
    found = cut(word_anchors(docs, window), "passages")
    per = found.groupBy("anchor").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.count("*").alias("n"))
    shared = per.where("lo <> hi or (anchor & 1 = 1 and n > 1)").select("anchor")
    marked = cut(found.join(shared, "anchor", "left_semi").select("same").distinct(), "passages")
    discard(found)
    return marked


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, block: int = BLOCK, hot: int = HOT, words: int = PASSAGE) -> DataFrame:
    """`keep`, with n_bytes, n_removed, n_spans, the bytes that are left (`kept`, binary) and
    `shares_passage`: whether `words` words in a row stand in another row too."""
    keep = [c for c in keep if c not in ("n_bytes", "n_removed", "n_spans", "kept", "shares_passage")]
    own = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__own_text"))
    ranges = repeated_ranges(own.select(F.col("__own_text").alias("text")), window, block, hot)
    shared = passages(own.select(F.col("__own_text").alias("text")), words).withColumnRenamed("same", "part")
    digest = F.unhex(F.md5("__own_text"))
    texts = own.select(digest.alias("same")).distinct().withColumn("part", F.conv(F.hex(F.substring("same", 1, 8)), 16, -10).cast("long"))
    shared = texts.join(shared, "part", "left_semi").select("same", F.lit(True).alias("shares"))
    found = ranges.join(shared, "same", "full").toDF("__same", "__ranges", "__shares")
    rows = own.withColumn("__same", digest).join(found, "__same", "left").select(*keep, "__own_text", "__ranges", F.coalesce("__shares", F.lit(False)).alias("__shares"))
    at = len(keep)
    schema = own.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.lit(True).alias("shares_passage")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, 500):
                b, out = batch.slice(lo, 500), []
                for t, ranges_ in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True):
                    raw, left, end, removed, spans = t.encode(), [], 0, 0, 0
                    at_, stop = None, None
                    for r in [*(ranges_ or []), None]:
                        if r is not None and at_ is not None and r["a"] <= stop:
                            stop = max(stop, r["b"])
                            continue
                        if at_ is not None:
                            left.append(raw[end:at_])
                            removed, spans, end = removed + stop - at_, spans + 1, stop
                        if r is not None:
                            at_, stop = r["a"], r["b"]
                    out.append((len(raw), removed, spans, b"".join([*left, raw[end:]])))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary()), b.column(at + 2)], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)
