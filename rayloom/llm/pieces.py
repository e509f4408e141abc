"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is written with the space mark for each space and one in front. Of all adjacent symbols
whose joint string is a piece, the pair with the highest score merges first, the leftmost one of
equals; what it makes may form new pairs with its neighbours. This is an agenda that is ordered by
score. Two symbols can only ever merge across a border if some piece holds both characters that
meet there, so texts fall into independent runs: first at spaces (no piece of such models holds
the mark after another character; if one does, texts are taken whole), then at pairs of characters
that no piece holds.

The runs of a batch's new words stand in one flat array. In a round, every run takes the head of
its agenda (a segmented minimum over the ranks of the pairs' scores) and only the pairs beside what was
merged are looked up anew, by binary search over sorted pair keys. Runs of more than `LONG`
characters have a heap each instead, so that no text costs the square of its length. Words are
remembered until `CACHE_WORDS` of them are held.

The model's path is a parameter; pieces and scores are read by the sentencepiece library, which
also holds the results in `check`, batch by batch. A model of another kind (unigram, with a
normaliser, with pieces that stand in texts as they are) fails on the probe strings and is refused.

Defined results: null and empty texts have the end id alone and decode to an empty string. Texts
are taken whole at any length; a run that no pair of characters cuts costs n log n and about 100
bytes a character. Strings of control pieces in a text are ordinary text; characters without a
piece become their bytes; the mark itself is a space. Repeated rows give repeated results; an
empty table gives none. Columns to keep are named by the caller and stand first; one that is
called `ids` or `decoded` is left out for the operator's.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

MARK, CACHE_WORDS, LONG, SLICE_CHARS = "▁", 600_000, 200, 2_000_000
NONE = np.int64(1) << 40
PROBES = ("", " ", "  a  b ", "\té\nﬁÅ x", "<s> </s> <unk>", "a▁b \U0001f9ff\x00", "Ａ the  therefore 1234 ...")

codecs.register_error("rayloom-each-byte", lambda e: ("�", e.start + 1))


class Model:
    """Pieces and scores as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.end = lib.get_piece_size(), lib.eos_id()
        plain = {i: lib.id_to_piece(i) for i in range(self.n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.shown = [plain[i].replace(MARK, " ").encode() if i in plain else b"" for i in range(self.n)]
        for b, i in enumerate(self.bytes.tolist()):
            self.shown[i] = bytes([b])
        self.shown[lib.unk_id()] = " ⁇ ".encode()
        self.silent = np.array([lib.is_control(i) for i in range(self.n)])
        # symbols: the pieces by id, then characters that stand in pieces without being one
        symbol = {p: i for i, p in plain.items()}
        for c in sorted({c for p in plain.values() for c in p} - symbol.keys()):
            symbol[c] = self.n + len(symbol)
        self.size = max(symbol.values()) + 2
        self.stranger = self.size - 1
        self.chars = np.full(0x110000, self.stranger, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        known = {}
        for i, p in plain.items():
            for at in range(1, len(p)):
                a, b = symbol.get(p[:at]), symbol.get(p[at:])
                if a is not None and b is not None:
                    known[a * self.size + b] = (order[lib.get_score(i)], i)
        self.keys = np.array(sorted(known), np.int64)
        self.ranks, self.made = np.array([known[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2).T
        self.met = np.array(sorted({int(self.chars[ord(a)]) * self.size + int(self.chars[ord(b)]) for p in plain.values() for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.spaced = not any(MARK in p.lstrip(MARK) for p in plain.values())
        for text in PROBES:
            ids = [*(self.merge([self.mark(text)])[0].tolist() if text else []), self.end]
            if ids != lib.encode(text, add_eos=True) or self.decode(ids) != lib.decode(ids):
                raise ValueError(f"{path} is no plain merge-type model: {text!r} differs from the library")

    @staticmethod
    def mark(text: str) -> str:
        return (" " + text).replace(" ", MARK)

    def words(self, text: str) -> list[str]:
        """Independent parts; the mark in front of each is left out where there is just one."""
        if not text:
            return []
        if not self.spaced:
            return [self.mark(text)[1:]]
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:].replace(" ", MARK) for w in re.findall(" +[^ ]*", " " + text)]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols the rank of what they make (NONE: nothing) and its id."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each word's ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(0, np.int64), sizes
        sym, ends = self.chars[points], np.cumsum(sizes)
        key = sym[:-1] * self.size + sym[1:]
        cut = np.ones(len(sym), bool)  # a run begins here
        if len(self.met):
            cut[1:] = self.met[np.minimum(np.searchsorted(self.met, key), len(self.met) - 1)] != key
        cut[(ends - sizes)[sizes > 0]] = True
        out = np.full(len(sym), -1, np.int64)
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.r_[starts, len(sym)])
        for a, n in zip(starts[lengths > LONG].tolist(), lengths[lengths > LONG].tolist(), strict=True):
            self.agenda(sym, a, n, out)
        self.rounds(sym, starts, lengths, out)
        # from here on a place of `out` is an id, or -1 inside a token
        strange = out >= self.n
        width = np.where(out < 0, 0, 1)
        if strange.any():
            raw = [chr(c).encode() for c in points[strange].tolist()]
            width[strange] = list(map(len, raw))
            ids = np.repeat(out, width)
            ids[np.repeat(strange, width)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = out[out >= 0]
        before = np.r_[0, np.cumsum(width)]
        return ids, before[ends] - before[ends - sizes]

    def rounds(self, sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        """All runs of at most LONG characters; each merges the head of its agenda once a round."""
        out[starts[lengths == 1]] = sym[starts[lengths == 1]]
        some = (lengths > 1) & (lengths <= LONG)
        lengths = lengths[some]
        place = np.repeat(starts[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        run, sym = np.repeat(np.arange(len(lengths)), lengths), sym[place]
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(run[:-1] == run[1:])
        rank[inner], made[inner] = self.look(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            best = np.minimum.reduceat(rank, head)
            best = np.repeat(best, np.diff(np.r_[head, len(sym)]))
            over = best == NONE
            out[place[over]] = sym[over]
            at = np.flatnonzero((rank == best) & ~over)
            if not len(at):
                break
            at = at[np.r_[True, run[at[1:]] != run[at[:-1]]]]  # the leftmost
            sym[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, run, place, rank, made = (x[keep] for x in (sym, run, place, rank, made))
            last = np.r_[run[1:] != run[:-1], True]
            rank[at] = NONE
            right = at[~last[at]]
            left = at[at > 0] - 1
            left = left[run[left] == run[left + 1]]
            both = np.concatenate([right, left])
            rank[both], made[both] = self.look(sym[both], sym[both + 1])

    @cached_property
    def known(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def agenda(self, sym: np.ndarray, start: int, n: int, out: np.ndarray) -> None:
        """One long run by a heap of rank and place; what a place's pair has become since tells stale entries."""
        s = sym[start : start + n]
        rank, _ = self.look(s[:-1], s[1:])
        at = np.flatnonzero(rank < NONE)
        heap = (rank[at] * n + at).tolist()
        heapify(heap)
        now, s = array("q", np.r_[np.where(rank < NONE, rank, -1), -1]), array("q", s)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            if now[i] != r:
                continue
            j = after[i]
            s[i], s[j], now[j] = self.known[s[i] * self.size + s[j]][1], -1, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
            for a, b in ((before[i], i), (i, j)):
                if a >= 0:
                    now[a] = -1
                    if b < n and (found := self.known.get(s[a] * self.size + s[b])):
                        now[a] = found[0]
                        heappush(heap, found[0] * n + a)
        out[start : start + n] = s

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: control pieces are silent, one mark in front is taken off, bytes
        that are no UTF-8 become replacement characters one by one; a control piece parts bytes."""
        said = [i for i in ids if not self.silent[i]]
        runs = "".join(" " if self.silent[i] else "x" for i in ids).split()
        text = iter(said)
        text = "".join(b"".join(self.shown[i] for i in islice(text, len(r))).decode(errors="rayloom-each-byte") for r in runs)
        return text[1:] if said and text[:1] == " " and said[0] not in (self.bytes[32], self.lib.unk_id()) else text


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes batches of texts, remembering words from batch to batch."""

    def __init__(self, path: str):
        self.model = model(path)
        self.clear()

    def clear(self) -> None:
        self.code = defaultdict(count(1).__next__)  # 0 is the end id
        self.starts, self.sizes, self.shown = np.zeros(1, np.int64), np.ones(1, np.int64), [""]
        self.ids = np.array([self.model.end], np.int32)

    def learn(self) -> None:
        m, new = self.model, list(islice(self.code, len(self.shown) - 1, None))
        if not new:
            return
        ids, sizes = m.merge([MARK + w for w in new])
        names, ends = list(map(m.shown.__getitem__, ids.tolist())), np.cumsum(sizes)
        self.shown += [b"".join(names[a:b]).decode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        self.starts, self.sizes = np.r_[self.starts, ends - sizes + len(self.ids)], np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, ids.astype(np.int32)]

    def __call__(self, texts: list[str | None], decode: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts (each with the end id), how many each has, and them decoded."""
        if len(self.code) > CACHE_WORDS:
            self.clear()
        see, flat, n = self.code.__getitem__, [], []
        for t in texts:
            flat += map(see, self.model.words(t or ""))
            flat.append(0)
            n.append(len(flat))
        self.learn()
        codes, to = np.array(flat, np.int64), np.array(n, np.int64)
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        each = np.diff(np.r_[0, ends][np.r_[0, to]])
        show = list(map(self.shown.__getitem__, flat)) if decode else []
        # the first mark is the one that encoding put in front
        texts = ["".join(show[a:b])[1:] for a, b in zip([0, *n], n, strict=False)] if decode else [""] * len(n)
        return ids, each, texts


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", decode: bool = True) -> DataFrame:
    """`keep`, with `ids` (array of int, the end id last) and `decoded` (string)."""
    keep = [c for c in keep if c not in ("ids", "decoded")]
    at = len(keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            for lo, hi in slices(batch.column(at), SLICE_CHARS):
                part = batch.slice(lo, hi - lo)
                ids, each, texts = enc(part.column(at).to_pylist(), decode)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), lists, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep`, with `decoded` of a column of ids; null ids decode to an empty string. Ids that the model
    does not have are refused with an IndexError."""
    keep = [c for c in keep if c != "decoded"]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(tidy(run), schema)


def check(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` of the rows whose ids or decoded text are not those of the sentencepiece library:
    none is right. Both are made in the same Arrow batch."""
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids, each, shown = enc(texts)
            theirs = enc.model.lib.encode(texts, add_eos=True, num_threads=1)
            ends = np.cumsum(each).tolist()
            bad = [a != x.tolist() or b != y for a, b, x, y in zip(theirs, enc.model.lib.decode(theirs, num_threads=1) if texts else [], np.split(ids, ends), shown, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(bad, pa.bool_())) for i in range(len(keep))], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(run), schema)
