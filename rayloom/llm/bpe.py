"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch of texts are made unique; the symbols of all new words stand in one flat
array. A round finds every adjacent pair's rank by binary search over the sorted pair keys,
takes each word's lowest rank by a segmented minimum, and merges all places of that pair (left
to right, without overlap). Words without a known pair leave the array. Encoded words stay in a
bounded cache of the task, so each is merged once, however often it occurs.

The model file is one of those that the tokenizers library reads: NFC, lower case, a split
pattern, byte-level symbols, an end-of-word suffix. Its path is a parameter; each task loads it.

Defined results: null and empty texts have no tokens and decode to an empty string. Strings of
special tokens in a text become these tokens. Texts are taken whole at any length; repeated rows
give repeated results; columns to keep are named by the caller, so clashing names are no matter.
An empty table gives no rows. A word without a break costs its length in each of its rounds, which are as many as
the different pairs that it merges.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Unique words that a task remembers at most; beyond that it starts anew.
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Model:
    """A vocabulary with its merges as sorted arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = max(*vocab.values(), *self.special.values()) + 1
        self.tokens = [""] * self.n
        for k, v in (vocab | self.special).items():
            self.tokens[v] = k
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True))
        keys = left * self.n + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(pattern, regex.V0).findall
        self.odd, self.pattern = young_letters(), pattern
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def pieces(self, text: str, young: bool = False) -> list[str]:
        """The words of a text, normalised; a special token is a piece `(id,)`."""
        find = self.find_young if young else lambda x: self.find(_normal(x))
        if "<|" not in text:
            return find(text)
        out: list = []
        for part in self.cut(text):
            out += [(self.special[part],)] if part in self.special else find(part)
        return out

    def find_young(self, text: str) -> list[str]:
        """By the library's own Unicode tables, for texts with letters that are newer than ours."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        split = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return [x for x, _ in split.pre_tokenize_str(normal)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of each word's tokens."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.final[raw[ends]]
        none = len(self.keys)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] * self.n + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(sym), none, np.int64)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = least == none
            if over.any():
                done.append((word[over], sym[over]))
            place = np.flatnonzero((rank == least) & ~over)
            if not len(place):
                break
            # a run of adjacent places is one symbol repeated: every other pair of it merges
            head = np.r_[True, place[1:] != place[:-1] + 1]
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
            place = place[nth % 2 == 0]
            sym[place] = self.made[at[place]]
            keep = ~over
            keep[place + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


@lru_cache(1)
def young_letters() -> frozenset[str]:
    """Letters and digits that are later than Python's Unicode tables."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


def _normal(text: str) -> str:
    # lower case by character, as the library does: a capital sigma has no final form
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes batches of texts, remembering words from batch to batch."""

    def __init__(self, path: str):
        self.model = model(path)
        self.clear()

    def clear(self) -> None:
        self.code = defaultdict(count().__next__)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.shown = np.zeros(0, np.uint32), []
        self.odd: set[int] = set()  # words with letters that are newer than our Unicode tables

    def learn(self) -> None:
        """Merge the words that got a code since the last time."""
        m, n = self.model, len(self.shown)
        new = list(islice(self.code, n, None))
        if not new:
            return
        plain = [w.encode() for w in new if isinstance(w, str)]
        ids, sizes = m.merge(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(plain) < len(new):
            at = np.cumsum(np.r_[0, sizes])
            nth = iter(range(len(plain)))
            parts = [np.array(w) if isinstance(w, tuple) else ids[at[k := next(nth)] : at[k + 1]] for w in new]
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        self.odd |= {self.code[w] for w in new if isinstance(w, str) and not w.isascii() and not m.odd.isdisjoint(w)}
        names = list(map(m.tokens.__getitem__, ids.tolist()))
        ends = np.cumsum(sizes)
        self.shown += [" ".join(names[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        self.starts = np.r_[self.starts, ends - sizes + len(self.ids)]
        self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, ids.astype(np.uint32)]

    def __call__(self, texts: list[str | None], decode: bool = True) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and them decoded."""
        if len(self.code) > CACHE_WORDS:
            self.clear()
        see = self.code.__getitem__
        codes = [np.fromiter(map(see, self.model.pieces(t or "")), np.int64) for t in texts]
        self.learn()
        if self.odd:
            again = [i for i, c in enumerate(codes) if not self.odd.isdisjoint(c.tolist())]
            for i in again:
                codes[i] = np.fromiter(map(see, self.model.pieces(texts[i] or "", young=True)), np.int64)
            self.learn()
        show = self.shown.__getitem__
        for c in codes:
            sizes = self.sizes[c]
            at = np.repeat(self.starts[c] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield self.ids[at].astype("<u4").tobytes(), " ".join(map(show, c.tolist())) if decode else ""


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", decode: bool = True) -> DataFrame:
    """`keep`, with `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string)."""
    at = len(keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out = list(enc(part.column(at).to_pylist(), decode))
                cols = [part.column(i) for i in range(at)] + [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(tidy(run), schema)
