"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the documents of one run of doc_ids in ascending order, one frame a document:

    frame 0 | frame 1 | ... | index frame | seek table

Each frame is a whole zstandard frame of little-endian token ids (2 bytes wide where the
vocabulary allows, else 4). The index frame is a zstandard skippable frame with the documents'
ids. The seek table is the skippable frame of the public seekable format: for each frame its
compressed size, its decompressed size and the low 32 bits of the XXH64 of its content; then
the number of frames, a descriptor (checksums on) and the closing magic number. A reader fetches
the end of the file, and then only the frames of the documents that it wants.

Texts are encoded and compressed where they are read, once, into a written table of frames; only these are
shuffled, by Spark's ranges of doc_id (equal and null ids by their checksums besides, so that
an id may fill several ranges). A task streams its sorted frames into files of about `FILE_BYTES` of ids,
each under a name of its own until it is complete: a task that is run again
replaces the files by the same documents' frames.

Defined results: null and empty texts hold the end token alone; null doc_ids stand first, equal
doc_ids next to each other in any order; an empty table makes no file; texts are taken whole, however
long. Only the key and the text are read, so other columns and their names are no matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, count, islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols, young_letters
from ..operators.ranges import running
from .common import cut, discard, scratch, slices

END_ID, FILE_BYTES, PART_BYTES, SLICE_CHARS, LEVEL, CACHE_WORDS, JOINT = 2, 16 << 20, 64 << 20, 8_000_000, 1, 500_000, 50
#: Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: A space inside or at the end of a run of white space. Python's \s holds all of the pattern's.
INNER_SPACE = re.compile(r" (?<=\s )(?:\s|\Z)")
#: White space other than the space, before a space: a text without any of these has no inner space.
ODD_SPACE = tuple(f"{c} " for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
ODD_ASCII = tuple(c for c in ODD_SPACE if c.isascii())


class WordEncoder:
    """The tokenizers library over the distinct pieces of the texts, remembered for a while.

    The library splits a text by a fixed pattern before it merges. A piece of that pattern holds
    a space past its start only inside a run of white space: one that goes on after the space, or
    ends the text with it. Where there is no such space, nor two spaces together, a text's ids are
    those of its parts between spaces, each with the space before it, and Arrow splits a batch of such
    texts and numbers their distinct words. Other texts are split by the pattern itself; texts with an
    added token's string, or with letters that are newer than our Unicode tables, go to the library whole.
    New words are split by the pattern into pieces, of which only the new ones go to the library.
    """

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is Spark's to share out
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.young, self.n = young_letters(), self.lib.get_vocab_size()
        space = byte_symbols()[32]
        self.spaced = np.array([(self.lib.id_to_token(i) or "").startswith(space) for i in range(self.n)])
        line = self.lib.encode("a\nb", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 else -1
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.code, self.odd = defaultdict(count().__next__), set()
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.pieces = _Known()

    def learn(self) -> None:
        """The ids of words that got a number since the last time."""
        new = list(islice(self.code, len(self.sizes), None))
        if not new:
            return
        full = [w[0] if isinstance(w, tuple) else " " + w for w in new]
        first = len(self.sizes)
        self.odd |= {first + i for i, t in enumerate(full) if not t.isascii() and not self.young.isdisjoint(t)}
        # a word that follows a space and begins with none opens the piece that begins with a space
        joint = _opens(full)
        split = self.find("".join(compress(full, joint)))
        heads = np.flatnonzero(np.fromiter(map(str.startswith, split, repeat(" ")), bool, len(split)))
        if len(heads) != joint.sum():
            joint[:], split, heads = False, [], heads[:0]
        rest = [self.find(t) for t in compress(full, ~joint)]
        codes = np.fromiter(map(self.pieces.code.__getitem__, chain(split, chain.from_iterable(rest))), np.int64)
        self.encode_new()
        ids, sizes = self.pieces.gather(codes)
        # words as runs of pieces: first those that were split together
        tops = np.r_[heads, len(split) + np.cumsum([0, *map(len, rest)])]
        ends = np.cumsum(np.r_[0, sizes])[tops]
        place = np.r_[np.flatnonzero(joint), np.flatnonzero(~joint)]
        starts, length = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        starts[place], length[place] = ends[:-1] + len(self.ids), np.diff(ends)
        self.starts, self.sizes, self.ids = np.r_[self.starts, starts], np.r_[self.sizes, length], np.r_[self.ids, ids]

    def encode_new(self) -> None:
        """The ids of new pieces: those that begin with a space stand `JOINT` to a text of the library's, where the
        tokens that begin with a space part them again; those of letters alone too, between line ends.
        Where the parts are more or fewer, and for all other pieces, each is a text of its own."""
        known = self.pieces
        new = known.new()
        if not new:
            return
        starts, sizes, flat, n = np.zeros(len(new), np.int64), np.full(len(new), -1, np.int64), [known.ids], len(known.ids)
        opens = _opens(new)
        letters = np.fromiter(map(str.isalpha, new), bool, len(new)) & (self.line >= 0)
        for group, link in ((np.flatnonzero(opens), ""), (np.flatnonzero(letters), "\n")):
            texts = list(map(new.__getitem__, group.tolist()))
            for big in range(0, len(group), 20 * JOINT):
                at = range(big, min(big + 20 * JOINT, len(group)), JOINT)
                for lo, e in zip(at, self.lib.encode_batch_fast([link.join(texts[lo : lo + JOINT]) for lo in at], add_special_tokens=False), strict=True):
                    c, ids = group[lo : lo + JOINT], np.array(e.ids, np.uint32)
                    heads = np.r_[0, np.flatnonzero(ids == self.line) + 1] if link else np.flatnonzero(self.spaced[ids])
                    if len(heads) == len(c):
                        starts[c], sizes[c] = heads + n, np.diff(heads, append=len(ids) + bool(link)) - bool(link)
                        flat.append(ids)
                        n += len(ids)
        rest = np.flatnonzero(sizes < 0).tolist()
        for lo in range(0, len(rest), 500):  # the library's encodings are large beside their ids
            some = rest[lo : lo + 500]
            for i, e in zip(some, self.lib.encode_batch_fast([new[i] for i in some], add_special_tokens=False), strict=True):
                flat.append(np.array(e.ids, np.uint32))
                starts[i], sizes[i] = n, len(flat[-1])
                n += len(flat[-1])
        known.starts, known.sizes, known.ids = np.r_[known.starts, starts], np.r_[known.sizes, sizes], np.concatenate(flat)

    def plain(self, text: str) -> bool:
        """The text's parts between spaces are independent."""
        return "  " not in text and not (any(c[0] in text and c in text for c in (ODD_ASCII if text.isascii() else ODD_SPACE)) and INNER_SPACE.search(text))

    def numbered(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For plain texts the numbers of their words; one that follows a space is a string without it,
        others are (word,)."""
        import pyarrow.compute as pc

        see = self.code.__getitem__
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = parts.flatten().dictionary_encode()
        own = flat.dictionary.to_numpy(zero_copy_only=False)
        heads = np.asarray(parts.offsets)[:-1]
        each = np.diff(np.asarray(parts.offsets))
        index = np.asarray(flat.indices)
        inner = np.ones(len(index), bool)
        inner[heads] = False
        used = np.zeros(len(own), bool)
        used[index[inner]] = True
        number = np.zeros(len(own), np.int64)
        number[used] = np.fromiter(map(see, own[used].tolist()), np.int64)
        codes = number[index]
        for lo, n in zip(heads.tolist(), each.tolist(), strict=True):
            first = own[index[lo]]
            if first:
                codes[lo] = see((first,))
            yield codes[lo if first else lo + 1 : lo + n]

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.code) > CACHE_WORDS or len(self.pieces.code) > CACHE_WORDS:
            self.clear()
        texts = [t or "" for t in texts]
        whole = [any(a in t for a in self.added) for t in texts]
        plain = [not w and self.plain(t) for t, w in zip(texts, whole, strict=True)]
        see = self.code.__getitem__
        easy = self.numbered(list(compress(texts, plain)))
        codes = [next(easy) if p else np.zeros(0, np.int64) if w else np.fromiter(map(see, [x[1:] if len(x) > 1 and x[0] == " " else (x,) for x in self.find(t)]), np.int64) for t, w, p in zip(texts, whole, plain, strict=True)]
        self.learn()
        lo = 0
        while lo < len(texts):  # some texts at once, by their words
            hi, n = lo + 1, len(codes[lo])
            while hi < len(texts) and n + len(codes[hi]) <= 200_000:
                n, hi = n + len(codes[hi]), hi + 1
            some = np.concatenate(codes[lo:hi])
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            flat = self.ids[np.repeat(self.starts[some] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.r_[0, ends][np.cumsum([0, *map(len, codes[lo:hi])])].tolist()
            for k in range(lo, hi):
                if whole[k] or (self.odd and not self.odd.isdisjoint(codes[k].tolist())):
                    yield np.array(self.lib.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                else:
                    yield flat[cuts[k - lo] : cuts[k - lo + 1]]
            lo = hi


def _opens(pieces: list[str]) -> np.ndarray:
    """Which begin with a space and go on with something else."""
    flags = lambda f, *x: np.fromiter(map(f, *x), bool, len(pieces))
    second = list(map(itemgetter(slice(1, 2)), pieces))
    return flags(str.startswith, pieces, repeat(" ")) & flags(bool, second) & ~flags(str.isspace, second)


class _Known:
    """Strings by number, each with its ids."""

    def __init__(self):
        self.code = defaultdict(count().__next__)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def new(self) -> list[str]:
        return list(islice(self.code, len(self.sizes), None))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some strings, one after another, and how many each has."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for a Python worker, which serves many tasks: the words of one help the next."""
    return WordEncoder(path)


def _xxh64(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def frames(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, level: int = LEVEL) -> DataFrame:
    """key -> (n_tokens, width, checksum, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(path), zstandard.ZstdCompressor(level=level, write_checksum=True)
        width = 2 if max(enc.n, end_id) < 1 << 16 else 4
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_CHARS):
                part = batch.slice(lo, hi - lo)
                raw = [np.append(x, np.uint32(end_id)).astype(f"<u{width}").tobytes() for x in enc(part.column(1).to_pylist())]
                cols = [part.column(0), pa.array([len(x) // width for x in raw], pa.int64()), pa.array([width] * len(raw), pa.int32()), pa.array(np.fromiter(map(_xxh64, raw), np.int64, len(raw))), pa.array(map(pack.compress, raw), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "width", "checksum", "frame"])

    def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # no cycles are made here, and each collection would walk through all words that are held
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(uncollected, "key long, n_tokens long, width int, checksum long, frame binary")


def write(docs: DataFrame, path: str, to: str, key: str = "doc_id", file_bytes: int = FILE_BYTES, end_id: int = END_ID) -> DataFrame:
    """Write all documents below the folder `to`; the manifest has a row for each file:
    part, file_no, file, n_docs, n_tokens and `start`, the tokens in the files before it."""
    made = cut(frames(docs, path, key, end_id=end_id), "frames")
    size = made.agg(F.sum(F.col("n_tokens") * F.col("width"))).first()[0] or 0
    # equal ids, and null ones, are spread over several ranges by their checksums
    order = [F.col("key").asc_nulls_first(), F.col("checksum"), F.xxhash64(F.monotonically_increasing_id())]
    dealt = made.repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(F.col("key").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, part, no = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            for key_, n_tokens, width, checksum, frame in zip(*(batch.column(c).to_pylist() for c in ("key", "n_tokens", "width", "checksum", "frame")), strict=True):
                if out and out.n_tokens * out.width >= file_bytes:
                    yield out.close()
                    out, no = None, no + 1
                out = out or _File(to, part, no)
                out.add(key_, n_tokens, width, checksum, frame)
        if out:
            yield out.close()

    files = cut(dealt.mapInArrow(run, "part int, file_no int, file string, n_docs long, n_tokens long"), "manifest")
    discard(made)
    return running(files, ["part", "file_no"], "n_tokens", "start")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _File:
    """One file while it is written."""

    def __init__(self, folder: str, part: int, no: int):
        import uuid

        self.fs, self.folder = _store(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.no, self.name = part, no, f"tokens-{part:07d}-{no:04d}.zst"
        self.own = f"{self.folder}/_{self.name}.{uuid.uuid4().hex}"
        self.to = self.fs.open_output_stream(self.own)
        self.keys, self.table, self.n_tokens = [], [], 0

    def add(self, key: int | None, n_tokens: int, width: int, checksum: int, frame: bytes) -> None:
        self.to.write(frame)
        self.keys.append(key)
        self.table.append(struct.pack("<III", len(frame), n_tokens * width, checksum))
        self.n_tokens += n_tokens
        self.width = width

    def close(self) -> pa.RecordBatch:
        index = struct.pack("<IQ", self.width, len(self.keys)) + np.array([k or 0 for k in self.keys], "<i8").tobytes() + bytes(k is None for k in self.keys)
        self.to.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.to.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.to.close()
        self.fs.move(self.own, f"{self.folder}/{self.name}")
        return pa.RecordBatch.from_pydict({"part": pa.array([self.part], pa.int32()), "file_no": pa.array([self.no], pa.int32()), "file": pa.array([self.name]), "n_docs": pa.array([len(self.keys)], pa.int64()), "n_tokens": pa.array([self.n_tokens], pa.int64())})


class Reader:
    """Reads single documents of one file."""

    def __init__(self, folder: str, name: str):
        import zstandard

        store, at = _store(folder)
        self.f = store.open_input_file(f"{at}/{name}")
        end = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self.f.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError(f"{name}: no seek table with checksums")
        table = np.frombuffer(self.f.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.plain, self.sums = table.T
        self.starts = np.cumsum(self.sizes) - self.sizes
        past = int(self.sizes.sum())
        magic, size = struct.unpack("<II", self.f.read_at(8, past))
        index = self.f.read_at(size, past + 8)
        self.width, m = struct.unpack_from("<IQ", index)
        if magic != SKIPPABLE_INDEX or m != n:
            raise ValueError(f"{name}: broken index")
        self.keys = [None if x else int(k) for k, x in zip(np.frombuffer(index, "<i8", n, 12), index[12 + 8 * n :], strict=True)]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only its own frame is read."""
        raw = self.unpack(self.f.read_at(int(self.sizes[i]), int(self.starts[i])), max_output_size=int(self.plain[i]))
        if len(raw) != self.plain[i] or _xxh64(raw) != self.sums[i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype(np.uint32)

    def find(self, key: int) -> Iterator[np.ndarray]:
        """The documents with this id."""
        return (self.ids(i) for i, k in enumerate(self.keys) if k == key)


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the files: key, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                r = Reader(folder, name)
                n, crc = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
                for i in range(len(r)):
                    ids = r.ids(i)
                    n[i], crc[i] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(r.keys, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc)], names=["key", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    return files.repartition(max(1, min(files.count(), 20_000)), "file").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(spark: SparkSession, docs: DataFrame, path: str, to: str | None = None) -> DataFrame:
    """Write and read back; a row for each document."""
    to = to or scratch(spark, "tokens")
    return read_back(write(docs, path, to), to)
