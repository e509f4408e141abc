"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running  # noqa: F401
from ..session import discard, kept, shared_dir  # noqa: F401

#: A word is a run of anything but the ASCII space characters (fixed by the task's contracts).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/rayloom/{name}-{uuid.uuid4().hex}"


#: Write a table to the shared folder and read it back: the lineage ends there.
cut = kept


def words(text: Column) -> Column:
    """The words of a text, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, giving freed memory back at its end: Python workers are kept for
    later tasks, beside an executor whose memory they share."""

    def tidied(parts: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(parts)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def slices(column, chars: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of an Arrow column of strings with about so many bytes each; one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars)))
        yield lo, hi
        lo = hi


class WordHashes:
    """The 64-bit hashes of the words of texts, one after the other. Words that were seen are
    remembered until `most` of them are held."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code, self.hashes = defaultdict(count().__next__), np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        for t in texts:
            # bytes: split() knows the ASCII spaces only
            held.append(np.fromiter(map(self.code.__getitem__, t.split()), np.int64))
            if len(self.code) > len(self.hashes) + 50_000:
                yield from self.known(held)
                held = []
        yield from self.known(held)

    def known(self, held: list[np.ndarray]) -> Iterator[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        if len(self.code) > len(self.hashes):
            new = list(islice(self.code, len(self.hashes), None))
            self.hashes = np.r_[self.hashes, np.fromiter(map(xxh3_64_intdigest, new), np.uint64, len(new))]
        hashes = self.hashes
        if len(self.code) > self.most:
            self.clear()
        for codes in held:
            yield hashes[codes]
