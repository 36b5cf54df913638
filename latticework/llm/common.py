"""Byte-balanced batches and vectorised word hashing used by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import ship

STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
UNDO = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def balanced(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer text stands alone."""
    if not len(texts):
        return
    size = np.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], np.int64)
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield start, i
            start = i
            total = 0
        total += n
    yield start, len(size)


def give_back() -> None:
    """Hands memory that was freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, a function over batches, that gives freed memory back when it ends.

    Idle Python workers stay alive for the stages that follow, each with what its allocator has kept.
    """

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, b in (("up", BASE), ("down", UNDO)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Spans:
    """Hashes of any byte spans of a batch of texts laid end to end, one blank after each."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        up, self.down = powers(len(self.buf) + 1)
        self.sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.buf] * up[: len(self.buf)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * STEP)

    def words(self, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of the runs of bytes that are not in `apart`."""
        inside = np.zeros(len(self.buf) + 1, bool)
        inside[1:] = ~apart[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.begin, starts, "right") - 1


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, and the document number of each; shorter texts are one shingle, those without words none."""
    spans = Spans(texts)
    starts, ends, doc = spans.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = spans.hashes(starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = len(word)
    whole = np.flatnonzero(np.arange(n) - first[doc] + width <= count[doc])
    out = np.zeros(len(whole), np.uint64)
    for k in range(width):
        out = mix(out + word[whole + k] * np.uint64(2 * k + 3))
    short = np.flatnonzero((count > 0) & (count < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        at = np.where(has, first[short] + k, 0)
        few = np.where(has, mix(few + word[at] * np.uint64(2 * k + 3)), few)
    hashes, owner = np.concatenate([out, mix(few + np.uint64(1))]), np.concatenate([doc[whole], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]
