"""Vectorised word work on Arrow text batches, for use inside tasks.

Texts are handled as UTF-8 bytes, a bounded slice of a batch at a time (one
text longer than a slice is a slice of its own). Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
STEP = [int(x) | 1 for x in _RNG.integers(0, 2**64, 64, dtype=np.uint64)]
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 2**64)

LOWER = np.arange(256)
LOWER[65:91] += 32

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ASCII_BREAKS = np.zeros(256, bool)  # all ASCII but digits and letters
ASCII_BREAKS[:128] = True
ASCII_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of the hash base and its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one entry more than texts)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have ``limit`` bytes at most, or single rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of a slice: text number, byte range and 64-bit hash of each.

    Words are the maximal runs of bytes that ``breaks`` doesn't mark; with
    ``lower`` the hash takes A-Z as a-z.
    """

    def __init__(self, column: pa.Array, breaks: np.ndarray = SPACES, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        self.texts = len(column)
        n = len(self.data)
        byte = self.data.astype(np.intp)  # looked up twice; numpy would make it anew each time
        gap = np.ones(n + 2, bool)  # of the byte before, and a break at either end
        gap[1:-1] = breaks[byte]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts = np.flatnonzero(~gap[1:-1] & (edge[:-1] | gap[:-2]))
        ends = np.flatnonzero(~gap[1:-1] & (edge[1:] | gap[2:])) + 1
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, self.offsets)  # of each text, one more entry at the end
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.texts), self.counts)
        up, down = POWERS.upto(n + 1)
        values = (BYTE[LOWER] if lower else BYTE)[byte]
        values *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        self.hashes = mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the word number each begins at."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h += self.hashes[at + i] * np.uint64(STEP[i])
        return mix(h), at

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of all words that have as many, and the words' numbers."""
        at = np.flatnonzero(self.ends - self.starts >= size)
        start = self.starts[at]
        return mix((self.sums[start + size] - self.sums[start]) * POWERS.down[start] + np.uint64(size << 32)), at

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches of this session hold 8 MB at most, if they may hold more.

    Texts can be long, and both sides of every running task hold a batch.
    """
    conf = df.sparkSession.conf
    held = (conf.get(BATCH_BYTES, None) or "67108864b").removesuffix("b")
    if held.isdigit() and int(held) > BATCH_LIMIT:
        conf.set(BATCH_BYTES, str(BATCH_LIMIT))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text", limit: int = SLICE) -> DataFrame:
    """``fn`` gives the output columns of a slice of ``limit`` bytes; rows need not match the input's."""
    small_batches(df)

    def run(batches):
        for part in slices(batches, text, limit):
            yield pa.RecordBatch.from_pydict(fn(part))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
