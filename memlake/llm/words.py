"""Words of whole texts as numpy arrays, over the UTF-8 bytes of Arrow batches.

A word is a run of bytes other than space and 9-13; those bytes never occur inside a longer UTF-8 character, so working on bytes
gives the same words as working on characters.  Texts are handled in slices of about ``SLICE`` bytes, so that memory stays bounded
by the slice and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.worker import keep, kept

SLICE = 1 << 20
BATCH_ROWS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240501).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(_BASE))[0]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers = kept("powers", lambda: (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(powers[0]) < n:
        size = 1 << (n - 1).bit_length()

        def table(factor: int) -> np.ndarray:
            out = np.full(size, factor, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        powers = keep("powers", (table(_BASE), table(_INVERSE)))
    return powers[0][:n], powers[1][:n]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session sends rows to Python in batches of at most BATCH_ROWS, so that neither side holds thousands of long texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: Python copies of texts exist for one such batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(raws: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes, one text at least."""
    lo, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(raw) + 1
    if lo < len(raws):
        yield lo, len(raws)


class Words:
    """Words of several texts: ``start``, ``end`` (byte positions in ``buffer``), ``doc`` (which text) and ``id`` (64-bit hash)."""

    def __init__(self, raws: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        self.space = _SPACE[self.buffer]
        before = np.empty_like(self.space)
        before[0] = True
        before[1:] = self.space[:-1]
        self.start = np.flatnonzero(before & ~self.space)
        self.end = np.flatnonzero(self.space & ~before)
        self.n_docs = len(raws)
        self.doc_end = np.cumsum([len(r) + 1 for r in raws]) if raws else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.doc_end, self.start, side="right")
        powers, inverse = _power_table(len(self.buffer) + 1)
        total = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum(_LETTER[self.buffer] * powers[:-1], out=total[1:])
        self.id = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def per_doc(self, mask: np.ndarray | None = None) -> np.ndarray:
        """Number of words (that ``mask`` selects) in each text."""
        return np.bincount(self.doc if mask is None else self.doc[mask], minlength=self.n_docs)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one text."""
        n = len(self.id) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
        value = np.zeros(len(first), np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(_BASE) + self.id[first + k])
        return first, value
