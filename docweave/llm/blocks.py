"""Byte-level word tables of Arrow text columns, and tables stored between jobs.

The helpers cut a batch of texts into blocks of whole documents, find words by a
table over bytes and give every word a 64-bit polynomial hash. They run inside
tasks; memory is bounded by the block size or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.session import work_path

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later jobs do not repeat its work."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, end row, bytes, offsets)`` of whole texts; a null text is empty.

    A block holds at most ``limit`` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one entry more than texts)."""
    if buf.size == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = is_word[buf]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    heads = offsets[:-1][offsets[:-1] < buf.size]
    first[heads] = mask[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = mask[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = _powers(_BASE, size), _powers(inverse, size)
        return self.up[:n], self.down[:n]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:
        step = np.uint64(pow(base, have, 1 << 64))
        out[have : 2 * have] = out[:have][: size - have] * step
        have *= 2
    return out


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums; long inputs go in parts cut between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        up, down = _POWERS.get(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTES[buf[base:top]] * up[:-1], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each ``n`` consecutive word hashes; ``len(words) - n + 1`` values."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def windows_inside(word_offsets: np.ndarray, total: int, n: int) -> np.ndarray:
    """True for window starts whose ``n`` words belong to one text."""
    count = total - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(total + 1, np.int32)
    lengths = np.diff(word_offsets)
    a = word_offsets[:-1][lengths >= n]
    np.add.at(ok, a, 1)
    np.add.at(ok, a + lengths[lengths >= n] - n + 1, -1)
    return np.cumsum(ok[:-1])[:count] > 0


def char_starts(buf: np.ndarray) -> np.ndarray:
    """True for bytes that begin a code point."""
    return (buf & 0xC0) != 0x80
