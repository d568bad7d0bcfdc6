"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Tokens never leave the task that makes them: a first pass turns each text into
pieces (length and checksum), and only these small rows are packed. Pieces are
dealt into shards of bounded size. Every shard packs on its own: a piece goes to
the residual gap that makes the sum of squared counts of open sequences per gap
smallest. Part-filled sequences of all shards are then packed once more as whole
items, so that the waste per shard does not add up.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import SPACE, stored, text_blocks, word_bounds, word_hashes

CAPACITY = 4096
SHARD_PIECES = 8192
END_ID = 1
CACHE_WORDS = 1 << 21
TEXT_BLOCK = 1 << 22
#: Unknown words that go to the tokenizer as one string.
JOINED_WORDS = 512

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _row long"


class WordIds:
    """Token ids per white-space separated word, cached by the word's 64-bit hash.

    The tokenizer removes white space before it merges, so the ids of a text are
    the ids of its words in a row. Each distinct word is encoded once per worker
    process, whose tasks share one cache; a full cache is emptied, so memory stays bounded.
    Known words are two sorted runs: new ones enter the short run, which now and then
    joins the long one.
    """

    _of_process: dict[str, WordIds] = {}

    @classmethod
    def shared(cls, path: str) -> WordIds:
        if path not in cls._of_process:
            cls._of_process[path] = cls(path)
        return cls._of_process[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.runs = [empty, empty]
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.runs)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row and their number per word, told apart by offsets in joined strings."""
        parts = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        flat, sizes = [], []
        for part in parts:
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            first = np.fromiter(map(itemgetter(0), found.offsets), np.int64)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            sizes.append(np.bincount(np.searchsorted(ends, first, "right"), minlength=len(part)))
            flat.append(np.array(found.ids, np.uint32))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words by their hashes; ``keys`` is sorted."""
        ids, sizes = self._ids(words)
        slots = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(keys))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        long, short = self.runs[0], _merged(*self.runs[1], keys, slots)
        if 8 * len(short[0]) > len(long[0]) + (1 << 16):
            long, short = _merged(*long, *short), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.runs = [long, short]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = known[at] == keys
                out[there] = slots[at[there]]
        return out

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids per word."""
        hashes = word_hashes(buf, starts, ends)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(uniq)
        new = slots < 0
        if new.any():
            if len(self) + int(new.sum()) > CACHE_WORDS:
                self.clear()
                new[:] = True
            at = first[new]
            data = buf.tobytes()
            self._learn(uniq[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slots = self._slots(uniq)
        slots = slots[inverse]
        begin, count = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        ahead = np.concatenate([[0], np.cumsum(count)])
        index = np.arange(int(ahead[-1])) + np.repeat(begin - ahead[:-1], count)
        return self.flat[index], count


def _merged(keys: np.ndarray, slots: np.ndarray, more: np.ndarray, more_slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(slots, at, more_slots)


def _pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    words = WordIds.shared(path)
    for batch in batches:
        doc_ids, rows = batch.column("doc_id"), batch.column("_row")
        for lo, hi, buf, offsets in text_blocks(batch.column("text"), TEXT_BLOCK):
            starts, ends, word_offsets = word_bounds(buf, offsets, ~SPACE)
            flat, count = words.encode(buf, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            bounds = np.concatenate([[0], np.cumsum(count)])[word_offsets]
            out: list[tuple[int, int, int, int, int]] = []
            for i in range(hi - lo):
                ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                for p, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((i, p, start, len(part), zlib.crc32(part.tobytes())))
            index, piece, start, length, crc = map(list, zip(*out))
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(lo, hi - lo).take(at),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    rows.slice(lo, hi - lo).take(at),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_row"],
            )


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids per row of ``docs(doc_id, text)``; the end id counts.

    A null text is empty and gives one piece that holds the end id alone. Rows with
    the same or a null ``doc_id`` stay separate documents; ``_row`` tells them apart.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return rows.mapInArrow(lambda it: _pieces_of(it, tokenizer_path, capacity), _PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each size, in the order given.

    ``open[g]`` counts open sequences with residual gap ``g``. Moving one sequence
    from gap ``g`` to ``g - s`` changes the sum of squares by ``2 * (open[g - s] -
    open[g]) + 2``; a new sequence adds ``2 * open[capacity - s] + 1``. Full
    sequences do not count. Ties go to the smallest gap, and to an open sequence.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        best_gap = capacity
        best = 2 * int(open_[capacity - s]) + 1 if s < capacity else 0
        if used:
            left = open_[s:capacity]
            gaps = np.flatnonzero(left)
            if len(gaps):
                cost = 2 * (open_[gaps] - left[gaps]) + 2
                if gaps[0] == 0:  # an exact fit closes the sequence
                    cost[0] = 1 - 2 * int(left[0])
                j = int(np.argmin(cost))
                if cost[j] <= best:
                    best_gap = int(gaps[j]) + s
        if best_gap == capacity:
            number, used = used, used + 1
        else:
            number = stacks[best_gap].pop()
            open_[best_gap] -= 1
        bins[i], offsets[i] = number, capacity - best_gap
        rest = best_gap - s
        if rest:
            stacks[rest].append(number)
            open_[rest] += 1
    return bins, offsets


def _pack_shard(capacity: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(items["size"].to_numpy(), capacity)
        return pd.DataFrame(
            {"item": items["item"].to_numpy(), "shard": items["shard"].to_numpy(), "bin": bins, "offset": offsets, "size": items["size"].to_numpy()}
        )

    return pack


def _pack_items(items: DataFrame, capacity: int, shard_pieces: int) -> DataFrame:
    """Pack ``items(item, size)`` in shards of about ``shard_pieces``."""
    shards = max(1, -(-items.count() // shard_pieces))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        _pack_shard(capacity), "item long, shard long, bin long, offset long, size long"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``.

    ``pieces`` has ``length`` between 1 and ``capacity`` and is read several times, so
    give a stored table. Sequences filled less than 31/32 after the first round
    are items of the second one; each keeps its pieces in place.
    """
    items = pieces.withColumn("item", F.monotonically_increasing_id())
    items = stored(items, "pieces")
    first = stored(_pack_items(items.select("item", F.col("length").alias("size")), capacity, shard_pieces), "packed")
    key = F.col("shard") * F.lit(1 << 31) + F.col("bin")
    fills = first.groupBy(key.alias("first_bin")).agg(F.sum("size").alias("size"))
    loose = stored(fills.where(F.col("size") * 32 < F.lit(31 * capacity)), "loose")
    second = _pack_items(loose.select(F.col("first_bin").alias("item"), "size"), capacity, shard_pieces)
    moved = second.select(
        F.col("item").alias("first_bin"),
        (-1 - (F.col("shard") * F.lit(1 << 31) + F.col("bin"))).alias("new_bin"),
        F.col("offset").alias("shift"),
    )
    placed = first.select("item", key.alias("first_bin"), "offset").join(moved, "first_bin", "left")
    placed = placed.select(
        "item",
        F.coalesce("new_bin", "first_bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    return items.join(placed, "item").drop("item", "_row")


def best_fit_pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. An
    empty table gives no rows. Only documents longer than ``capacity`` are cut.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity, shard_pieces)
