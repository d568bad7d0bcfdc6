"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: every row is one index shard, the postings
of a bounded run of whole documents. A shard keeps its terms (64-bit word hashes)
sorted, and per term the delta-coded word positions. It is built where the documents
are read and stored once; no posting is shuffled. A phrase search opens every
shard, starts from the rarest term of each phrase there, and intersects the other
terms' lists after subtracting their offsets in the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from docweave.llm.blocks import LOWER, stored, text_blocks, word_bounds, word_hashes
from docweave.session import work_path

WINDOW = 13
QUERY_BYTES = 8 << 20
#: Rows up to which a table goes to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[0x30:0x3A] = True
TERM_BYTE[0x61:0x7B] = True
TERM_BYTE[0x80:] = True

_INDEX = (
    "shard long, doc_ids array<long>, keys array<long>, first_word array<int>, terms binary, term_first binary, postings binary"
)
_HITS = "shard long, doc int, starts array<int>, ends array<int>, items array<string>"


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, end row, term hashes, first term of each row)``."""
    for lo, hi, buf, offsets in text_blocks(column):
        folded = LOWER[buf]
        starts, ends, word_offsets = word_bounds(folded, offsets, TERM_BYTE)
        yield lo, hi, word_hashes(folded, starts, ends), word_offsets


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, hashes, word_offsets in terms_of(batch.column("text")):
            order = np.argsort(hashes, kind="stable")
            terms, first = np.unique(hashes[order], return_index=True)
            deltas = np.diff(order, prepend=0)
            deltas[first] = order[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([batch.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("key").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([word_offsets.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms.astype("<u8").tobytes()], pa.binary()),
                    pa.array([first.astype("<u4").tobytes()], pa.binary()),
                    pa.array([deltas.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["shard", "doc_ids", "keys", "first_word", "terms", "term_first", "postings"],
            )
            number += 1


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


class PositionalIndex(NamedTuple):
    """A stored index; ``shards`` has one row per run of documents."""

    shards: DataFrame

    @staticmethod
    def build(docs: DataFrame, path: str | None = None) -> PositionalIndex:
        """Index every word of ``docs(doc_id, text)``; a null text has no words."""
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias("key")
        )
        path = path or work_path(docs.sparkSession, "positions")
        rows.mapInArrow(_index_shards, _INDEX).write.option("compression", "zstd").parquet(path)
        return PositionalIndex.read(docs, path)

    @staticmethod
    def read(like: DataFrame, path: str) -> PositionalIndex:
        return PositionalIndex(like.sparkSession.read.schema(_INDEX).parquet(path))

    def documents(self) -> DataFrame:
        """Directory: shard, doc (place in the shard), doc_id, key (hash of doc_id and text), n_words."""
        listed = self.shards.select("shard", "first_word", "keys", F.posexplode("doc_ids").alias("doc", "doc_id"))
        n_words = F.get("first_word", F.col("doc") + 1) - F.get("first_word", F.col("doc"))
        return listed.select(
            "shard", "doc", "doc_id", F.get("keys", F.col("doc")).alias("key"), n_words.cast("long").alias("n_words")
        )


class _Shard:
    """Postings of one index row, opened term by term."""

    def __init__(self, first_word: np.ndarray, terms: bytes, term_first: bytes, postings: bytes) -> None:
        self.first_word = first_word
        self.terms = np.frombuffer(terms, "<u8")
        self.deltas = np.frombuffer(postings, "<u4")
        self.bounds = np.append(np.frombuffer(term_first, "<u4"), len(self.deltas)).astype(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted term in this shard, or -1."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def counts(self, places: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(places.shape, np.int64)
        return np.where(places >= 0, self.bounds[places + 1] - self.bounds[places], 0)

    def list_of(self, place: int) -> np.ndarray:
        return np.cumsum(self.deltas[self.bounds[place] : self.bounds[place + 1]], dtype=np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, positions, "right") - 1


class _Phrases(NamedTuple):
    """Distinct phrases of a query block as rows of term numbers (-1: none), and the items of each."""

    terms: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[list[str | None]]

    @staticmethod
    def of(rows: list[tuple[str | None, str]], window: int | None) -> _Phrases:
        found: dict[tuple[int, ...], set[str | None]] = {}
        for lo, _, hashes, offsets in terms_of(pa.array([t for _, t in rows], pa.string())):
            for i in range(len(offsets) - 1):
                words = hashes[offsets[i] : offsets[i + 1]]
                size = len(words) if window is None else min(window, len(words))
                if size:
                    for row in np.lib.stride_tricks.sliding_window_view(words, size):
                        found.setdefault(tuple(row.tolist()), set()).add(rows[lo + i][0])
        keys = list(found)
        lengths = np.array([len(k) for k in keys], np.int64)
        flat = np.array([x for k in keys for x in k], np.uint64)
        terms, inverse = np.unique(flat, return_inverse=True)
        phrases = np.full((len(keys), int(lengths.max()) if keys else 0), -1, np.int64)
        phrases[np.arange(phrases.shape[1]) < lengths[:, None]] = inverse
        return _Phrases(terms, phrases, lengths, [list(found[k]) for k in keys])


def _exact(shard: _Shard, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a phrase: the rarest list, less its offset, met with each other list less its own."""
    order = np.argsort(counts, kind="stable")
    begin = shard.list_of(places[order[0]]) - order[0]
    for k in order[1:]:
        if not len(begin):
            break
        other = shard.list_of(places[k])
        at = np.minimum(np.searchsorted(other, begin + k), len(other) - 1)
        begin = begin[other[at] == begin + k]
    begin = begin[begin >= 0]
    return begin, begin + len(places)


def _near(shard: _Shard, places: np.ndarray, counts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans where every term lies within ``slop`` words of its place relative to the rarest term, in the same document."""
    order = np.argsort(counts, kind="stable")
    anchor = shard.list_of(places[order[0]])
    low, high = anchor.copy(), anchor.copy()
    for k in order[1:]:
        other = shard.list_of(places[k])
        want = anchor + (k - order[0])
        doc = shard.doc_of(anchor)
        first, end = shard.first_word[doc], shard.first_word[doc + 1]
        at = np.searchsorted(other, np.clip(want, first, end - 1))
        left, right = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
        has_left, has_right = (at > 0) & (left >= first), (at < len(other)) & (right < end)
        nearest = np.where(has_left & (~has_right | (np.abs(left - want) <= np.abs(right - want))), left, right)
        keep = (np.abs(nearest - want) <= slop) & (has_left | has_right)
        anchor, low, high, nearest = anchor[keep], low[keep], high[keep], nearest[keep]
        low, high = np.minimum(low, nearest), np.maximum(high, nearest)
    return low, high + 1


def _search(batches: Iterator[pa.RecordBatch], query, slop: int) -> Iterator[pa.RecordBatch]:
    phrases: _Phrases = query.value
    rows = np.arange(len(phrases.lengths))
    for batch in batches:
        for row in range(batch.num_rows):
            shard = _Shard(
                np.asarray(batch.column("first_word")[row].as_py(), np.int64),
                *(batch.column(c)[row].as_py() for c in ("terms", "term_first", "postings")),
            )
            places = np.append(shard.places(phrases.terms), -1)[phrases.phrases]
            counts = shard.counts(places)
            used = phrases.phrases >= 0
            found: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
            for p in rows[((counts > 0) | ~used).all(axis=1)]:
                n = phrases.lengths[p]
                low, high = (_near(shard, places[p, :n], counts[p, :n], slop) if slop else _exact(shard, places[p, :n], counts[p, :n]))
                doc = shard.doc_of(low)
                inside = high <= shard.first_word[doc + 1]
                for d, a, b in zip(doc[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
                    spans, items = found.setdefault(d, ([], set()))
                    spans.append((a - int(shard.first_word[d]), b - int(shard.first_word[d])))
                    items.update(phrases.items[p])
            if found:
                docs = sorted(found)
                merged = [_union(found[d][0]) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("shard")[row].as_py()] * len(docs), pa.int64()),
                        pa.array(docs, pa.int32()),
                        pa.array([[a for a, _ in m] for m in merged], pa.list_(pa.int32())),
                        pa.array([[b for _, b in m] for m in merged], pa.list_(pa.int32())),
                        pa.array([sorted(found[d][1], key=lambda x: (x is None, x or "")) for d in docs], pa.list_(pa.string())),
                    ],
                    names=["shard", "doc", "starts", "ends", "items"],
                )


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: PositionalIndex, items: DataFrame, window: int | None = WINDOW, slop: int = 0) -> DataFrame:
    """Occurrences of the phrases of ``items(item_id, text)``: one row per document hit and query block.

    ``window`` cuts an item into all runs of so many words (shorter items are one
    phrase); None searches whole items. ``slop`` above 0 accepts proximity matches:
    every word within ``slop`` of its place. Items without words match nothing;
    those with a null item_id stand last in ``items``, as one null. The query set is sent to the shards in blocks of
    ``QUERY_BYTES`` text, so a broadcast never grows with the item table; equal
    rows count once.
    """
    spark = items.sparkSession
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.where("text IS NOT NULL").distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-int(total) // QUERY_BYTES))
    out = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        query = spark.sparkContext.broadcast(_Phrases.of([tuple(r) for r in mine.collect()], window))
        hits = index.shards.drop("doc_ids", "keys").mapInArrow(lambda it, q=query: _search(it, q, slop), _HITS)
        out = hits if out is None else out.unionAll(hits)
    return out


def covered(spans: Column) -> Column:
    """Words inside the union of an array of ``struct<a, b>`` spans."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
    )
    return step["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, key, n_words, n_hit, items (sorted), n_items, contaminated.

    Items with a null item_id hit words like all others; they are not named in ``items``
    and count together as one in n_items. A word is hit inside any occurrence of a window; a document is contaminated when
    at least one word in twenty is hit. Rows with the same or a null doc_id stay
    separate; other columns are ignored; an empty table gives no rows.
    """
    index = PositionalIndex.build(docs)
    spans = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))
    hits = search(index, items, window).select("shard", "doc", "items", spans.alias("spans"))
    hits = hits.groupBy("shard", "doc").agg(
        covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        index.documents()
        .join(stored(hits, "hits"), ["shard", "doc"], "left")
        .select(
            "doc_id",
            "key",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.array_compact("items"), F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        )
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    bad = stored(contamination(docs, items, window).where("contaminated").select("key").distinct(), "contaminated")
    few = bad.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))
    return rows.join(F.broadcast(bad) if few else bad, "key", "left_anti").select("row.*")
