"""Near-duplicates by SimHash with a Gray-order hierarchical index.

Two fingerprints that differ in at most ``d`` of 64 bits agree in at least ``m - d``
of ``m`` bit blocks. Fingerprints are dealt by those shared blocks, so every
link meets in a bucket, and the number of blocks follows the number of distinct
fingerprints, so buckets stay small. Inside a bucket they are sorted by Gray rank;
runs of neighbours become leaves, leaves become upper nodes, and each node keeps the
bits that all its members share and its parent does not yet have. A probe adds up the
differences on the way down and drops whole groups once they exceed ``d``.
A bucket returns a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import stored, text_blocks
from docweave.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BUCKET = 64
CHUNK = 2048
LEAF, FAN = 32, 8
#: Rows up to which a table goes to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles; a bit is set when it is in over half the hashes."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    hashes = np.array(
        [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64
    )
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_blocks(batch.column("text")):
            data = buf.tobytes()
            found = [fingerprint(data[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    batch.column("key").slice(lo, hi - lo),
                    pa.array(np.array(found, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "key", "fp"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as a struct) and ``key``, a hash of doc_id and text that tells rows apart."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), F.xxhash64("doc_id", "text").alias("key"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, key, fp`` (the 64 bits as a long) per row of ``docs(doc_id, text)``; null text: zero."""
    rows = _keyed(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "key", F.col("row.text").cast("string").alias("text")
    )
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, key long, fp long")


def gray_rank(bits: Column) -> Column:
    """Place of a code word in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def _layout(n: int, max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """Bit blocks ``(shift, width)`` and how many of them a bucket key joins."""
    for m in range(max_bits + 1, 2 * max_bits + 1):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
        joined = m - max_bits
        if n >> (joined * min(w for _, w in blocks)) < BUCKET:
            break
    return blocks, joined


def _buckets(distinct: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Each fingerprint once per choice of joined blocks, with its bucket key."""
    blocks, joined = _layout(n, max_bits)
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks]
    keys = []
    for number, chosen in enumerate(combinations(range(len(blocks)), joined)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, blocks[i][1]).bitwiseOR(part[i])
        keys.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
    assert len(keys) == comb(len(blocks), joined)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.choice", "b.key")


class _Labels:
    """Smallest linked row of each row, updated by arrays of links."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; levels run from leaves up."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        both, any_, size = fps, fps, LEAF
        while True:
            cuts = np.arange(0, len(both), size)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            self.levels.append((both, ~(both ^ any_)))  # pattern, mask of shared bits
            size = FAN
            if len(both) <= FAN:
                break

    def probe(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf entries ``(query, leaf)`` that may hold a match.

        The differences of a query to a node are those of the parent plus those on
        the bits that the node shares beyond its parent.
        """
        pattern, mask = self.levels[-1]
        query = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        total = np.bitwise_count((queries[query] ^ pattern[node]) & mask[node]).astype(np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            near = total <= max_bits
            query, node, total = query[near], node[near], total[near]
            if depth == 0:
                break
            above = self.levels[depth][1]
            pattern, mask = self.levels[depth - 1]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = child < len(pattern)
            child = child[inside]
            query, total = np.repeat(query, FAN)[inside], np.repeat(total, FAN)[inside]
            own = mask[child] & ~above[child // FAN]
            total = total + np.bitwise_count((queries[query] ^ pattern[child]) & own).astype(np.int16)
            node = child
        return query, node

    def link(self, labels: _Labels, base: int, max_bits: int) -> None:
        """Link all entries that differ in at most ``max_bits``; leaves already in one group are skipped."""
        n = len(self.fps)
        for lo in range(0, n, 256):
            rows = np.arange(lo, min(lo + 256, n))
            query, leaf = self.probe(self.fps[rows], max_bits)
            later = (leaf + 1) * LEAF > lo
            query, leaf = query[later], leaf[later]
            cuts = np.arange(0, n, LEAF)
            own = labels.of[base : base + n]
            low, high = np.minimum.reduceat(own, cuts), np.maximum.reduceat(own, cuts)
            settled = (low[leaf] == high[leaf]) & (low[leaf] == own[rows[query]])
            query, leaf = query[~settled], leaf[~settled]
            for at in range(0, len(query), 1 << 14):
                q, e = rows[query[at : at + (1 << 14)]], leaf[at : at + (1 << 14)]
                entry = np.minimum(e[:, None] * LEAF + np.arange(LEAF), n - 1)
                i, j = np.nonzero(np.bitwise_count(self.fps[q][:, None] ^ self.fps[entry]) <= max_bits)
                labels.link(base + q[i], base + entry[i, j])


def _forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest per bucket; rows come sorted by bucket and Gray rank."""
    labels = _Labels(len(fps))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(fps)))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero(size <= BUCKET)
    number, few = np.repeat(np.arange(len(starts)), sizes)[small], fps[small]
    for step in range(1, min(BUCKET, int(sizes.max(initial=0)))):  # within a leaf, neighbours at each distance
        if step >= len(few):
            break
        near = (number[step:] == number[:-step]) & (np.bitwise_count(few[step:] ^ few[:-step]) <= max_bits)
        hit = np.flatnonzero(near)
        labels.link(small[hit], small[hit + step])
    for start, n in zip(starts[sizes > BUCKET].tolist(), sizes[sizes > BUCKET].tolist()):
        GrayIndex(fps[start : start + n]).link(labels, start, max_bits)
    moved = np.flatnonzero(labels.of != np.arange(len(fps)))
    return fps[moved], fps[labels.of[moved]]


def _bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of one sorted partition; a bucket that a batch cuts is carried over."""
    names = ["choice", "key", "i", "j"]
    keys, held = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        same = (k[1:] == k[:-1]).all(axis=1)
        a, b = _forest(np.cumsum(np.append(0, ~same)) if len(k) else np.zeros(0), f, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
        keys = np.concatenate([keys, new])
        held = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
        cut = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
        if cut:
            yield out(keys[:cut], held[:cut])
            keys, held = keys[cut:], held[cut:]
    if len(held):
        yield out(keys, held)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits.

    A bucket of more than ``CHUNK`` members is cut into chunks by hash, and every pair of
    its chunks is a bucket of its own: exact, and no task gets a larger share.
    ``distinct`` is read several times, so give a stored table.
    """
    n = distinct.count()
    rows = stored(_buckets(distinct, n, max_bits), "buckets")
    counts = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    large = counts.select("choice", "key", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks"))
    # a large bucket holds over CHUNK of the rows, so there are few beside the rows themselves
    sized = rows.join(stored(large, "large"), ["choice", "key"], "left")
    mine = F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("chunks"))).otherwise(F.lit(0))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)
    pairs = sized.withColumn("mine", mine).withColumn("other", F.explode(others))
    dealt = pairs.select(
        "choice",
        "key",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        "fp",
        gray_rank(F.col("fp")).alias("gray"),
    )
    dealt = dealt.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j", "gray")
    return dealt.mapInArrow(lambda it: _bucket_links(it, max_bits), "a long, b long")


def _labelled(marked: DataFrame, max_bits: int) -> DataFrame:
    """Stored fingerprints with ``first``: doc_id and key of the first row of the component."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = stored(marked.groupBy("fp").agg(F.min(place).alias("first")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left")
    rooted = stored(rooted.select("fp", F.col("first").alias("own"), F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return marked.join(rooted.join(first, "root").select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs(doc_id, text)``.

    The component is the smallest doc_id reachable over links of fingerprints. Equal
    fingerprints are one node, however many rows have them. A null, empty or blank
    text has fingerprint zero and is linked like any other. Null doc_ids keep their row
    and are ignored for the minimum. An empty table gives no rows.
    """
    labelled = _labelled(stored(fingerprints(docs, shingle), "fingerprints"), max_bits)
    return labelled.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component, the one with the smallest doc_id; all columns stay.

    A null doc_id counts as larger than any other. Rows that are equal in doc_id and
    text are one document, of which one row stays.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    lost = stored(_labelled(marked, max_bits).where("key <> first.key").select("key").distinct(), "lost")
    twice = stored(marked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "twice")
    few = lost.count() <= BROADCAST_ROWS
    kept = _keyed(docs).join(F.broadcast(lost) if few else lost, "key", "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, "key", "left_anti")
        kept = once.unionAll(kept.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")
