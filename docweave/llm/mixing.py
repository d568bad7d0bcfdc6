"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form one stream: its documents in hash order, cut into blocks
of equal length. A source's target is a number of blocks, its quota. The tree starts
with the vector of all quotas and gives each half of the output shards a share of it,
drawn without replacement, until single shards are reached, so every shard knows its
exact number of blocks per source and which ranks of the source's sequence they have.
A rank stands for a block through a keyed permutation, one per pass over the source;
shards therefore draw disjoint blocks. At last each shard shuffles its own blocks.

Only counts go down the tree. Its first levels are split on the driver, subtrees in
tasks, each node with a generator seeded by its place, so lost tasks draw the same.
Sources are named corpora: the driver holds one row per source, at most ``MAX_SOURCES``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.blocks import SPACE, mix as scramble, stored, text_blocks, word_bounds

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
MAX_SOURCES = 100_000
#: Blocks per source that keep its taken words within a fraction of 1/2000 of the target.
FINE_BLOCKS = 4096
BLOCK_WORDS = 1024
#: All quotas together stay below this: the generator draws from fewer than 10**9 blocks.
MAX_BLOCKS = 1 << 28
SHARD_BLOCKS = 4096
#: Subtrees handed to tasks.
SUBTREES = 256
BUCKET_DOCS = 2_000

_SIZED = "_row long, doc_id long, source string, _hash long, size long"
_DRAWS = "shard long, position long, _ix int, epoch int, block long"


def shares(sizes: Sequence[int], weights: Sequence[int], most: int = MAX_REPEATS) -> list[Fraction]:
    """Targets that add up to all sizes, by weight, none above ``most`` times its size."""
    target = [Fraction(0)] * len(sizes)
    left, rest = sum(sizes), set(range(len(sizes)))
    while rest and left:
        total = sum(weights[i] for i in rest)
        full = {i for i in rest if left * weights[i] > most * sizes[i] * total}
        for i in full or rest:
            target[i] = Fraction(most * sizes[i]) if full else Fraction(left * weights[i], total)
        if not full:
            break
        left -= sum(most * sizes[i] for i in full)
        rest -= full
    return target


def plan(sizes: Sequence[int], weights: Sequence[int], most: int = MAX_REPEATS) -> list[dict]:
    """Per source: target, words per block, blocks and quota (blocks to draw, passes included)."""
    coarse = max(BLOCK_WORDS, -(-most * sum(sizes) // MAX_BLOCKS))
    rows = []
    for size, target in zip(sizes, shares(sizes, weights, most), strict=True):
        words = min(max(1, -(-size // FINE_BLOCKS)), coarse)
        blocks = -(-size // words)
        quota = min(round(target * blocks / size), most * blocks) if size else 0
        rows.append({"size": size, "target": target, "words": words, "blocks": blocks, "quota": quota})
    return rows


def _halves(node: tuple, total: int, shards: int, seed: int) -> tuple[tuple, tuple]:
    """Children of a node ``(first shard, end shard, quotas, first ranks)``."""
    a, b, quotas, firsts = node
    middle = (a + b) // 2
    wanted = total * middle // shards - total * a // shards
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, a, b])))
    left = rng.multivariate_hypergeometric(quotas, wanted, method="marginals")
    return (a, middle, left, firsts), (middle, b, quotas - left, firsts + left)


def split(node: tuple, total: int, shards: int, seed: int, width: int = 1) -> Iterator[tuple]:
    """Nodes of at most ``width`` shards below ``node``, in shard order; their quotas add up to its own."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node[1] - node[0] <= width:
            yield node
        else:
            left, right = _halves(node, total, shards, seed)
            stack += [right, left]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of each index under a keyed permutation of ``0 .. n - 1`` (a Feistel network that walks its cycles)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (scramble(right ^ salt) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _draw(shard: int, quotas: np.ndarray, firsts: np.ndarray, blocks: np.ndarray, seed: int) -> pd.DataFrame:
    """The blocks of one shard in their shuffled order."""
    ix = np.flatnonzero(quotas)
    source = np.repeat(ix, quotas[ix])
    starts = np.cumsum(quotas[ix]) - quotas[ix]
    rank = np.arange(len(source)) - np.repeat(starts, quotas[ix]) + firsts[source]
    epoch = rank // blocks[source]
    block = np.empty(len(source), np.int64)
    for s, lo, n in zip(ix.tolist(), starts.tolist(), quotas[ix].tolist()):
        for e in np.unique(epoch[lo : lo + n]).tolist():
            at = lo + np.flatnonzero(epoch[lo : lo + n] == e)
            block[at] = permuted(rank[at] - e * blocks[s], int(blocks[s]), hash((seed, s, e)))
    order = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1 << 40, shard]))).permutation(len(source))
    return pd.DataFrame({"shard": shard, "position": order, "_ix": source.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block})


def draws(spark, rows: list[dict], seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """All drawn blocks ``(shard, position, _ix, epoch, block)``; ``_ix`` numbers the sources."""
    quotas = np.array([r["quota"] for r in rows], np.int64)
    blocks = np.array([max(1, r["blocks"]) for r in rows], np.int64)
    total = int(quotas.sum())
    shards = max(1, round(total / shard_blocks))
    root = (0, shards, quotas, np.zeros(len(rows), np.int64))
    top = list(split(root, total, shards, seed, -(-shards // SUBTREES))) if total else []
    nodes = [(a, b, q.tolist(), f.tolist()) for a, b, q, f in top]
    frame = spark.createDataFrame(nodes, "a long, b long, quotas array<long>, firsts array<long>")
    shared = spark.sparkContext.broadcast(blocks)  # one number per source

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, q, f in zip(batch["a"], batch["b"], batch["quotas"], batch["firsts"]):
                node = (int(a), int(b), np.asarray(q, np.int64), np.asarray(f, np.int64))
                for shard, _, quota, first in split(node, total, shards, seed):
                    yield _draw(shard, quota, first, shared.value, seed)

    parts = min(len(nodes), max(spark.sparkContext.defaultParallelism, len(nodes) // 4)) or 1
    return frame.repartition(parts).mapInPandas(expand, _DRAWS)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for _, _, buf, offsets in text_blocks(batch.column("text")):
            counts.append(np.diff(word_bounds(buf, offsets, ~SPACE)[2]))
        names = ["_row", "doc_id", "source", "_hash"]
        size = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), size], names=[*names, "size"])


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "source", F.xxhash64("doc_id", "text").alias("_hash"), "text"
    )


def _key(source: Column | str) -> Column:
    """Sources as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


class Mixture:
    """A mix of ``docs(doc_id, text, source)``; see ``mix``."""

    def __init__(self, rows: DataFrame, weights: Sequence[int], most: int, seed: int, shard_blocks: int):
        spark = rows.sparkSession
        sized = stored(rows.mapInArrow(_sizes, _SIZED), "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        found = totals.limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        cycle = [weights[i % len(weights)] for i in range(len(found))]
        self.plan = plan([r["size"] for r in found], cycle, most)
        columns = "source_key string, _ix int, source_size long, target double, _words long"
        names = ["" if r["source"] is None else f"={r['source']}" for r in found]
        sources = [(n, i, p["size"], float(p["target"]), p["words"]) for i, (n, p) in enumerate(zip(names, self.plan))]
        self.sources = spark.createDataFrame(sources, columns)
        keyed = sized.withColumn("source_key", _key("source"))
        self.documents = keyed.join(F.broadcast(self.sources), "source_key").drop("source_key")  # at most MAX_SOURCES rows
        self.buckets = max(1, -(-sum(r["n"] for r in found) // BUCKET_DOCS))
        self.draws = draws(spark, self.plan, seed, shard_blocks)

    def spans(self) -> DataFrame:
        """Each document cut at block borders: ``_row, doc_id, _ix, block, first_word, n_words``.

        A document's start in its source is a sum over whole hash buckets and a running
        sum inside its own, so that no source is ordered in one task.
        """
        rows = self.documents.where("size > 0").withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(self.buckets)))
        sums = rows.groupBy("_ix", "_bucket").agg(F.sum("size").alias("_sum"))
        before = Window.partitionBy("_ix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_ix", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        inner = Window.partitionBy("_ix", "_bucket").orderBy("_hash", "doc_id", "size", "_row")
        start = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        rows = rows.withColumn("_start", start).join(sums, ["_ix", "_bucket"])
        rows = rows.withColumn("_start", F.col("_start") + F.col("_before"))
        cut = rows.select("_row", "doc_id", "_ix", "size", "_start", "_words", F.explode(F.expr("sequence(_start div _words, (_start + size - 1) div _words)")).alias("block"))
        low = F.greatest("_start", F.col("block") * F.col("_words"))
        high = F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * F.col("_words"))
        return cut.select("_row", "doc_id", "_ix", "block", (low - F.col("_start")).alias("first_word"), (high - low).alias("n_words"))

    def placements(self) -> DataFrame:
        """Drawn spans: shard, position of the block in it, epoch, _row, doc_id, first_word, n_words."""
        return self.spans().join(self.draws.hint("merge"), ["_ix", "block"])  # its size is not known beforehand

    def taken(self) -> DataFrame:
        """Per document: doc_id, source, size, source_size, target, taken."""
        words = self.placements().groupBy("_row").agg(F.sum("n_words").alias("taken"))
        found = self.documents.join(words, "_row", "left")
        return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MAX_REPEATS,
    seed: int = 0,
    shard_blocks: int = SHARD_BLOCKS,
) -> Mixture:
    """Mix all ``docs(doc_id, text, source)`` to target weights.

    Sources weigh ``weights`` in turn, by code point, null last; targets add up to all
    words and stop at ``most`` times the source's. A null, empty or blank text has no
    word and is never drawn. Rows with the same or a null ``doc_id`` stay separate
    documents; equal rows are told apart by their place, and which of them is drawn
    more often is of no consequence. Long texts are cut at block borders. An empty
    table gives no rows. Other columns are ignored. The same rows give the same mix.
    """
    return Mixture(_rows(docs), weights, most, seed, shard_blocks)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, first, n in zip(batch.column("text").to_pylist(), batch.column("first_word").to_pylist(), batch.column("n_words").to_pylist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), ~SPACE)
            out.append(raw[starts[first] : ends[first + n - 1]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "position", "doc_id", "epoch", "first_word")), pa.array(out, pa.string())], names=["shard", "position", "doc_id", "epoch", "first_word", "text"])


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows ``shard, position, doc_id, epoch, first_word, text``; order a shard by position and first word."""
    rows = stored(_rows(docs), "rows")
    options = {"weights": WEIGHTS, "most": MAX_REPEATS, "seed": 0, "shard_blocks": SHARD_BLOCKS} | options
    placed = Mixture(rows, **options).placements().drop("doc_id")
    wanted = placed.join(rows.select("_row", "doc_id", "text"), "_row")
    cut = wanted.select("shard", "position", "doc_id", "epoch", "first_word", "n_words", "text")
    return cut.mapInArrow(_cut, "shard long, position long, doc_id long, epoch int, first_word long, text string")
