"""Ranked lexical search over norm buckets of impact vectors (the LEMP scheme).

A document's vector has one impact per term that some query asks for, a query's one
weight per term; a score is their inner product. Vectors are range-partitioned by
length and cut into buckets of about equal length, the longest first. A task takes its
buckets in that order and keeps each query's best rows and the score to beat:

* Cauchy-Schwarz: a bucket whose longest vector cannot reach that score is passed by,
  first in the scan (for all queries), then for single queries;
* coordinate bounds: inside a bucket no coordinate exceeds its largest value there. The
  query's coordinates that could give most are summed first; what a vector can still get
  from the others is bounded by their largest values and by the lengths of both
  remainders; rows below the score to beat go;
* survivors are scored again exactly in 64-bit integers from their whole vectors.

The first bucket of every range gives starting scores for all tasks. Bounds only skip rows
that cannot rank, so the result is the full ranking's. Queries come in blocks of bounded
text, so what goes to the driver and the tasks does not grow with either table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.ranks import top_per_group
from docweave.llm.blocks import LOWER, stored

TOP = 20
#: Text of one block of queries.
QUERY_BYTES = 4 << 20
BUCKET_ROWS = 4096
#: Share of the score to beat that the coordinates outside the focus may reach together.
REST = 0.3
#: Relative slack for rounding in the bounds; scores themselves are integers.
SLACK = 1e-9
SLICE_BYTES = 1 << 20

#: Bytes of terms, A-Z as a-z; all others become a space.
_FOLD = bytes(int(LOWER[b]) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
_IMPACTS = "doc_id long, length double, terms array<int>, impacts array<long>"
_BUCKETS = "head boolean, longest double, doc_ids array<long>, lengths array<double>, first array<int>, terms array<int>, impacts array<long>"
_HITS = "query int, doc_id long, score long, scored long"


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, folded; a long text comes in slices cut between terms."""
    folded = raw.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= SLICE_BYTES else folded.find(b" ", at + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Queries:
    """A block of queries: vocabulary, and terms with repeats per query."""

    def __init__(self, texts: list[str]) -> None:
        self.bags = [Counter(t for some in terms(text.encode()) for t in some) for text in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for bag in self.bags for t in bag}))}

    def weighted(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: terms and weight times repeats; terms without weight are left out."""
        out = []
        for bag in self.bags:
            ids = np.array([self.vocabulary[t] for t in bag], np.int64)
            value = np.array(list(bag.values()), np.int64) * weights[ids]
            out.append((ids[value > 0], value[value > 0]))
        return out


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list per row ``0 .. n - 1`` of values sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Term counts of every text that has a term at all."""
    size = max(1, len(vocabulary))
    get = {t: i + 1 for t, i in vocabulary.items()}.get
    for batch in batches:
        lengths, found, owner = [], [], []
        for row, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            n = 0
            for some in terms(raw or b""):
                n += len(some)
                ids = np.fromiter(filter(None, map(get, some)), np.int64) - 1
                ids, counts = np.unique(ids, return_counts=True)
                found.append((ids + row * size, counts))
            lengths.append(n)
        n = np.array(lengths, np.int64)
        keys = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        counts = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        keys, at = np.unique(keys, return_inverse=True)  # slices of one text meet
        counts = np.bincount(at, counts, len(keys)).astype(np.int32)
        columns = [
            batch.column("doc_id"),
            pa.array(n),
            _lists(keys // size, (keys % size).astype(np.int32), len(n), pa.int32()),
            _lists(keys // size, counts, len(n), pa.int32()),
        ]
        out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])
        yield out.filter(pa.array(n > 0))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the first value of each row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for batch in batches:
        df += np.bincount(_flat(batch.column("terms"))[0], minlength=size)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])


def _impacts(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Integer impacts and the length of each vector, its coordinates scaled by the root of the weight."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        ids, first = _flat(batch.column("terms"))
        tf = _flat(batch.column("tfs"))[0].astype(np.int64)
        m = 75 + (25 * n * n_docs) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(first)))
        sums = np.concatenate([[0.0], np.cumsum(weights[ids] * impact.astype(np.float64) ** 2)])
        length = np.sqrt(np.maximum(0.0, sums[first[1:]] - sums[first[:-1]]))
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(length), batch.column("terms"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(impact))],
            names=["doc_id", "length", "terms", "impacts"],
        )
        yield out.filter(pa.array(length > 0))


def _buckets(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, longest first, as one row per bucket."""
    head, waiting, have = True, [], 0

    def packed(table: pa.Table) -> pa.RecordBatch:
        nonlocal head
        table = table.combine_chunks()
        ids, first = _flat(table.column("terms").chunk(0))
        impacts, _ = _flat(table.column("impacts").chunk(0))
        lengths = table.column("length").to_numpy()
        row = {"head": head, "longest": float(lengths[0]), "doc_ids": table.column("doc_id").to_pylist(), "lengths": lengths}
        row |= {"first": first.astype(np.int32), "terms": ids, "impacts": impacts}
        head = False
        schema = pa.schema([("head", pa.bool_()), ("longest", pa.float64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.float64())), ("first", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    for batch in batches:
        waiting.append(batch)
        have += batch.num_rows
        if have >= rows:
            table = pa.Table.from_batches(waiting)
            full = have // rows * rows
            for lo in range(0, full, rows):
                yield packed(table.slice(lo, rows))
            waiting, have = table.slice(full).to_batches(), have - full
    if have:
        yield packed(pa.Table.from_batches(waiting))


class _Best:
    """The best rows of one query so far and the score that a further row must reach."""

    __slots__ = ("scores", "docs", "k", "least")

    def __init__(self, k: int, least: int) -> None:
        self.scores, self.docs, self.k, self.least = np.zeros(0, np.int64), np.zeros(0, object), k, least

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= self.least
        scores, docs = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.docs, docs[keep]])
        if len(scores) > self.k:
            known = np.array([d is not None for d in docs])
            ids = np.array([d if d is not None else 0 for d in docs], np.int64)
            order = np.lexsort((ids, known, -scores))[: self.k]
            scores, docs = scores[order], docs[order]
        self.scores, self.docs = scores, docs
        if len(scores) == self.k:
            self.least = max(self.least, int(scores.min()))


class _Bucket:
    """A bucket with its vectors by row and by coordinate."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, first: np.ndarray, ids: np.ndarray, impacts: np.ndarray, roots: np.ndarray):
        self.lengths, self.docs, self.first, self.ids, self.impacts = lengths, docs, first, ids, impacts
        rows = np.repeat(np.arange(len(lengths)), np.diff(first))
        order = np.argsort(ids, kind="stable")
        self.rows, sorted_ids = rows[order], ids[order]
        self.values = impacts[order] * roots[sorted_ids]
        self.terms, self.at = np.unique(sorted_ids, return_index=True)
        self.most = np.maximum.reduceat(self.values, self.at) if len(self.at) else np.zeros(0)
        self.at = np.append(self.at, len(sorted_ids))

    def survivors(self, query: dict, least: float) -> np.ndarray:
        """Rows that may reach ``least``, by their focus coordinates and bounds of the rest."""
        spot = np.searchsorted(self.terms, query["ids"])
        spot[spot == len(self.terms)] = 0
        there = np.flatnonzero(self.terms[spot] == query["ids"])
        spot, scaled = spot[there], query["scaled"][there]
        order = np.argsort(-scaled * self.most[spot], kind="stable")
        spot, scaled = spot[order], scaled[order]
        bound = np.append(np.cumsum((scaled * self.most[spot])[::-1])[::-1], 0.0)  # of coordinate i and all after it
        if bound[0] * (1 + SLACK) < least:
            return np.zeros(0, np.int64)
        k = int(np.searchsorted(-bound, -REST * least))
        spot, scaled, rest = spot[:k], scaled[:k], bound[k]
        count = self.at[spot + 1] - self.at[spot]
        ahead = np.cumsum(count) - count
        index = np.arange(int(count.sum())) + np.repeat(self.at[spot] - ahead, count)
        rows, values = self.rows[index], self.values[index]
        n = len(self.lengths)
        part = np.bincount(rows, values * np.repeat(scaled, count), n)
        near = np.flatnonzero((part + rest) * (1 + SLACK) >= least)
        if rest == 0 or not len(near):
            return near
        held = np.bincount(rows, values * values, n)[near]
        left = np.sqrt(np.maximum(0.0, self.lengths[near] ** 2 * (1 + SLACK) - held))
        apart = math.sqrt(max(0.0, query["length"] ** 2 * (1 + SLACK) - float(scaled @ scaled)))
        return near[(part[near] + apart * left) * (1 + SLACK) >= least]

    def exact(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Integer scores of rows; ``weight`` has one number per coordinate."""
        count = self.first[rows + 1] - self.first[rows]
        ahead = np.cumsum(count) - count
        index = np.arange(int(count.sum())) + np.repeat(self.first[rows] - ahead, count)
        sums = np.concatenate([[0], np.cumsum(weight[self.ids[index]] * self.impacts[index])])
        return sums[ahead + count] - sums[ahead]


def _prepared(asked: list[tuple[np.ndarray, np.ndarray]], roots: np.ndarray) -> list[dict]:
    """Per query: terms, integer weights, coordinates scaled by the root of the term's weight, and their length."""
    scaled = [value / roots[ids] for ids, value in asked]
    return [{"ids": ids, "value": value, "scaled": x, "length": math.sqrt(x @ x)} for (ids, value), x in zip(asked, scaled)]


def _search(batches, asked, weights: np.ndarray, least: list[int], k: int) -> Iterator[pa.RecordBatch]:
    roots = np.sqrt(weights.astype(np.float64))
    queries = _prepared(asked, roots)
    best = [_Best(k, max(1, s)) for s in least]
    scored = np.zeros(len(queries), np.int64)
    dense = np.zeros(len(weights), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            longest = batch.column("longest")[i].as_py()
            if not any(q["length"] * longest * (1 + SLACK) >= b.least for q, b in zip(queries, best)):
                continue
            values = {c: batch.column(c)[i].values for c in ("lengths", "doc_ids", "first", "terms", "impacts")}
            bucket = _Bucket(
                values["lengths"].to_numpy(),
                np.array(values["doc_ids"].to_pylist(), object),
                values["first"].to_numpy().astype(np.int64),
                values["terms"].to_numpy().astype(np.int64),
                values["impacts"].to_numpy(),
                roots,
            )
            for j, (q, b) in enumerate(zip(queries, best)):
                if q["length"] * longest * (1 + SLACK) < b.least:
                    continue
                rows = bucket.survivors(q, b.least)
                if len(rows):
                    dense[q["ids"]] = q["value"]
                    b.add(bucket.exact(rows, dense), bucket.docs[rows])
                    dense[q["ids"]] = 0
                    scored[j] += len(rows)
    number = np.concatenate([np.full(max(1, len(b.scores)), j, np.int32) for j, b in enumerate(best)]) if best else np.zeros(0, np.int32)
    # a query without rows gives one without a score, so that the rows it scored are counted
    docs = [d for b in best for d in (b.docs.tolist() or [None])]
    scores = [s for b in best for s in (b.scores.tolist() or [None])]
    spent = [n if not i else 0 for b, n in zip(best, scored.tolist()) for i in range(max(1, len(b.scores)))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(number), pa.array(docs, pa.int64()), pa.array(scores, pa.int64()), pa.array(spent, pa.int64())],
        names=["query", "doc_id", "score", "scored"],
    )


class Index:
    """Buckets of impact vectors for one block of queries."""

    def __init__(self, docs: DataFrame, texts: list[str], bucket_rows: int = BUCKET_ROWS) -> None:
        spark = docs.sparkSession
        self.queries = Queries(texts)
        vocabulary = spark.sparkContext.broadcast(self.queries.vocabulary)  # terms of at most QUERY_BYTES text
        size = max(1, len(self.queries.vocabulary))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        vectors = stored(rows.mapInArrow(lambda it: _vectors(it, vocabulary.value), _VECTORS), "vectors")
        self.n_docs, self.n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        counted = vectors.select("terms").mapInArrow(lambda it: _frequencies(it, size), "term int, df long")
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        self.weights = np.zeros(size, np.int64)
        for term, n in df.items():
            self.weights[term] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * n + 1)))
        self.asked = self.queries.weighted(self.weights)
        weights, n_docs, total = self.weights, self.n_docs, max(1, self.n_terms)
        impacts = vectors.mapInArrow(lambda it: _impacts(it, weights, n_docs, total), _IMPACTS)
        order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first()]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = impacts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.buckets = stored(ranged.mapInArrow(lambda it: _buckets(it, bucket_rows), _BUCKETS), "buckets")

    def search(self, k: int = TOP) -> DataFrame:
        """``query, rank, doc_id, score``: the ``k`` best rows above 0 per query of the block, ties by ``doc_id``."""
        hits = self._hits(self.buckets.where("head"), [0] * len(self.asked), k)
        firsts = top_per_group(hits.where("score IS NOT NULL"), ["query"], [F.col("score").desc()], k)
        least = [0] * len(self.asked)
        for r in firsts.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect():
            least[r["query"]] = r["least"]
        lengths = [q["length"] for q in _prepared(self.asked, np.sqrt(self.weights.astype(np.float64)))]
        shortest = min((max(1, s) / n for s, n in zip(least, lengths) if n), default=math.inf)
        near = self.buckets.where(F.col("longest") * F.lit(1 + SLACK) >= F.lit(shortest))
        self.hits = stored(self._hits(near, least, k), "hits")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        return top_per_group(self.hits.where("score IS NOT NULL").drop("scored"), ["query"], order, k)

    def _hits(self, buckets: DataFrame, least: list[int], k: int) -> DataFrame:
        asked, weights = self.asked, self.weights
        return buckets.mapInArrow(lambda it: _search(it, asked, weights, least, k), _HITS)

    def scored(self) -> int:
        """Pairs of query and document that the last search scored exactly."""
        return self.hits.agg(F.coalesce(F.sum("scored"), F.lit(0))).collect()[0][0]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``.

    Returns item_id, rank (from 1), doc_id, score above 0; equal scores by ascending
    doc_id, a null one first. A null or empty text has no term: such an item has no row.
    Rows with equal ids stay separate items and documents. Texts of any length count
    whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    numbered = stored(
        items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("_item", F.monotonically_increasing_id()),
        "items",
    )
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-int(total) // QUERY_BYTES))
    out = None
    for b in range(blocks):
        mine = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b)
        asked = mine.select("_item", "text").orderBy("_item").collect()  # about QUERY_BYTES
        found = Index(docs, [r["text"] for r in asked], bucket_rows).search(k)
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(asked)], "query int, _item long")
        found = found.join(F.broadcast(names), "query").join(numbered.drop("text"), "_item")
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return out
