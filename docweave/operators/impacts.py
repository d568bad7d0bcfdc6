"""BM25 search that reads only postings which can reach the best k.

The index lies in blocks of documents. A block holds, per term, its documents and their weights (the
score part without idf) and the block maximum, in one row per shelf of terms and level of weights; shelf and
level are folders. A task makes a block from the rows of the forward table that it reads: postings never
become rows and are not shuffled, and no weight waits for the statistics of the whole vocabulary.

A first look at the best documents of each query term, from its highest levels, gives a score that k
documents surely have. Terms of a query are then taken from the strongest to the weakest: a document whose
strongest term is the j-th needs there what the weaker terms together cannot bring. Weaker levels are not
read at all. A document whose postings read, with all that the others can add, stay below that score is
dropped; the rest is scored from the forward table of the term index, which gives the same rows as the full
search.

Postings that are read go, as arrays, to the task of their block, and meet the queries of their terms
there: pairs of query and document become rows only when they stay open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docweave.functions.ranks import hot_keys, skew_join, top_per_group
from docweave.operators import keyword
from docweave.operators.keyword import K1, PARTS_AT_ONCE, B, TermIndex, _lengths, _pieces
from docweave.session import cut_lineage

# tasks receive the kernels below inside the job, so no worker has to install this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHELVES = 4
#: Levels are half powers of two; a weight is below ``K1 + 1``.
LOWEST, HIGHEST = -8, 2
#: Best postings per term for the first look; more than ``k`` of a search is not needed.
HEADS = 64
#: Share of the needed score that postings which are not read may add up to. At 1 the fewest are
#: read, but nearly all documents with any of them stay open; lower values leave few to score.
SKIP = 0.15
#: Postings of a block; a longer document is a block of its own.
BLOCK_POSTINGS = 1 << 19
#: Query-document pairs up to which they go to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Room for the rounding of a division or logarithm where a weight is compared with a level.
ROOM = 1e-9
_NUMBERS = {LongType(): "<i8", IntegerType(): "<i4"}


@dataclass
class ImpactIndex:
    """``blocks(block, terms, counts, tops, doc_ids, weights, shelf, level)`` and the term index.

    ``counts`` and ``tops`` are the postings and the largest weight per term; ``doc_ids`` and ``weights``
    are the postings, term after term. Numbers are packed in one binary value per row, ids too if they are
    numbers (``_packed``), and terms, which have no spaces, are one string: a list would pass each of them
    alone between the engine, files and Python.
    """

    blocks: DataFrame
    source: TermIndex

    @property
    def postings(self) -> DataFrame:
        """``term, doc_id, weight``: one row per posting."""
        fields = [
            StructField("term", StringType()),
            self.source.forward.schema["doc_id"],
            StructField("weight", DoubleType()),
        ]
        id_type = _NUMBERS.get(self.source.forward.schema["doc_id"].dataType)

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _posting_batches(batches, id_type)

        return self.blocks.select("terms", "counts", "doc_ids", "weights").mapInArrow(postings, StructType(fields))


def _level(weight: Column) -> Column:
    """Half powers of two; everything below the lowest shares one level."""
    high = F.least(F.floor(F.log2(weight) * 2).cast("int"), F.lit(HIGHEST))
    return F.when(weight > 0, F.greatest(F.lit(LOWEST), high)).otherwise(F.lit(LOWEST))


def _shelf(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(SHELVES)).cast("int")


def _impact(idf: Column, tf: Column, dl: Column, avg_len: float) -> Column:
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avg_len))


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _packed(offsets: np.ndarray, values: np.ndarray, number: str) -> pa.Array:
    """One binary value per row, with its numbers in little-endian order."""
    values = np.ascontiguousarray(values, number)
    places = pa.py_buffer((offsets * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, places, pa.py_buffer(values)])


def _unpacked(column: pa.Array, number: str) -> np.ndarray:
    """The numbers of all rows."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(0, number)
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]].view(number) if data else np.zeros(0, number)


def _terms(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, and the row of each."""
    lists = pc.split_pattern(batch.column("terms").cast(pa.string()), " ")
    return lists.flatten(), np.repeat(np.arange(batch.num_rows), _lengths(lists))


def _packed_ids(offsets: np.ndarray, ids: pa.Array, id_type: str | None) -> pa.Array:
    return _packed(offsets, ids.to_numpy(), id_type) if id_type else _lists(offsets, ids)


def _unpacked_ids(column: pa.Array, id_type: str | None) -> pa.Array:
    return pa.array(_unpacked(column, id_type)) if id_type else column.flatten()


def _block_batches(batches: Iterator[pa.RecordBatch], avg_len: float, names: list[str], id_type: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of the forward table to blocks: one row per shelf and level."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = _lengths(batch.column("terms"))
        for lo, hi in _pieces(sizes, BLOCK_POSTINGS):
            part = batch.slice(lo, hi - lo)
            known = part.column("terms").flatten().dictionary_encode()
            n = len(known.dictionary)
            if not n:
                continue
            number = known.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            tf = part.column("counts").flatten().to_numpy().astype(np.float64)
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column("doc_len").to_numpy()[row] / avg_len))
            level = np.clip(np.floor(np.log2(weight) * 2), LOWEST, HIGHEST).astype(np.int64) - LOWEST
            shelf = np.array([crc32(term.encode()) % SHELVES for term in known.dictionary.to_pylist()])
            key = (shelf[number] * (HIGHEST - LOWEST + 1) + level) * n + number
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
            runs = _starts(key)
            folder, term = np.divmod(key[runs], n)
            first = _starts(folder)
            per_term, per_posting = np.r_[first, len(runs)], np.r_[runs[first], len(key)]
            columns = [
                pa.array(np.full(len(first), block)),
                pc.binary_join(_lists(per_term, known.dictionary.take(pa.array(term)).cast(pa.string())), " "),
                _packed(per_term, np.diff(np.r_[runs, len(key)]), "<i4"),
                _packed(per_term, np.maximum.reduceat(weight, runs), "<f8"),
                _packed_ids(per_posting, part.column("doc_id").take(pa.array(row[order])), id_type),
                _packed(per_posting, weight, "<f8"),
                pa.array((folder[first] // (HIGHEST - LOWEST + 1)).astype(np.int32)),
                pa.array((folder[first] % (HIGHEST - LOWEST + 1) + LOWEST).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            block += 1


def _posting_batches(batches: Iterator[pa.RecordBatch], id_type: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = _terms(batch)[0], _unpacked(batch.column("counts"), "<i4")
        ids, weights = _unpacked_ids(batch.column("doc_ids"), id_type), _unpacked(batch.column("weights"), "<f8")
        term = np.repeat(np.arange(len(terms)), counts)
        for lo in range(0, len(term), BLOCK_POSTINGS):
            some = slice(lo, lo + BLOCK_POSTINGS)
            columns = [terms.take(pa.array(term[some])), ids[some], pa.array(weights[some])]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "weight"])


def write_impacts(index: TermIndex, path: str) -> ImpactIndex:
    """Store the blocks of a term index; its forward table is used as it is."""
    avg_len = keyword._figures(index.corpus)["avg_len"]
    schema, id_type = _block_schema(index), _NUMBERS.get(index.forward.schema["doc_id"].dataType)

    names = schema.names

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_batches(batches, avg_len, names, id_type)

    # a document without an id was no hit of the search before either
    named = index.forward.where("doc_id IS NOT NULL").select("doc_id", "doc_len", "terms", "counts")
    rows = named.mapInArrow(blocks, schema)
    rows.write.mode("overwrite").partitionBy("shelf", "level").parquet(f"{path}/blocks")
    return read_impacts(index.terms.sparkSession, path, index)


def _block_schema(index: TermIndex) -> StructType:
    doc_id = index.forward.schema["doc_id"].dataType
    kinds = {
        "block": LongType(),
        "terms": StringType(),
        "counts": BinaryType(),
        "tops": BinaryType(),
        "doc_ids": BinaryType() if doc_id in _NUMBERS else ArrayType(doc_id),
        "weights": BinaryType(),
        "shelf": IntegerType(),
        "level": IntegerType(),
    }
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def read_impacts(spark: SparkSession, path: str, index: TermIndex) -> ImpactIndex:
    # an index without postings has no folder to tell its columns
    return ImpactIndex(spark.read.schema(_block_schema(index)).parquet(f"{path}/blocks"), index)


def _exact(index: ImpactIndex, asked: DataFrame, pairs: DataFrame, decimals: int) -> DataFrame:
    """Score of ``pairs(query_id, doc_id)`` from the forward table."""
    entry = F.struct("term", F.struct("qtf", "idf").alias("weight"))
    wanted = asked.groupBy("query_id").agg(F.map_from_entries(F.collect_list(entry)).alias("wanted"))
    avg_len = keyword._figures(index.source.corpus)["avg_len"]
    few = pairs.count() <= BROADCAST_ROWS
    met = index.source.forward.join(F.broadcast(pairs) if few else pairs, "doc_id").join(wanted, "query_id")
    common = F.filter(F.arrays_zip("terms", "counts"), lambda x: F.map_contains_key("wanted", x["terms"]))

    def part(total: Column, x: Column) -> Column:
        weight = F.col("wanted")[x["terms"]]
        return total + _impact(weight["idf"], x["counts"], F.col("doc_len"), avg_len) * weight["qtf"]

    return met.select("query_id", "doc_id", F.round(F.aggregate(common, F.lit(0.0), part), decimals).alias("score"))


def _chosen(batch: pa.RecordBatch, terms: pa.Array, idf: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings of ``terms`` in rows of blocks whose impact is at least that of their term: row, term, place, impact.

    Terms whose block maximum stays below are skipped.
    """
    own, row = _terms(batch)
    number = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy(zero_copy_only=False)
    counts = _unpacked(batch.column("counts"), "<i4")
    starts = np.cumsum(counts, dtype=np.int64) - counts
    runs = np.flatnonzero(number >= 0)
    mine = number[runs]
    top = _unpacked(batch.column("tops"), "<f8")[runs]
    can = (idf[mine] <= 0) | (idf[mine] * top >= least[mine])
    runs, mine = runs[can], mine[can]
    n = counts[runs]
    place = np.repeat(starts[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    term = np.repeat(mine, n)
    impact = idf[term] * _unpacked(batch.column("weights"), "<f8")[place]
    reads = impact >= least[term]
    return np.repeat(row[runs], n)[reads], term[reads], place[reads], impact[reads]


def _folders(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The folders of ``blocks`` that ``wanted`` names; there are only shelves times levels of them."""
    levels: dict[int, list[int]] = {}
    for shelf, level in wanted.select("shelf", "level").distinct().collect():
        levels.setdefault(shelf, []).append(level)
    named = F.lit(False)
    for shelf, some in sorted(levels.items()):
        named = named | ((F.col("shelf") == shelf) & F.col("level").isin(*sorted(some)))
    return blocks.where(named)


def _top_batches(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """``term, level, n, top`` of the terms in each row; postings are not touched."""
    for batch in batches:
        own, row = _terms(batch)
        found = pc.index_in(own, value_set=terms)
        known = pc.is_valid(found)
        level = batch.column("level").to_numpy()[row]
        columns = [terms.take(found.filter(known)), pa.array(level).filter(known)]
        columns += [pa.array(_unpacked(batch.column(c), kind)).filter(known) for c, kind in (("counts", "<i4"), ("tops", "<f8"))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "level", "n", "top"])


def _head_batches(
    batches: Iterator[pa.RecordBatch], terms: pa.Array, least: np.ndarray, heads: int, id_type: str | None
) -> Iterator[pa.RecordBatch]:
    """``term, doc_id, weight``: the best postings of each term in a batch."""
    for batch in batches:
        _, term, place, weight = _chosen(batch, terms, np.ones(len(terms)), least)
        ids = _unpacked_ids(batch.column("doc_ids"), id_type).take(pa.array(place))
        order = np.lexsort((np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1], -weight, term))
        starts = _starts(term[order])
        position = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        best = order[position < heads]
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(term[best])), ids.take(pa.array(best)), pa.array(weight[best])], ["term", "doc_id", "weight"]
        )


def _first_look(index: ImpactIndex, asked: DataFrame, sendable: bool) -> tuple[DataFrame, DataFrame]:
    """``term, doc_id, impact`` of the best documents of each term, and ``term, top``.

    ``top`` is the most that a posting of the term brings; for an idf below zero that is nothing. The heads
    come from the highest levels that hold enough postings.
    """
    mine = asked.select("term", "idf").distinct()
    best = [F.col("weight").desc(), F.col("doc_id")]
    bound = F.when(F.col("idf") > 0, F.col("idf") * F.max("top")).otherwise(0.0).alias("top")
    if not sendable:
        rows = skew_join(index.postings, mine, ["term"], ["doc_id"], hot_keys(index.source.terms, ["term"], "df"))
        tops = rows.withColumnRenamed("weight", "top").groupBy("term", "idf").agg(bound).drop("idf")
        heads = top_per_group(rows, ["term"], best, HEADS)
        return heads.select("term", "doc_id", (F.col("idf") * F.col("weight")).alias("impact")), tops
    terms = mine.select("term").toArrow()["term"].combine_chunks().cast(pa.string())
    shared, count = mine.sparkSession.sparkContext.broadcast(terms), HEADS
    id_type = _NUMBERS.get(index.source.forward.schema["doc_id"].dataType)

    def tops_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _top_batches(batches, shared.value)

    shelves = [r.shelf for r in mine.select(_shelf(F.col("term")).alias("shelf")).distinct().collect()]
    maxima = index.blocks.where(F.col("shelf").isin(*shelves)).select("level", "terms", "counts", "tops")
    maxima = maxima.mapInArrow(tops_of, "term string, level int, n int, top double").groupBy("term", "level")
    maxima = cut_lineage(maxima.agg(F.sum("n").alias("n"), F.max("top").alias("top")).withColumn("shelf", _shelf(F.col("term"))))
    higher = Window.partitionBy("term").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = cut_lineage(maxima.withColumn("before", F.sum("n").over(higher)).where(f"coalesce(before, 0) < {HEADS}"))
    lowest = wanted.groupBy("term").agg(F.min("level").alias("level")).toArrow()
    at = pc.index_in(terms, value_set=lowest["term"].combine_chunks().cast(pa.string())).to_numpy(zero_copy_only=False)
    level = lowest["level"].to_numpy()[at]
    least = np.where(level == LOWEST, 0.0, 2.0 ** (level / 2) * (1 - ROOM))

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _head_batches(batches, shared.value, least, count, id_type)

    fields = [mine.schema["term"], index.postings.schema["doc_id"], StructField("weight", DoubleType())]
    rows = _folders(index.blocks, wanted).select("terms", "counts", "tops", "doc_ids", "weights").mapInArrow(heads_of, StructType(fields))
    heads = top_per_group(rows, ["term"], best, HEADS).join(F.broadcast(mine), "term")
    tops = maxima.join(F.broadcast(mine), "term").groupBy("term", "idf").agg(bound).drop("idf")
    return heads.select("term", "doc_id", (F.col("idf") * F.col("weight")).alias("impact")), tops


def _thresholds(index: ImpactIndex, asked: DataFrame, heads: DataFrame, k: int, decimals: int) -> DataFrame:
    """``query_id, least_score``: a score that ``k`` documents of the query have for certain; 0 if fewer are known."""
    heads = asked.join(heads, "term")
    partial = heads.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("part"))
    first = top_per_group(partial, ["query_id"], [F.col("part").desc(), F.col("doc_id")], k)
    scored = _exact(index, asked, cut_lineage(first.select("query_id", "doc_id")), decimals)
    enough = F.when(F.count(F.lit(1)) >= k, F.greatest(F.min("score"), F.lit(0.0))).otherwise(0.0)
    return scored.groupBy("query_id").agg(enough.alias("least_score"))


def _probes(asked: DataFrame, thresholds: DataFrame, decimals: int) -> DataFrame:
    """Each query term with ``least``, the impact that a document needs there if it has no stronger term of the query.

    ``reach`` is the most that the term adds without being read, ``hope`` their sum and
    ``needed`` the score that a document must be able to reach.
    """
    most = F.col("qtf") * F.greatest("top", F.lit(0.0))
    weaker = Window.partitionBy("query_id").orderBy(most.desc(), "term").rowsBetween(1, Window.unboundedFollowing)
    rest = F.coalesce(F.sum(most).over(weaker), F.lit(0.0))
    slack = 2 * 10.0**-decimals  # scores are compared rounded
    least = (SKIP * F.coalesce("least_score", F.lit(0.0)) - slack - rest) / F.col("qtf")
    rows = asked.join(thresholds, "query_id", "left").withColumn("least", least)
    rows = rows.withColumn("needed", F.coalesce("least_score", F.lit(0.0)) - slack)
    rows = rows.withColumn("reach", F.col("qtf") * F.greatest(F.lit(0.0), F.least("top", "least")))
    return rows.withColumn("hope", F.sum("reach").over(Window.partitionBy("query_id"))).drop("least_score")


def _matches(index: ImpactIndex, probes: DataFrame, sendable: bool) -> tuple[DataFrame, DataFrame]:
    """``doc_id, term, impact`` of each posting that some probe reads, and the blocks that hold them."""
    wanted = probes.where("least <= top").groupBy("term", "idf").agg(F.min("least").alias("least"), F.max("top").alias("top"))
    if not sendable:
        rows = skew_join(index.postings, wanted, ["term"], ["doc_id"], hot_keys(index.source.terms, ["term"], "df"))
        rows = rows.withColumn("impact", F.col("idf") * F.col("weight")).where("impact >= least")
        return rows.select("doc_id", "term", "impact"), index.blocks
    low = F.when(F.col("idf") > 0, _level(F.col("least") / F.col("idf") * (1 - ROOM))).otherwise(LOWEST)
    high = F.when(F.col("idf") > 0, _level(F.col("top") / F.col("idf") * (1 + ROOM))).otherwise(HIGHEST)
    levels = wanted.select(_shelf(F.col("term")).alias("shelf"), F.explode(F.sequence(low, high)).alias("level"))
    blocks = _folders(index.blocks, levels).select("block", "terms", "counts", "tops", "doc_ids", "weights")
    shared, id_type = _sent(probes), _NUMBERS.get(index.source.forward.schema["doc_id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _match_batches(batches, _Probes(*shared.value), id_type)

    fields = [index.postings.schema["doc_id"], StructField("term", StringType()), StructField("impact", DoubleType())]
    return blocks.mapInArrow(read, StructType(fields)), blocks


class _Probes(NamedTuple):
    """Query ids with the ``hope`` and ``needed`` of each; sorted terms, and per term where its probes start.

    ``idf`` and ``floor``, the least impact that any probe reads, are those of the terms.
    """

    ids: pa.Array
    hope: np.ndarray
    needed: np.ndarray
    terms: pa.Array
    idf: np.ndarray
    floor: np.ndarray
    starts: np.ndarray
    queries: np.ndarray
    qtf: np.ndarray
    least: np.ndarray
    reach: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> _Probes:
        table = table.combine_chunks().sort_by("term")
        query, term = (table[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        numbers = term.indices.to_numpy(zero_copy_only=False)  # ascending, as the terms are sorted
        queries = query.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.unique(queries, return_index=True)[1]
        qtf, idf, least, reach, hope, needed = (
            table[c].to_numpy().astype(np.float64) for c in ("qtf", "idf", "least", "reach", "hope", "needed")
        )
        starts = np.searchsorted(numbers, np.arange(len(term.dictionary) + 1))
        floor = np.minimum.reduceat(least, starts[:-1]) if len(least) else least
        terms = term.dictionary.cast(pa.string())
        return _Probes(
            query.dictionary, hope[first], needed[first], terms, idf[starts[:-1]], floor, starts, queries, qtf, least, reach
        )


def _sent(probes: DataFrame):
    """Probes for the tasks, as a plain tuple that a worker without this package can read."""
    columns = probes.where("least <= top").select("query_id", "term", "qtf", "idf", "least", "reach", "hope", "needed")
    return probes.sparkSession.sparkContext.broadcast(tuple(_Probes.of(columns.toArrow())))


def _match_batches(batches: Iterator[pa.RecordBatch], probes: _Probes, id_type: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, term, place, impact = _chosen(batch, probes.terms, probes.idf, probes.floor)
        ids = _unpacked_ids(batch.column("doc_ids"), id_type).take(pa.array(place))
        yield pa.RecordBatch.from_arrays([ids, probes.terms.take(pa.array(term)), pa.array(impact)], ["doc_id", "term", "impact"])


def _read_batches(batches: Iterator[pa.RecordBatch], probes: _Probes, id_type: str | None) -> Iterator[pa.RecordBatch]:
    """The same as arrays: ``block, numbers, doc_ids, impacts`` per row of a block; terms by their place in the probes."""
    for batch in batches:
        row, term, place, impact = _chosen(batch, probes.terms, probes.idf, probes.floor)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        ids = _unpacked_ids(batch.column("doc_ids"), id_type).take(pa.array(place))
        columns = [batch.column("block"), _packed(offsets, term, "<i4"), _packed_ids(offsets, ids, id_type), _packed(offsets, impact, "<f8")]
        rows = pa.RecordBatch.from_arrays(columns, ["block", "numbers", "doc_ids", "impacts"])
        yield rows.filter(pa.array(np.diff(offsets) > 0))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per block from batches sorted by ``block``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        starts = [*_starts(blocks), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            if rest and rest[0].column("block")[0].as_py() != blocks[lo]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield pa.Table.from_batches(rest)


def _met(
    batches: Iterator[pa.RecordBatch], probes: _Probes, id_type: str | None
) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Postings that the probes read (queries by documents), whether a pair is open, and the document ids."""
    n = len(probes.ids)
    for rows in _whole_blocks(batches):
        number, impact = (
            np.concatenate([_unpacked(c, kind) for c in rows[name].chunks]) for name, kind in (("numbers", "<i4"), ("impacts", "<f8"))
        )
        found = pa.concat_arrays([_unpacked_ids(c, id_type) for c in rows["doc_ids"].chunks])
        known = found.dictionary_encode()
        ids, row = known.dictionary, known.indices.to_numpy().astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, number, impact = row[order], number[order], impact[order]
        fan = probes.starts[number + 1] - probes.starts[number]
        parts = np.bincount(row, weights=fan, minlength=len(ids)).astype(np.int64)
        for lo, hi in _pieces(np.maximum(parts, n), PARTS_AT_ONCE):
            some, width = slice(*np.searchsorted(row, [lo, hi])), hi - lo
            f = fan[some]
            at = np.repeat(probes.starts[number[some]] - (np.cumsum(f) - f), f) + np.arange(f.sum())
            value, doc = np.repeat(impact[some], f), np.repeat(row[some] - lo, f)
            reads = value >= probes.least[at]
            at, value, doc = at[reads], value[reads], doc[reads]
            place = probes.queries[at] * width + doc
            read = np.bincount(place, minlength=n * width).reshape(n, width)
            gain = np.bincount(place, weights=probes.qtf[at] * value - probes.reach[at], minlength=n * width)
            reached = gain.reshape(n, width) + probes.hope[:, None] >= probes.needed[:, None]
            yield read, (read > 0) & reached, ids.slice(lo, width)


def _sums(matches: DataFrame, probes: DataFrame) -> DataFrame:
    """The same by join and shuffle, for probes that are too many to send: ``query_id, doc_id, n, open``."""
    mine = probes.select("query_id", "term", "qtf", "least", "reach", "hope", "needed")
    hot = hot_keys(mine.groupBy("term").agg(F.count(F.lit(1)).alias("n")), ["term"], "n")
    met = skew_join(matches, mine, ["term"], ["doc_id"], hot).where("impact >= least")
    sums = met.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("qtf") * F.col("impact") - F.col("reach")).alias("gain"),
        F.max("hope").alias("hope"),
        F.max("needed").alias("needed"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.withColumn("open", F.col("gain") + F.col("hope") >= F.col("needed"))


class _Plan(NamedTuple):
    asked: DataFrame
    matches: DataFrame
    probes: DataFrame
    blocks: DataFrame
    sendable: bool


def _planned(index: ImpactIndex, queries: DataFrame, k: int, text: str, decimals: int) -> _Plan:
    asked = cut_lineage(keyword._query_terms(queries, text).join(index.source.terms, "term"))
    doc_id = index.source.forward.schema["doc_id"].dataType
    sendable = all(kind in keyword._KINDS for kind in (asked.schema["query_id"].dataType, doc_id)) and keyword._sendable(asked)
    heads, tops = _first_look(index, asked, sendable)
    thresholds = _thresholds(index, asked, heads, k, decimals)
    probes = cut_lineage(_probes(asked.join(tops, "term"), thresholds, decimals))
    matches, blocks = _matches(index, probes, sendable)
    return _Plan(asked, matches, probes, blocks, sendable)


def _plan(index: ImpactIndex, queries: DataFrame, k: int, text: str, decimals: int) -> tuple[DataFrame, DataFrame]:
    """Weighted query terms, and the postings that the search reads."""
    return _planned(index, queries, k, text, decimals)[:2]


def _by_block(plan: _Plan, fields: list[StructField], kernel, *others) -> DataFrame:
    """``kernel(batches, probes, id_type, schema, *others)`` over the postings read, all of a block in one task."""
    shared, id_type = _sent(plan.probes), _NUMBERS.get(plan.matches.schema["doc_id"].dataType)
    schema = pa.schema([(f.name, keyword._KINDS.get(f.dataType, pa.list_(pa.int32()))) for f in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_batches(batches, _Probes(*shared.value), id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernel(batches, _Probes(*shared.value), id_type, schema, *others)

    kinds = {"block": LongType(), "numbers": BinaryType(), "doc_ids": plan.blocks.schema["doc_ids"].dataType, "impacts": BinaryType()}
    rows = plan.blocks.mapInArrow(read, StructType([StructField(name, kind) for name, kind in kinds.items()]))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, StructType(fields))


def _open_batches(
    batches: Iterator[pa.RecordBatch], probes: _Probes, id_type: str | None, schema: pa.Schema, ids: pa.Array
) -> Iterator[pa.RecordBatch]:
    """One row per document with open pairs: its queries, by their place in ``ids``."""
    place = pc.index_in(probes.ids, value_set=ids).to_numpy(zero_copy_only=False)
    for _, opened, docs in _met(batches, probes, id_type):
        d, q = np.nonzero(opened.T)
        some = np.unique(d)
        starts = np.append(np.searchsorted(d, some), len(d)).astype(np.int32)
        queries = pa.ListArray.from_arrays(pa.array(starts), pa.array(place[q].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(some)).cast(schema[0].type), queries], schema=schema)


def _work_batches(
    batches: Iterator[pa.RecordBatch], probes: _Probes, id_type: str | None, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    read, scored = np.zeros((2, len(probes.ids)), np.int64)
    for reads, opened, _ in _met(batches, probes, id_type):
        read += reads.sum(1)
        scored += opened.sum(1)
    yield pa.RecordBatch.from_arrays([probes.ids.cast(schema[0].type), pa.array(read), pa.array(scored)], schema=schema)


def _scored(index: ImpactIndex, plan: _Plan, k: int, decimals: int) -> DataFrame:
    """Scores of the open pairs, whose postings read, with the most that the others add, reach the needed score.

    When the query terms can be sent, a document meets its queries as one row, and tasks pass on their best.
    """
    if not plan.sendable:
        pairs = _sums(plan.matches, plan.probes).where("open").select("query_id", "doc_id")
        return _exact(index, plan.asked, cut_lineage(pairs), decimals)
    asked = keyword._Asked.of(plan.asked.select("query_id", "term", "qtf", "idf").toArrow())
    fields = [plan.matches.schema["doc_id"], StructField("queries", ArrayType(IntegerType()))]
    opened = _by_block(plan, fields, _open_batches, asked.ids)
    docs = keyword._asked_terms(index.source.forward, asked).join(opened, "doc_id")
    avg_len = keyword._figures(index.source.corpus)["avg_len"]
    return keyword._scored_in_tasks(docs, plan.asked.schema["query_id"], asked, avg_len, k, decimals)


def _work(plan: _Plan) -> DataFrame:
    if not plan.sendable:
        return _sums(plan.matches, plan.probes).groupBy("query_id").agg(F.sum("n").alias("read"), F.count_if("open").alias("scored"))
    fields = [plan.asked.schema["query_id"], StructField("read", LongType()), StructField("scored", LongType())]
    sums = _by_block(plan, fields, _work_batches).groupBy("query_id")
    return sums.agg(F.sum("read").alias("read"), F.sum("scored").alias("scored"))


def search_impacts(index: ImpactIndex, queries: DataFrame, k: int, text: str = "text", decimals: int = 6) -> DataFrame:
    """The rows of ``keyword.search_index`` with fewer postings read: ``query_id, id, score, rank``.

    Terms that no document has and queries without terms give no rows. The result does
    not depend on ``HEADS``; a low value only makes the first look weaker.
    """
    plan = _planned(index, queries, k, text, decimals)
    scored = _scored(index, plan, k, decimals)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    return top_per_group(scored.where("score > 0"), ["query_id"], order, k).withColumnRenamed("doc_id", "id")


def search_work(index: ImpactIndex, queries: DataFrame, k: int, text: str = "text", decimals: int = 6) -> DataFrame:
    """Per query: ``postings`` of its terms, ``read`` by the search, and ``scored`` documents."""
    plan = _planned(index, queries, k, text, decimals)
    postings = plan.asked.groupBy("query_id").agg(F.sum("df").alias("postings"))
    return postings.join(_work(plan), "query_id", "left").na.fill(0, ["read", "scored"])
