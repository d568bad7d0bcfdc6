"""Vector collections: merge, delete, statistics and exact search.

Exact search multiplies Arrow batches of vectors with a block of queries in
numpy and keeps only the best ``k`` per query, so pairs never become rows.
A query set of checked size travels as a broadcast block (one scan of the
vectors, no shuffle before the final rank). A larger one uses a grid of
bounded query and vector blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.best import Best
from docweave.functions.ranks import top_per_group
from docweave.functions.text import tokens
from docweave.operators.validation import metadata_filter

# tasks receive the kernels below inside the job, so no worker has to install this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_ROWS_BOUND = 4096
QUERY_BYTES_BOUND = 64 * 1024 * 1024
VECTOR_BLOCK_ROWS = 32_768
# texts that are Python strings at once in a task that embeds them
EMBED_ROWS = 256
# bytes of texts whose terms a task counts at once
EMBED_BYTES = 8 << 20
# a query block of the grid may hold this many times the rows of a query set that is broadcast
GRID_BLOCKS = 8
# fewer pairs than this are not worth a task of their own
PAIRS_PER_TASK = 1 << 24
# pairs screened at once by one task, and those of them scored: bounds its memory whatever the batch sizes,
# and what is screened stays in the cache of a core
TILE_QUERIES = 512
PAIRS_AT_ONCE = 1 << 18
CANDIDATES_AT_ONCE = 1 << 16


# ---- collections -------------------------------------------------------------------


def upsert(base: DataFrame, updates: DataFrame, mode: str = "replace", sequence: str = "seq") -> DataFrame:
    """Merge updates into a collection table.

    ``replace``: per (collection, id) the row with the highest ``sequence``
    wins, base rows count as oldest. ``append`` keeps old and new vectors side
    by side but gives all of them the newest metadata, as the reference does.
    Copies are combined before the shuffle, so an id with very many updates
    does not load one task.
    """
    fields = [c for c in base.columns if c not in ("collection", "id")]
    both = base.withColumn(sequence, F.lit(-1).cast("long")).unionByName(
        updates.select("collection", "id", *fields, F.col(sequence).cast("long").alias(sequence))
    )
    newest = both.groupBy("collection", "id").agg(F.max_by(F.struct(*fields), F.col(sequence)).alias("_new"))
    if mode == "replace":
        return newest.select("collection", "id", "_new.*")
    if mode != "append":
        raise ValueError("mode must be 'replace' or 'append'")
    attributes = [c for c in fields if c != "embedding"]
    return both.select("collection", "id", "embedding").join(
        newest.select("collection", "id", *[F.col(f"_new.{c}").alias(c) for c in attributes]), ["collection", "id"]
    )


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the (collection, id) pairs of ``ids``."""
    return base.join(ids, ["collection", "id"], "left_anti")


def collection_stats(vectors: DataFrame) -> DataFrame:
    """Vectors, distinct documents and dimension per collection and in total (A1, A2)."""
    per_id = vectors.groupBy("collection", "id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.size("embedding")).alias("_dim")
    )
    return (
        per_id.rollup("collection")
        .agg(
            F.sum("_n").cast("long").alias("total_vectors"),
            F.count(F.lit(1)).alias("documents"),
            F.max("_dim").cast("long").alias("dimension"),
        )
        .withColumn("collection", F.coalesce("collection", F.lit("(all)")))
    )


def index_size(vectors: DataFrame) -> DataFrame:
    """Estimated bytes per collection: float32 plus a tenth (A3)."""
    stats = vectors.groupBy("collection").agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension")
    )
    size = F.floor(F.col("vectors") * F.col("dimension") * 4 * F.lit(1.1).cast("double"))
    return stats.withColumn("estimated_bytes", size.cast("long"))


# ---- attaching vectors ---------------------------------------------------------------


def attach_vectors(texts: DataFrame, vectors: DataFrame, on: str) -> DataFrame:
    """Join texts to a table of supplied vectors."""
    return texts.join(vectors, on)


def embed_with(texts: DataFrame, text: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Attach vectors from a caller's batch model ``Series[str] -> Series[list]``.

    The model gets short pieces of an Arrow batch, as the texts of a whole one take much memory as Python strings.
    One with ``of_texts``, from Arrow texts to Arrow lists, gets larger pieces.
    """
    embed = F.arrow_udf(lambda column: _embedded(column, model), T.ArrayType(T.FloatType()))
    return texts.withColumn("embedding", embed(F.col(text)))


def _embedded(column: pa.Array, model: Callable[[pd.Series], pd.Series]) -> pa.Array:
    kind = pa.list_(pa.float32())
    if of_texts := getattr(model, "of_texts", None):  # it needs no Python strings
        ends = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
        cuts = np.flatnonzero(np.diff(ends // EMBED_BYTES, prepend=0)).tolist()
        made = [of_texts(column.slice(lo, hi - lo)) for lo, hi in zip([0, *cuts], [*cuts, len(column)])]
    else:
        pieces = (column.slice(lo, EMBED_ROWS) for lo in range(0, len(column), EMBED_ROWS))
        made = [pa.array(list(model(piece.to_pandas())), kind, from_pandas=True) for piece in pieces]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def hash_embed(texts: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Attach unit vectors of hashed token counts: the offline stand-in for a model."""
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_counts").transform(
        texts.withColumn("_tokens", tokens(F.coalesce(F.col(text), F.lit(""))))
    )
    normed = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return normed.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def term_counts_model(dim: int = 32) -> Callable[[pd.Series], pd.Series]:
    """A batch model for ``embed_with``: counts of terms per bucket, from the leading digits of their MD5.

    Any engine that knows MD5 can compute the same vectors. Texts come in lower case; terms are found
    and hashed in the bytes of all texts at once, and none becomes a Python value.
    """

    def of_texts(texts: pa.Array) -> pa.Array:
        counts = _term_counts(texts, dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dim), pa.array(counts.ravel()))

    def model(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_term_counts(pa.array(texts, pa.string(), from_pandas=True), dim)), texts.index, dtype=object)

    model.of_texts = of_texts
    return model


def _term_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Terms per bucket of each text."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if starts[-1] == starts[0]:
        return np.zeros((len(texts), dim), np.float32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    word = _in_words(data)
    edge = np.r_[True, word[1:] != word[:-1], True]
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    terms = np.flatnonzero(word[cuts[:-1]])
    at, size = cuts[terms], np.diff(cuts)[terms]
    bucket = _md5_heads(data, at, size) % dim
    row = np.searchsorted(starts, at, side="right") - 1
    return np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float32)


MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
MD5_ADDED = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
MD5_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
MD5_AT_ONCE = 32_768


def _md5_heads(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of the first seven hexadecimal digits of the MD5 of pieces of ``data``.

    MD5 pads a piece of up to 55 bytes to one block. Pieces whose bytes fill equally many words of it go through together.
    """
    out = np.zeros(len(at), np.int64)
    filled = np.where(size <= 55, size // 4 + 1, 0)
    order = np.argsort(filled.astype(np.uint8), kind="stable")
    ends = np.searchsorted(filled[order], np.arange(16))
    for i in order[: ends[1]].tolist():
        out[i] = int(hashlib.md5(data[at[i] : at[i] + size[i]].tobytes()).hexdigest()[:7], 16)
    data = np.r_[data, np.zeros(64, np.uint8)]
    for n in range(1, 15):
        for lo in range(ends[n], ends[n + 1], MD5_AT_ONCE):
            some = order[lo : min(ends[n + 1], lo + MD5_AT_ONCE)]
            place, length = np.arange(4 * n, dtype=np.uint8), size[some].astype(np.uint8)[:, None]
            block = np.lib.stride_tricks.sliding_window_view(data, 4 * n)[at[some]]
            block[place >= length] = 0
            block[np.arange(len(some)), length[:, 0]] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            out[some] = _md5_first(words, 8 * size[some].astype(np.uint32)).byteswap() >> 4
    return out


def _md5_first(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """First word of the MD5 of blocks with these first words and lengths in bits, zero in between."""
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(len(bits), x, np.uint32) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, MD5_ADDED[i], out=f)
        if MD5_WORDS[i] < len(words):
            np.add(f, words[MD5_WORDS[i]], out=f)
        elif MD5_WORDS[i] == 14:
            np.add(f, bits, out=f)
        turn = MD5_TURNS[i // 16, i % 4]
        np.left_shift(f, turn, out=t)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return a + start[0]


def _in_words(data: np.ndarray) -> np.ndarray:
    r"""Whether each byte of a UTF-8 text belongs to a character that ``\w`` matches."""
    word = np.array([i < 128 and re.match(r"\w", chr(i)) is not None for i in range(256)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for j in (1, 2, 3):
            more = size > j
            point[more] = point[more] << 6 | data[lead[more] + j] & 0x3F
        points, which = np.unique(point, return_inverse=True)
        good = np.array([re.match(r"\w", chr(c)) is not None for c in points.tolist()])[which]
        for j in range(4):
            word[lead[size > j] + j] = good[size > j]
    return word


# ---- exact search -----------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Dense unit rows of a list column whose lists have one length; zero rows stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class _Tile:
    """Some queries of a block and their best ``k`` over the vectors that pass by.

    Pairs are screened in single precision against the ``k``-th best so far, with room for
    its error and the rounding; only those that pass are scored, in double precision. Products and
    marks of all tiles lie in one ``room``: fresh memory for each would cost more than the products.
    """

    def __init__(self, rows: np.ndarray, unit_rows: np.ndarray, k: int, metric: str, decimals: int, room: tuple[np.ndarray, np.ndarray]):
        self.room = room
        self.rows, self.unit, self.l2 = rows, unit_rows, metric != "cosine"
        self.short = unit_rows.astype(np.float32)
        self.square = (unit_rows * unit_rows).sum(1)
        # a product of unit vectors is off by at most dim * 2^-24, twice (vector and bar), doubled for distances
        self.slack = 10.0**-decimals + (8 if self.l2 else 4) * (unit_rows.shape[1] + 4) * 2.0**-24
        self.best, self.k = Best(len(rows), k, decimals), k
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def _candidates(self, short: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, marks = len(self.short) * len(short), self.room[1]
        good = np.matmul(self.short, short.T, out=self.room[0][:n].reshape(len(self.short), len(short)))
        if self.l2:
            good *= 2
            good -= self.square[:, None].astype(np.float32)
            good -= square[None, :].astype(np.float32)
        bar = self.best.bar(good, self.slack).astype(np.float32)
        np.greater_equal(good, bar[:, None], out=marks[:n].reshape(good.shape))
        marks[n : n + 8] = False
        words = np.flatnonzero(marks[: n + -n % 8].view(np.uint64))  # few pairs pass: eight are looked at in one step
        at = (words[:, None] * 8 + np.arange(8)).ravel()
        return np.divmod(at[marks[at]], len(short))

    def add(self, unit_rows: np.ndarray, short: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> None:
        square = (unit_rows * unit_rows).sum(1) if self.l2 else np.zeros(0)
        q_all, v_all = self._candidates(short, square)
        for lo in range(0, len(q_all), CANDIDATES_AT_ONCE):  # many when vectors tie
            q, v = q_all[lo : lo + CANDIDATES_AT_ONCE], v_all[lo : lo + CANDIDATES_AT_ONCE]
            score = np.einsum("ij,ij->i", self.unit[q], unit_rows[v])
            if self.l2:
                score = np.maximum(self.square[q] + square[v] - 2.0 * score, 0.0)
            self.waiting.append((q, -score if self.l2 else score, ids[v], score, keep[v]))
            # the sort is of all that is kept, so it waits for as many new ones once there is a score to beat
            if sum(len(w[0]) for w in self.waiting) >= self.k * len(self.rows) or not np.isfinite(self.best.least).all():
                self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.best.add(*(np.concatenate(c) for c in zip(*self.waiting)))
            self.waiting = []


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _shapes(cols: np.ndarray, lists: pa.Array) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """Row numbers per (collection, dimension); rows without a vector belong to none."""
    dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for name in np.unique(cols):
        for dim in np.unique(dims[cols == name]):
            if dim:
                yield (name, int(dim)), np.flatnonzero((cols == name) & (dims == dim))


class _QueryBlock(NamedTuple):
    """Query ids, and per (collection, dimension) the query numbers and their unit rows."""

    ids: np.ndarray
    groups: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(table: pa.Table) -> _QueryBlock:
        lists = table["embedding"].combine_chunks()
        cols = np.asarray(table["collection"].to_pylist(), dtype=object).astype(str)
        groups = {shape: (rows, _matrix(lists.take(pa.array(rows)))) for shape, rows in _shapes(cols, lists)}
        return _QueryBlock(table["query_id"].to_numpy(), groups)


def _search_batches(
    batches: Iterator[pa.RecordBatch], block: _QueryBlock, k: int, metric: str, decimals: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    most = max(1, min(TILE_QUERIES, len(block.ids)))
    rows = max(1, PAIRS_AT_ONCE // most)
    room = np.empty(most * rows, np.float32), np.zeros(most * rows + 8, bool)
    tiles = {
        shape: [
            _Tile(q_rows[i : i + TILE_QUERIES], q_mat[i : i + TILE_QUERIES], k, metric, decimals, room)
            for i in range(0, len(q_rows), TILE_QUERIES)
        ]
        for shape, (q_rows, q_mat) in block.groups.items()
    }
    for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
        ids, keep = _ids(batch.column(0)), batch.column(3).to_numpy(zero_copy_only=False)
        for shape, v_rows in _shapes(batch.column(1).to_numpy(zero_copy_only=False).astype(str), batch.column(2)):
            if shape in tiles:
                mat = _matrix(batch.column(2).take(pa.array(v_rows)))
                short = mat.astype(np.float32)
                for tile in tiles[shape]:
                    tile.add(mat, short, ids[v_rows], keep[v_rows])
    for tile in (t for some in tiles.values() for t in some):
        tile.settle()
        if tile.best.rows is None:
            continue
        q, _good, ids, score, keep = tile.best.rows
        columns = [pa.array(block.ids[tile.rows[q]].tolist()), pa.array(ids.tolist()), pa.array(score), pa.array(keep)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _cuts(n_q: int, n_v: int, rows: tuple[int, int], cores: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: as few as their size allows, enough for all cores."""
    q_blocks, v_blocks = max(1, math.ceil(n_q / rows[0])), max(1, math.ceil(n_v / rows[1]))
    wanted = min(4 * cores, math.ceil(n_q * n_v / PAIRS_PER_TASK))
    while q_blocks * v_blocks < wanted:
        if n_q / q_blocks > n_v / v_blocks:
            q_blocks *= 2
        else:
            v_blocks *= 2
    return q_blocks, v_blocks


def _search_grid(q: DataFrame, v: DataFrame, n_q: int, k: int, metric: str, decimals: int, out, rows: tuple[int, int]):
    """Every query block meets every vector block in its own bounded task.

    A query moves once per vector block and a vector once per query block, so blocks are large.
    """
    q_blocks, v_blocks = _cuts(n_q, v.count(), rows, q.sparkSession.sparkContext.defaultParallelism)
    # the sides may come from one table: a cogroup of columns with one identity loses them
    q = q.select(*(F.col(c).alias(c) for c in q.columns))
    q_side = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn(
        "_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long")))
    )
    v_side = v.withColumn("_v", F.pmod(F.xxhash64("id"), F.lit(v_blocks))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))
    )
    schema = pa.schema([("query_id", out["query_id"]), ("id", out["id"]), ("score", pa.float64()), ("_keep", pa.bool_())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = schema.empty_table()
        if not (left.num_rows and right.num_rows):
            return empty
        block = _QueryBlock.of(left)
        names = ["id", "collection", "embedding", "_keep"]
        batches = right.select(names).to_batches()
        found = list(_search_batches(iter(batches), block, k, metric, decimals, schema))
        return pa.Table.from_batches(found, schema) if found else empty

    return (
        q_side.groupBy("_q", "_v")
        .cogroup(v_side.groupBy("_q", "_v"))
        .applyInArrow(search, T.StructType([*out["fields"]]))
    )


def exact_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "cosine",
    filters: dict[str, object] | None = None,
    filter_mode: str = "pre",
    decimals: int = 6,
    query_bound: int = QUERY_ROWS_BOUND,
    vector_block: int = VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """Best ``k`` vectors of the query's collection per query.

    ``queries(query_id, embedding[, collection])`` against ``vectors(id,
    embedding[, collection], ...)``. Cosine descending, or squared distance
    of unit vectors ascending (``metric='l2'``), compared at ``decimals``
    digits; ties by id. ``filter_mode='pre'`` filters the scan, ``'post'``
    filters inside the ``k`` hits. A query meets the vectors of its collection
    that have its dimension, whatever others there are; one that meets none finds
    nothing (see ``misfits``).
    """
    if metric not in ("cosine", "l2") or filter_mode not in ("pre", "post"):
        raise ValueError("metric is 'cosine' or 'l2', filter_mode 'pre' or 'post'")

    def with_collection(df: DataFrame) -> DataFrame:
        return df if "collection" in df.columns else df.withColumn("collection", F.lit("default"))

    q = with_collection(queries).select("query_id", "collection", "embedding")
    values = F.coalesce(F.array_size("embedding"), F.lit(0))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.sum(values).alias("values"), F.max(values).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0

    cond = metadata_filter(filters or {})
    v = with_collection(vectors)
    v = v.where(cond) if filter_mode == "pre" else v
    keep = F.coalesce(cond, F.lit(False)) if filter_mode == "post" else F.lit(True)
    v = v.select("id", "collection", "embedding", keep.alias("_keep"))

    q_type, id_type = q.schema["query_id"].dataType, v.schema["id"].dataType
    fields = [
        T.StructField("query_id", q_type),
        T.StructField("id", id_type),
        T.StructField("score", T.DoubleType()),
        T.StructField("_keep", T.BooleanType()),
    ]
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    if q_type not in arrow or id_type not in arrow:
        raise TypeError(f"ids are long, int or string, not {q_type.simpleString()} and {id_type.simpleString()}")
    q_arrow, id_arrow = arrow[q_type], arrow[id_type]

    if n <= query_bound and (size["values"] or 0) * 8 <= QUERY_BYTES_BOUND:
        shared = queries.sparkSession.sparkContext.broadcast(_QueryBlock.of(q.toArrow()))
        schema = pa.schema([("query_id", q_arrow), ("id", id_arrow), ("score", pa.float64()), ("_keep", pa.bool_())])

        def search(batches):
            return _search_batches(batches, shared.value, k, metric, decimals, schema)

        partial = v.mapInArrow(search, T.StructType(fields))
    else:
        out = {"query_id": q_arrow, "id": id_arrow, "fields": fields}
        q_rows = max(1, min(GRID_BLOCKS * query_bound, QUERY_BYTES_BOUND // (8 * max(dim, 1))))
        v_rows = max(1, min(vector_block, QUERY_BYTES_BOUND // (8 * max(dim, 1))))
        partial = _search_grid(q, v, n, k, metric, decimals, out, (q_rows, v_rows))

    scored = partial.withColumn("score", F.round("score", decimals))
    order = [F.col("score").desc() if metric == "cosine" else F.col("score").asc(), F.col("id").asc()]
    hits = top_per_group(scored, ["query_id"], order, k)
    if filter_mode == "post":
        hits = top_per_group(hits.where("_keep").drop("rank"), ["query_id"], order, k)
    return hits.drop("_keep")


def misfits(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Queries that no stored vector fits: query_id, dimension, reason.

    The reason is ``no vector``, ``unknown collection`` or ``dimension``. Only the
    short table of collections and their dimensions meets the queries.
    """

    named = "collection" in queries.columns or "collection" in vectors.columns
    on = ["collection"] if named else []

    def shaped(df: DataFrame) -> DataFrame:
        df = df.withColumn("collection", F.lit("default")) if named and "collection" not in df.columns else df
        return df.withColumn("dimension", F.coalesce(F.array_size("embedding"), F.lit(0)))

    kept = shaped(vectors).where("dimension > 0").groupBy(*on, "dimension").agg(F.lit(True).alias("_fits"))
    asked = shaped(queries).select("query_id", *on, "dimension").join(kept, [*on, "dimension"], "left").where("_fits IS NULL")
    reason = F.when(F.col("dimension") == 0, "no vector")
    if named:
        asked = asked.join(kept.groupBy("collection").agg(F.lit(True).alias("_known")), "collection", "left")
        reason = reason.when(F.col("_known").isNull(), "unknown collection")
    reason = reason.otherwise("dimension")
    return asked.select("query_id", F.col("dimension").cast("long").alias("dimension"), reason.alias("reason"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = exact.select("query_id", "id").join(
        approximate.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left"
    )
    return found.agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found")).withColumn(
        "recall", F.col("found") / F.col("expected")
    )

