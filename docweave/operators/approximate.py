"""Approximate vector search over an inverted file of coarse centroids (R7), and the
nearest-neighbour graph that is joined list by list (N2).

Vectors are stored in lists, one per centroid, as partitions of a table. A query reads
only the lists whose centroids are nearest to it. Inside them rows are screened by their
leading principal components: a row is taken to reach its partial score plus
``TAIL_COSINE`` of the product of the remaining lengths, and is scored in full, exactly,
only if that can enter the best ``k``. Small query sets travel to the lists as one
broadcast block. Larger ones, and the graph of all vectors with themselves, are shuffled
by area, some lists that lie together: a vector moves once and a query once per area, not
per list; large areas are cut into chunks of bounded size. There products in single
precision are the screen, which misses nothing, and in the graph a pair counts for both.

Centroids and components are fitted on a bounded sample; every vector is stored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.ranks import top_per_group
from docweave.session import work_path

# tasks receive the kernels below inside the job, so no worker has to install this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows and numbers of the sample that centroids and components are fitted on.
SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 8 << 20
MAX_LISTS = 1024
ROUNDS = 8
#: Share of the dimensions that the screen looks at.
HEAD = 0.5
#: The remaining parts of two vectors are taken to have no larger cosine; 1 makes the screen exact.
TAIL_COSINE = 0.55
PROBES = 24
#: Share of the probed lists that are searched first, for the score to beat in the others.
FIRST = 0.25
QUERY_ROWS = 4096
QUERY_VALUES = 4 << 20
#: Rows of an area that one task of the shuffled search holds, and how many times as many queries.
CHUNK_ROWS = 16_384
QUERY_CHUNKS = 8
PAIRS_AT_ONCE = 2_000_000
#: Queries and rows that are multiplied at once in the shuffled search, in buffers that are made once.
TILE = (512, 512)
#: The share of vectors farthest from their neighbours, and how many times the lists they probe in the graph.
FAR_SHARE = 0.1
FAR_PROBES = 4
#: Below every cosine: the score to beat of a query that has none yet.
NO_BAR = -2.0
SLACK = 1e-5


class Space(NamedTuple):
    """Vectors of one dimension: number of the first list, centroids, principal axes."""

    first: int
    centroids: np.ndarray
    axes: np.ndarray

    @property
    def head(self) -> int:
        return max(1, round(self.axes.shape[1] * HEAD))


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def dense(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Unit rows of a list column at the given places, which have one length."""
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(rows), -1))


def nearest(m: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centroids of each row, nearest first."""
    short, probes = centroids.T.astype(np.float32), min(probes, len(centroids))
    out = np.empty((len(m), probes), np.int64)
    room = np.empty((min(len(m), TILE[0]), len(centroids)), np.float32)
    for lo in range(0, len(m), TILE[0]):
        part = m[lo : lo + TILE[0]].astype(np.float32)
        good = np.matmul(part, short, out=room[: len(part)])
        if probes == 1:
            out[lo : lo + len(part), 0] = good.argmax(1)
            continue
        best = np.argpartition(good, len(centroids) - probes, axis=1)[:, len(centroids) - probes :]
        order = np.argsort(-np.take_along_axis(good, best, 1), axis=1, kind="stable")
        out[lo : lo + len(part)] = np.take_along_axis(best, order, 1)
    return out


def fit(sample: np.ndarray, lists: int, first: int) -> Space:
    """Centroids by spherical k-means and the axes of the sample, the widest first."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centroids)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    return Space(first, centroids, axes)


def _shapes(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Dimensions and the rows that have them; rows without a vector belong to none."""
    dims = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(dims[dims > 0]):
        yield int(dim), np.flatnonzero(dims == dim)


def _listed(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each vector with its list, leading components, and the length of the rest."""
    for batch in batches:
        vectors = batch.column("embedding")
        for dim, rows in _shapes(vectors):
            if dim not in spaces:
                continue
            space, m = spaces[dim], dense(vectors, rows)
            spread = m @ space.axes
            head, tail = spread[:, : space.head], np.linalg.norm(spread[:, space.head :], axis=1)
            found = space.first + nearest(m, space.centroids, 1)[:, 0]
            kept = [batch.column(n).take(pa.array(rows)) for n in batch.schema.names]
            heads = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * space.head), pa.array(head.ravel().astype(np.float32)))
            columns = [*kept, pa.array(found.astype(np.int32)), heads, pa.array(tail.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


class _Best:
    """Best ``k`` hits per query, in numpy."""

    def __init__(self, n: int, k: int, least: np.ndarray, decimals: int) -> None:
        self.k, self.decimals, self.least = k, decimals, least.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.n = 0, n

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.rows.append((q, np.round(score, self.decimals), ids))
            self.size += len(q)
        if self.size > 1.25 * self.k * self.n:
            self.prune()

    def add_block(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """All pairs of some queries with some rows; only those that can be among the best ``k`` are kept."""
        n = len(ids)
        if n > self.k:
            last = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            self.least[q] = np.maximum(self.least[q], np.round(last, self.decimals))
            a, b = np.nonzero(scores >= last[:, None] - 10.0**-self.decimals)
        else:
            a, b = (x.ravel() for x in np.indices(scores.shape))
        self.add(q[a], scores[a, b], ids[b])

    def prune(self) -> None:
        if not self.rows:
            return
        q, score, ids = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        keep = place < self.k
        self.rows, self.size = [(q[keep], score[keep], ids[keep])], int(keep.sum())


class _Packed(_Best):
    """Best ``k`` hits per query as sorted numbers: the query, then the score downwards, then the id's place.

    For places below ``ids``; the sort of plain numbers is many times faster than that of three columns.
    """

    def __init__(self, n: int, k: int, least: np.ndarray, decimals: int, ids: int) -> None:
        super().__init__(n, k, least, decimals)
        self.most, self.id_bits = round(1.5 * 10**decimals), int(ids).bit_length()
        self.low_bits = self.id_bits + (2 * self.most).bit_length()
        self.keys: list[np.ndarray] = []
        if self.low_bits + int(n).bit_length() > 63:
            raise ValueError("too many queries, rows or decimals for one chunk")

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        away = self.most - np.rint(score * 10**self.decimals).astype(np.int64)
        self.keys.append(q << self.low_bits | away << self.id_bits | ids)
        self.size += len(q)
        if self.size > 1.5 * self.k * self.n:
            self.prune()

    def prune(self) -> None:
        if not self.keys:
            return
        keys = np.sort(np.concatenate(self.keys))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]  # a pair may be met from both its ends
        q = keys >> self.low_bits
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keys, q, last = keys[place < self.k], q[place < self.k], place[place < self.k] == self.k - 1
        score = (self.most - (keys >> self.id_bits & ((1 << self.low_bits - self.id_bits) - 1))) / 10**self.decimals
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        self.keys, self.size = [keys], len(keys)
        self.rows = [(q, score, keys & ((1 << self.id_bits) - 1))]


class _Queries(NamedTuple):
    """A block of queries: ids, collections, probed lists, unit vectors per dimension, scores to beat."""

    ids: list
    collections: np.ndarray
    lists: dict[int, np.ndarray]
    rows: dict[int, tuple[np.ndarray, np.ndarray]]
    least: np.ndarray

    def matrix(self, dim: int, which: np.ndarray) -> np.ndarray:
        at, m = self.rows[dim]
        return m[np.searchsorted(at, which)]


def _screened(space: Space, q: np.ndarray, least: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may reach the query's score to beat."""
    spread = q @ space.axes
    rest = np.linalg.norm(spread[:, space.head :], axis=1)
    bound = spread[:, : space.head] @ heads.T + TAIL_COSINE * rest[:, None] * tails[None, :]
    return np.nonzero(bound + SLACK >= least[:, None])


def _scan(batch: pa.RecordBatch, queries: _Queries, spaces: dict[int, Space], best: _Best, counts: list[int]) -> None:
    """Score rows of stored lists against the queries that probe them."""
    lists = batch.column("list").to_numpy(zero_copy_only=False)
    names = np.array(batch.column("collection").to_pylist(), object).astype(str)
    ids = np.array(batch.column("id").to_pylist(), object)
    vectors, heads, tails = batch.column("embedding"), batch.column("head"), batch.column("tail").to_numpy()
    for dim, rows in _shapes(vectors):
        if dim not in queries.rows:
            continue
        for number in np.unique(lists[rows]):
            asked = queries.lists.get(int(number))
            if asked is None:
                continue
            for name in np.unique(queries.collections[asked]):
                mine = asked[queries.collections[asked] == name]
                there = rows[(lists[rows] == number) & (names[rows] == name)]
                step = max(1, PAIRS_AT_ONCE // max(1, len(mine)))
                for lo in range(0, len(there), step):
                    part, mine = there[lo : lo + step], asked[queries.collections[asked] == name]
                    q, m = queries.matrix(dim, mine), dense(vectors, part)
                    counts[0] += len(mine) * len(part)
                    fresh = best.least[mine] <= NO_BAR
                    if fresh.any():  # no score to beat yet: all their pairs are scored, the best of them go on
                        counts[1] += int(fresh.sum()) * len(part)
                        best.add_block(mine[fresh], q[fresh] @ m.T, ids[part])
                        mine, q = mine[~fresh], q[~fresh]
                    short = heads.take(pa.array(part)).flatten().to_numpy().reshape(len(part), -1).astype(np.float64)
                    a, b = _screened(spaces[dim], q, best.least[mine], short, tails[part].astype(np.float64))
                    counts[1] += len(a)
                    best.add(mine[a], np.einsum("ij,ij->i", q[a], m[b]), ids[part[b]])


def _hits(best: _Best, queries: _Queries, counts: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """Hits, and one row without ids that carries the counts of pairs scanned and scored."""
    best.prune()
    q, score, ids = best.rows[0] if best.rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
    columns = [
        pa.array([*(queries.ids[i] for i in q), None], schema.field(0).type),
        pa.array([*ids.tolist(), None], schema.field(1).type),
        pa.array([*score.tolist(), None], pa.float64()),
        pa.array([0] * len(q) + counts[:1], pa.int64()),
        pa.array([0] * len(q) + counts[1:], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _block(table: pa.Table, spaces: dict[int, Space], k_least: str | None = None) -> _Queries:
    """Queries of a table with query_id, collection, embedding, and lists to probe."""
    table = table.combine_chunks()
    vectors = table["embedding"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float32()))
    rows = {dim: (at, dense(vectors, at)) for dim, at in _shapes(vectors) if dim in spaces}
    lists: dict[int, list[int]] = {}
    for i, probed in enumerate(table["lists"].to_pylist()):
        for number in probed or ():
            lists.setdefault(number, []).append(i)
    least = np.array([NO_BAR if x is None else x for x in table["least"].to_pylist()])
    names = np.array(table["collection"].to_pylist(), object).astype(str)
    return _Queries(table["query_id"].to_pylist(), names, {n: np.array(x) for n, x in lists.items()}, rows, least)


def _probed(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space], probes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Queries with the numbers of their nearest lists, nearest first; those that fit no list go."""
    for batch in batches:
        for dim, rows in _shapes(batch.column("embedding")):
            if dim in spaces:
                near = nearest(dense(batch.column("embedding"), rows), spaces[dim].centroids, probes) + spaces[dim].first
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), lists], schema=schema)


def _areas(spaces: dict[int, Space], sizes: dict[int, int], most: int) -> list[int]:
    """The area of each list: lists that lie together, with at most ``most`` rows if they are several; -1 without rows."""
    out = [-1] * max((s.first + len(s.centroids) for s in spaces.values()), default=0)
    number = 0
    for space in spaces.values():
        n = np.array([sizes.get(space.first + i, 0) for i in range(len(space.centroids))])
        todo = [np.flatnonzero(n)] if n.any() else []
        while todo:
            part = todo.pop()
            if len(part) == 1 or n[part].sum() <= most:
                for i in part.tolist():
                    out[space.first + i] = number
                number += 1
                continue
            m = space.centroids[part]
            one = m[(m @ m[0]).argmin()]  # two that lie far apart give the direction to cut
            order = part[np.argsort(m @ (m[(m @ one).argmin()] - one), kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(n[order]), n[part].sum() / 2), 1, len(part) - 1))
            todo += [order[:half], order[half:]]
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def _few_copies(m: np.ndarray, ids: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Rows by group and vector without those that have ``k`` equals of a smaller id in their group: no search finds them."""
    mark = (m * np.random.default_rng(5).standard_normal(m.shape[1])).sum(1)
    order = np.lexsort((ids, mark, group))
    same = (group[order[1:]] == group[order[:-1]]) & (mark[order[1:]] == mark[order[:-1]])
    at = np.flatnonzero(same)
    same[at] = (m[order[at + 1]] == m[order[at]]).all(1)
    starts = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


class _Meeting:
    """Queries and rows of one chunk: tiles of products in single precision, candidates scored in double."""

    def __init__(self, best: _Best, dim: int) -> None:
        self.best, self.counts = best, [0, 0]
        self.slack = 10.0**-best.decimals + 4 * (dim + 4) * 2.0**-24
        self.room, self.mark = np.empty(TILE[0] * TILE[1], np.float32), np.zeros(TILE[0] * TILE[1] + 8, bool)
        self.other = np.empty(TILE[0] * TILE[1], bool)

    def _bars(self, good: np.ndarray, who: np.ndarray, axis: int) -> np.ndarray:
        """What a pair must reach for the ends ``who``; the first look at many pairs gives a bar to an end without one."""
        best, n = self.best, good.shape[axis]
        fresh = np.flatnonzero(best.least[who] <= NO_BAR)
        if len(fresh) and n > best.k:
            some = good[fresh] if axis else good[:, fresh].T
            last = np.partition(some, n - best.k, axis=1)[:, n - best.k]
            best.least[who[fresh]] = np.maximum(NO_BAR, last - self.slack)
        return (best.least[who] - self.slack).astype(np.float32)

    def tile(self, q: np.ndarray, q_short: np.ndarray, q_who: np.ndarray, q_code: np.ndarray, v: np.ndarray, v_short: np.ndarray, v_who: np.ndarray, v_code: np.ndarray) -> None:
        """Pairs of some queries and rows; ``v_who`` has the rows' places among the best, or is empty."""
        n = len(q) * len(v)
        good = np.matmul(q_short, v_short.T, out=self.room[:n].reshape(len(q), len(v)))
        mark = self.mark[:n].reshape(good.shape)
        np.greater_equal(good, self._bars(good, q_who, 1)[:, None], out=mark)
        if len(v_who):
            mark |= np.greater_equal(good, self._bars(good, v_who, 0)[None, :], out=self.other[:n].reshape(good.shape))
        self.mark[n : n + 8] = False
        self.counts[0] += n
        if np.count_nonzero(mark) < n >> 6:  # few pairs pass: eight are looked at in one step
            words = np.flatnonzero(self.mark[: n + -n % 8].view(np.uint64))
            at = (words[:, None] * 8 + np.arange(8)).ravel()
            at = at[self.mark[at]]
        else:
            at = np.flatnonzero(mark)
        self.counts[1] += len(at)
        for lo in range(0, len(at), 1 << 17):  # many when vectors tie
            a, b = np.divmod(at[lo : lo + (1 << 17)], len(v))
            score = np.round(np.einsum("ij,ij->i", q[a], v[b]), self.best.decimals)
            keep = score >= self.best.least[q_who[a]]  # of those that only the other end wanted, few
            self.best.add(q_who[a[keep]], score[keep], v_code[b[keep]])
            if len(v_who):
                keep = score >= self.best.least[v_who[b]]
                self.best.add(v_who[b[keep]], score[keep], q_code[a[keep]])


def _met(left: pa.Table, right: pa.Table, spaces: dict[int, Space], k: int, decimals: int, own: bool, schema: pa.Schema) -> pa.Table:
    """Hits of queries (query_id, collection, embedding, lists, least) among rows (id, collection, embedding, list, least).

    With ``own`` both are vectors of one table: a pair is a hit of either end. The last row has the counts.
    """
    if not (left.num_rows and right.num_rows):
        return schema.empty_table()
    n, asking, stored = left.num_rows, _ids(left["query_id"]), _ids(right["id"])
    if own:
        names, code = np.unique(np.concatenate([asking, stored]), return_inverse=True)
        enders, q_who, q_code, v_code = names, code[:n], code[:n], code[n:]
    else:
        names, v_code = np.unique(stored, return_inverse=True)
        enders, q_who, q_code = asking, np.arange(n), np.zeros(n, np.int64)
    least = np.full(len(enders), NO_BAR)
    for who, side in ((q_who, left), (v_code, right))[: 1 + own]:
        least[who] = pa.compute.fill_null(side["least"], NO_BAR).to_numpy()
    _, place = np.unique(np.concatenate([_ids(left["collection"]), _ids(right["collection"])]), return_inverse=True)
    best, counts = _Packed(len(enders), k, least, decimals, len(names)), np.zeros(2, np.int64)
    q_all, v_all = left["embedding"].combine_chunks(), right["embedding"].combine_chunks()
    q_lists, listed = left["lists"].combine_chunks(), right["list"].to_numpy()
    rows_of = dict(_shapes(v_all))
    for dim, q_rows in _shapes(q_all):
        if dim not in rows_of or dim not in spaces:
            continue
        space, v_rows = spaces[dim], rows_of[dim]
        group = place[n:][v_rows] * len(space.centroids) + listed[v_rows] - space.first
        m = dense(v_all, v_rows)
        order = _few_copies(m, v_code[v_rows], group, k)
        m, v_rows, group = m[order], v_rows[order], group[order]
        q, probed = dense(q_all, q_rows), q_lists.take(pa.array(q_rows))
        lengths = probed.value_lengths().to_numpy()
        asked = np.repeat(np.arange(len(q_rows)), lengths)
        wanted = np.repeat(place[:n][q_rows], lengths) * len(space.centroids) + probed.flatten().to_numpy() - space.first
        by = np.argsort(wanted, kind="stable")
        asked, wanted = asked[by], wanted[by]
        meeting, q_short, v_short = _Meeting(best, dim), q.astype(np.float32), m.astype(np.float32)
        for number in np.unique(group):
            lo, hi = np.searchsorted(group, [number, number + 1])
            mine = asked[slice(*np.searchsorted(wanted, [number, number + 1]))]
            for i in range(0, len(mine), TILE[0]):
                a = mine[i : i + TILE[0]]
                qs, ends, codes, short = q[a], q_who[q_rows[a]], q_code[q_rows[a]], q_short[a]
                for j in range(lo, hi, TILE[1]):
                    to = min(hi, j + TILE[1])
                    there = v_code[v_rows[j:to]]
                    meeting.tile(qs, short, ends, codes, m[j:to], v_short[j:to], there if own else there[:0], there)
        counts += meeting.counts
    best.prune()
    q, score, ids = best.rows[0] if best.rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    columns = [pa.array(enders[q].tolist(), schema.field(0).type), pa.array(names[ids].tolist(), schema.field(1).type), pa.array(score)]
    hits = pa.table([*columns, pa.array(np.zeros(len(q), np.int64)), pa.array(np.zeros(len(q), np.int64))], schema=schema)
    total = pa.table([pa.array([x], f.type) for x, f in zip((None, None, None, *counts.tolist()), schema)], schema=schema)
    return pa.concat_tables([hits, total])


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _with_collection(df: DataFrame) -> DataFrame:
    return df if "collection" in df.columns else df.withColumn("collection", F.lit("default"))


def _kind(df: DataFrame, name: str) -> pa.DataType:
    kind = df.schema[name].dataType.simpleString()
    if kind not in _KINDS:
        raise TypeError(f"ids are long, int or string, not {kind}")
    return _KINDS[kind]


class CentroidIndex:
    """Vectors stored by list; ``spaces`` per dimension."""

    def __init__(self, rows: DataFrame, spaces: dict[int, Space]) -> None:
        self.rows, self.spaces = rows, spaces

    def areas(self) -> tuple[Column, dict[int, int]]:
        """The area of each list, as an array with the lists' numbers as places, and the rows per area."""
        spark = self.rows.sparkSession
        sizes = {r["list"]: r["n"] for r in self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        # smaller ones where few rows have to serve all cores
        fair = -(-sum(sizes.values()) // (3 * spark.sparkContext.defaultParallelism))
        found = _areas(self.spaces, sizes, max(1, min(CHUNK_ROWS, fair)))
        rows: dict[int, int] = {}
        for number, n in sizes.items():
            rows[found[number]] = rows.get(found[number], 0) + n
        return F.lit(found or [-1]), rows

    def _search(self, queries: DataFrame, block: _Queries, k: int, decimals: int, schema: pa.Schema, out: T.StructType) -> DataFrame:
        """Hits of a small block of queries in the lists they name."""
        spaces = self.spaces
        shared = queries.sparkSession.sparkContext.broadcast(block)
        near = self.rows.where(F.col("list").isin(sorted(block.lists)))  # partitions of the table

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, counts = _Best(len(shared.value.ids), k, shared.value.least, decimals), [0, 0]
            for batch in batches:
                _scan(batch, shared.value, spaces, best, counts)
            yield _hits(best, shared.value, counts, schema)

        return near.mapInArrow(scan, out)

    def _meet(self, queries: DataFrame, k: int, decimals: int, schema: pa.Schema, out: T.StructType, own: DataFrame | None = None) -> DataFrame:
        """Hits of many queries (query_id, collection, embedding, lists, least): they meet the rows by area.

        ``own`` (query_id, least) has the scores to beat of queries that are the rows themselves; pairs are then hits of both ends.
        """
        spark, spaces = queries.sparkSession, self.spaces
        area_of, stored = self.areas()
        area = F.explode(F.array_distinct(F.transform("lists", lambda n: F.element_at(area_of, n + 1))))
        asked = queries.select("query_id", "collection", "embedding", "lists", "least", area.alias("area")).where("area >= 0")
        asking = asked.groupBy("area").agg(F.count(F.lit(1)).alias("n")).collect()
        rows = [(r["area"], -(-stored[r["area"]] // CHUNK_ROWS), -(-r["n"] // (QUERY_CHUNKS * CHUNK_ROWS))) for r in asking]
        cuts = lambda: F.broadcast(spark.createDataFrame(rows, "area int, _v long, _q long"))  # noqa: E731  one row per area
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        q = asked.join(cuts(), "area").withColumn("_qc", F.pmod(F.xxhash64("query_id"), F.col("_q"))).withColumn("_vc", every("_v"))
        v = self.rows.select("id", "collection", "embedding", "list", F.element_at(area_of, F.col("list") + 1).alias("area"))
        both = own is not None
        v = v.join(own.select(F.col("query_id").alias("id"), "least"), "id", "left") if both else v.withColumn("least", F.lit(None).cast("double"))
        v = v.join(cuts(), "area").withColumn("_vc", F.pmod(F.xxhash64("id"), F.col("_v"))).withColumn("_qc", every("_q"))
        q = q.select(*(F.col(c).alias(c) for c in q.columns))  # both sides may come from one table
        # a task per chunk whatever its bytes: the work goes with the pairs
        keys, tasks = ["area", "_vc", "_qc"], max(1, 2 * sum(r[1] * r[2] for r in rows))
        met = lambda left, right: _met(left, right, spaces, k, decimals, both, schema)
        return q.repartition(tasks, *keys).groupBy(*keys).cogroup(v.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(met, out)

    def topk(self, queries: DataFrame, k: int, probes: int = PROBES, decimals: int = 6, own: bool = False, skip: int = 0) -> tuple[DataFrame, DataFrame]:
        """Hits ``query_id, id, score, rank`` and ``scanned, scored`` pairs.

        ``queries(query_id, embedding[, collection])`` meet the vectors of their collection and
        dimension in the ``probes`` nearest lists. Of a small set the nearest of them come first and give
        each query the score to beat in the others. Scores are exact; ties by id.

        ``own`` is for queries that are the vectors of the index themselves: a pair is then a hit of both
        its ends, and those of one list come first. Without the ``skip`` nearest lists, and only hits that reach a score ``least`` of the
        query where there is one, a search that was made before is continued.
        """
        spaces = self.spaces
        q = _with_collection(queries)
        q = q.select("query_id", "collection", "embedding", (F.col("least") if "least" in q.columns else F.lit(None)).cast("double").alias("least"))
        schema = pa.schema([("query_id", _kind(q, "query_id")), ("id", _kind(self.rows, "id")), ("score", pa.float64()), ("scanned", pa.int64()), ("scored", pa.int64())])
        out = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", self.rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("scanned", T.LongType()), T.StructField("scored", T.LongType())])
        typed = T.StructType([*q.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
        arrow = pa.schema([("query_id", _kind(q, "query_id")), ("collection", pa.string()), ("embedding", pa.list_(pa.float32() if "float" in q.schema["embedding"].dataType.simpleString() else pa.float64())), ("least", pa.float64()), ("lists", pa.list_(pa.int32()))])
        probed = q.mapInArrow(lambda it: _probed((b.cast(pa.schema(list(arrow)[:4])) for b in it), spaces, skip + probes, arrow), typed)
        probed = _stored(probed, "probed")

        order = [F.col("score").desc(), F.col("id").asc()]
        size = probed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.array_size("embedding")), F.lit(0))).first()
        if own:  # all vectors of a list meet first, and bring scores to beat to the other lists
            home = probed.withColumn("lists", F.slice("lists", 1, 1))
            first = _stored(self._meet(home, k, decimals, schema, out), "nearest")
            last = top_per_group(first.where("id IS NOT NULL"), ["query_id"], order, k).where(F.col("rank") == k)
            last = _stored(last.select("query_id", F.col("score").alias("least")), "least")
            others = probed.drop("least").withColumn("lists", F.slice("lists", 2, max(1, probes - 1))).join(last, "query_id", "left")
            both = first.unionByName(_stored(self._meet(others, k, decimals, schema, out, last), "others"))
            # a query meets a list once, but a pair may be found from both its ends
            hits = both.where("id IS NOT NULL").repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
            return top_per_group(hits, ["query_id"], order, k), _sums(both)
        if skip or size[0] > QUERY_ROWS or size[1] > QUERY_VALUES:
            asked = probed.withColumn("lists", F.slice("lists", skip + 1, probes)) if skip else probed
            hits = _stored(self._meet(asked, k, decimals, schema, out), "hits")
            return top_per_group(hits.where("id IS NOT NULL").drop("scanned", "scored"), ["query_id"], order, k), _sums(hits)
        early = max(1, round(probes * FIRST))
        nearby = probed.withColumn("lists", F.slice("lists", 1, early))
        first = _stored(self._search(nearby, _block(nearby.toArrow(), spaces), k, decimals, schema, out), "nearest")
        if probes <= early:
            return top_per_group(first.where("id IS NOT NULL").drop("scanned", "scored"), ["query_id"], order, k), _sums(first)
        full = top_per_group(first.where("id IS NOT NULL"), ["query_id"], order, k).where(F.col("rank") == k)
        others = probed.drop("least").withColumn("lists", F.expr(f"slice(lists, {early + 1}, greatest(size(lists) - {early}, 0))"))
        others = others.join(full.select("query_id", F.col("score").alias("least")), "query_id", "left")
        rest = _stored(self._search(others, _block(others.toArrow(), spaces), k, decimals, schema, out), "others")
        both = first.unionByName(rest)
        return top_per_group(both.where("id IS NOT NULL").drop("scanned", "scored"), ["query_id"], order, k), _sums(both)


def _sums(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None) -> CentroidIndex:
    """Store ``vectors(id, embedding[, collection])`` in lists; about twice the square root of their number by default.

    Rows without a vector are left out. The sample has at most ``SAMPLE_ROWS`` rows per
    dimension, chosen by a hash of the id. Long lists are written by many tasks.
    """
    spark = vectors.sparkSession
    path = path or work_path(spark, "lists")
    # read for sizes, samples and lists; what makes them may be costly, and a filter would make them twice
    rows = _stored(_with_collection(vectors).select("id", "collection", "embedding"), "vectors")
    rows = rows.where(F.array_size("embedding") > 0)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.array_size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    spaces, first = {}, 0
    for dim, n in sorted(sizes.items()):
        most = min(SAMPLE_ROWS, max(256, SAMPLE_VALUES // dim))
        drawn = rows.where((F.array_size("embedding") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // most)))) == 0))
        table = drawn.select("embedding").limit(2 * most).toArrow().combine_chunks()
        if not table.num_rows:  # a handful of ids that all fall out of the sample
            table = rows.where(F.array_size("embedding") == dim).select("embedding").limit(most).toArrow().combine_chunks()
        sample = dense(table["embedding"].chunk(0), np.arange(table.num_rows))
        wanted = lists or max(1, min(MAX_LISTS, round(2 * n**0.5), -(-len(sample) // 4)))
        spaces[dim] = fit(sample, wanted, first)
        first += len(spaces[dim].centroids)
    out = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("head", T.ArrayType(T.FloatType())), T.StructField("tail", T.FloatType())])
    real = pa.float32() if "float" in rows.schema["embedding"].dataType.simpleString() else pa.float64()
    schema = pa.schema([("id", _kind(rows, "id")), ("collection", pa.string()), ("embedding", pa.list_(real)), ("list", pa.int32()), ("head", pa.list_(pa.float32())), ("tail", pa.float32())])
    listed = rows.mapInArrow(lambda it: _listed(it, spaces, schema), out)
    chunks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-sum(sizes.values()) // (max(1, first) * CHUNK_ROWS)))))
    listed.repartition("list", chunks).write.partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(path)
    return open_index(spark, path, out, spaces)


def open_index(spark: SparkSession, path: str, schema: T.StructType, spaces: dict[int, Space]) -> CentroidIndex:
    return CentroidIndex(spark.read.schema(schema).parquet(path), spaces)


def approximate_topk(queries: DataFrame, vectors: DataFrame, k: int, probes: int = PROBES, lists: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Index ``vectors`` and search them; hits and counts as in ``CentroidIndex.topk``."""
    return build(vectors, lists=lists).topk(queries, k, probes)


def neighbour_graph(vectors: DataFrame, k: int, probes: int = PROBES, rounds: int = 1, lists: int | None = None) -> DataFrame:
    """``source, target, score``: about the ``k`` nearest others of every vector.

    Areas of lists meet the vectors that probe them; vectors far from what they found there
    probe more lists. Then neighbours of neighbours that are not linked yet are scored,
    ``rounds`` times. Score 6 digits, ties by id.
    """
    index = build(vectors, lists=lists)
    asked = index.rows.select(F.col("id").alias("query_id"), "collection", "embedding")
    hits, _ = index.topk(asked, k + 1, probes, own=True)
    links = _stored(_links(hits, k), "neighbours")
    if max((len(s.centroids) for s in index.spaces.values()), default=0) > probes:
        last = links.where(F.col("rank") == k).select(F.col("source").alias("query_id"), F.col("score").alias("least"))
        bar = last.agg(F.percentile_approx("least", FAR_SHARE)).first()[0]
        far = asked.join(last, "query_id", "left").where(F.col("least").isNull() | (F.col("least") < F.lit(bar)))
        more, _ = index.topk(far, k + 1, (FAR_PROBES - 1) * probes, skip=probes)
        links = _stored(_links(more, k, links), "neighbours")
    for _ in range(rounds):
        links = _stored(_links(_around(index, links, k), k, links), "neighbours")
    return links.drop("rank")


def _links(hits: DataFrame, k: int, links: DataFrame | None = None) -> DataFrame:
    """``source, target, score, rank``: the best ``k`` others among hits (query_id, id, score) and links found before."""
    found = hits.where(F.col("query_id") != F.col("id")).select(F.col("query_id").alias("source"), F.col("id").alias("target"), "score")
    if links is not None:
        found = found.unionByName(links.select("source", "target", "score"))
        found = found.repartition("source").groupBy("source", "target").agg(F.max("score").alias("score"))
    return top_per_group(found, ["source"], [F.col("score").desc(), F.col("target").asc()], k)


def _around(index: CentroidIndex, links: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: pairs around a common neighbour that would be new links.

    Members of a middle vector are its neighbours, those that name it as theirs, and itself. All of
    them meet its neighbours, itself, and at most ``k`` of those that name it, which stand for a hub.
    Middles are dealt by area, so that a vector moves once per area, not once per pair.
    """
    spark, spaces = links.sparkSession, index.spaces
    area_of, _ = index.areas()
    area = F.element_at(area_of, F.col("list") + 1).alias("area")
    by = Window.partitionBy("target").orderBy(F.xxhash64("source", "target"))
    named = links.select(F.col("target").alias("middle"), F.col("source").alias("member"), (F.row_number().over(by) <= k).alias("end"))
    edges = links.select(F.col("source").alias("middle"), F.col("target").alias("member"), F.lit(True).alias("end")).unionByName(named)
    edges = _stored(edges.join(index.rows.select(F.col("id").alias("middle"), area), "middle"), "edges")
    itself = index.rows.select(F.col("id").alias("middle"), F.col("id").alias("member"), F.lit(True).alias("end"), area)
    edges = edges.unionByName(itself)

    # an area that holds a hub is cut by those that name it; what they meet goes to all parts
    sizes = edges.groupBy("area").agg(F.count_if(~F.col("end")).alias("n")).collect()
    cuts = [(r["area"], max(1, -(-r["n"] // (QUERY_CHUNKS * CHUNK_ROWS)))) for r in sizes]
    parts = F.when(F.col("end"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("_n"))))
    edges = edges.join(F.broadcast(spark.createDataFrame(cuts, "area int, _n long")), "area").withColumn("part", F.explode(parts)).drop("_n")
    near = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), F.col("target").alias("id"))))
    known = links.groupBy(F.col("source").alias("member")).agg(near.alias("near"))
    known = known.select("member", F.col("near.id").alias("known"), (-F.element_at("near.away", -1)).alias("last"))
    nodes = index.rows.select(F.col("id").alias("member"), "embedding").join(known, "member", "left")
    nodes = edges.select("area", "part", "member").distinct().join(nodes, "member")

    keys, tasks = ["area", "part"], max(1, 2 * sum(n for _, n in cuts))
    ends = index.rows.schema["id"].dataType
    out = T.StructType([T.StructField("query_id", ends), T.StructField("id", ends), T.StructField("score", T.DoubleType())])
    kind = _kind(index.rows, "id")
    schema = pa.schema([("query_id", kind), ("id", kind), ("score", pa.float64())])
    paired = lambda left, right: _paired(left, right, k, schema)
    left = edges.select(*keys, "middle", "member", "end").repartition(tasks, *keys)
    # columns of their own, as both sides come from the edges
    right = nodes.select(F.col("area").alias("area"), F.col("part").alias("part"), F.col("member").alias("id"), "embedding", "known", "last")
    return left.groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(paired, out)


def _paired(edges: pa.Table, nodes: pa.Table, k: int, schema: pa.Schema, decimals: int = 6) -> pa.Table:
    """Pairs of members and ends of one middle that are better than the last link of the member and no link yet."""
    if not (edges.num_rows and nodes.num_rows):
        return schema.empty_table()
    nodes = nodes.take(pa.array(np.argsort(_ids(nodes["id"]), kind="stable")))
    ids, m = _ids(nodes["id"]), dense(nodes["embedding"].combine_chunks(), np.arange(nodes.num_rows))
    short, slack = m.astype(np.float32), 10.0**-decimals + 4 * (m.shape[1] + 4) * 2.0**-24
    lists = nodes["known"].combine_chunks()
    lengths = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    known = np.repeat(ids[:, None], k, axis=1)  # no vector meets itself, so its own id fills a short row
    known[np.arange(k)[None, :] < lengths[:, None]] = _ids(pa.chunked_array([lists.flatten()]))
    full = lengths == k
    least = np.where(full, pa.compute.fill_null(nodes["last"].combine_chunks(), 0.0).to_numpy(zero_copy_only=False), NO_BAR)

    _, middle = np.unique(_ids(edges["middle"]), return_inverse=True)
    order = np.argsort(middle, kind="stable")
    middle, member = middle[order], np.searchsorted(ids, _ids(edges["member"])[order])
    end = edges["end"].to_numpy()[order].astype(bool)
    met, starts = member[end], np.searchsorted(middle[end], np.arange(middle[-1] + 2))
    found = []
    for lo in range(0, len(member), 1 << 14):
        there = middle[lo : lo + (1 << 14)]
        n = starts[there + 1] - starts[there]
        a = np.repeat(member[lo : lo + (1 << 14)], n)
        b = met[np.arange(n.sum()) + np.repeat(starts[there] - np.cumsum(n) + n, n)]
        near = np.flatnonzero((a != b) & (np.einsum("ij,ij->i", short[a], short[b]) >= least[a] - slack))
        a, b = a[near], b[near]
        score = np.round(np.einsum("ij,ij->i", m[a], m[b]), decimals)
        good = (score > least[a]) | ((score == least[a]) & (~full[a] | (ids[b] < known[a, k - 1])))
        good[good] = ~(known[a[good]] == ids[b[good], None]).any(1)
        found.append((a[good], b[good], score[good]))
    a, b, score = (np.concatenate(x) for x in zip(*found))
    _, one = np.unique(a * len(ids) + b, return_index=True)
    a, b, score = a[one], b[one], score[one]
    place = np.lexsort((b, -score, a))
    starts = np.flatnonzero(np.r_[True, a[place][1:] != a[place][:-1]]) if len(place) else np.zeros(0, np.int64)
    best = place[np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)])) < k]
    return pa.table([pa.array(ids[a[best]].tolist(), schema.field(0).type), pa.array(ids[b[best]].tolist(), schema.field(1).type), pa.array(score[best])], schema=schema)
