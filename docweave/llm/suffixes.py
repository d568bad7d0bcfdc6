"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes only those at content-selected minimiser positions are kept: every run
of ``min_words`` words has at least one, and equal runs have the same ones. Suffixes
whose first words occur in one document alone are dropped before anything is sorted.
The rest is sorted over the cluster by what follows, neighbours of different
documents are compared, and each match is extended to the right and to the left.
A range sort splits a passage with many copies over as many tasks as it needs.
Where one seed repeats in a text, all its positions count; those with the same words on
both sides travel as one row, since their matches are the same and run into each other.

The neighbour with the longest common continuation need not be the one with the longest
common past. Runs of ``min_words`` words around a suffix that its neighbours leave
open are therefore looked up exactly, by counting documents per hash of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.blocks import SPACE, stored, text_blocks, window_hashes, windows_inside, word_bounds, word_hashes

MIN_WORDS = 50
SEED_WORDS = 8
#: Rows and array entries up to which a table goes to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_ENTRIES = 4_000_000


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, end row, word hashes, first word of each row)``."""
    for lo, hi, buf, offsets in text_blocks(column):
        starts, ends, bounds = word_bounds(buf, offsets, ~SPACE)
        yield lo, hi, word_hashes(buf, starts, ends), bounds


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def minimisers(words: np.ndarray, bounds: np.ndarray, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions and the hash of the ``seed_words`` words there.

    Every run of ``min_words`` words of one text selects the position of its smallest
    seed hash, the leftmost on ties, whatever stands around the run.
    """
    seeds = window_hashes(words, seed_words)
    width = min_words - seed_words + 1
    inside = windows_inside(bounds, len(words), min_words)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(max(1, int(len(seeds)).bit_length()))
    ranked = ((seeds >> bits) << bits) | np.arange(len(seeds), dtype=np.uint64)
    best = _window_minima(ranked, width)[inside]
    at = np.unique(best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, seeds[at]


def _seed_rows(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("_doc").to_numpy(zero_copy_only=False)
        for lo, hi, words, bounds in _words(batch.column("text")):
            at, seeds = minimisers(words, bounds, min_words, seed_words)
            own = np.searchsorted(bounds, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds.view(np.int64)), pa.array(docs[lo + own]), pa.array((at - bounds[own]).astype(np.int32))],
                names=["seed", "_doc", "pos"],
            )


_SUFFIX = "follows binary, precedes binary, _doc long, doc_id long, pos int, last int, seed long"


def _suffix_rows(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Each marked suffix with the codes of ``reach`` words after and before it, nearest first; 0 pads.

    Neighbouring marks ``pos`` to ``last`` with equal codes, at most ``reach`` words apart, are
    one row: ``reach`` matching words at each of them leave no word between them out.
    """
    for batch in batches:
        marks = batch.column("marks")
        for lo, hi, words, bounds in _words(batch.column("text")):
            codes = np.maximum((words >> np.uint64(32)).astype(np.uint32), np.uint32(1)).astype(">u4")
            for i in range(hi - lo):
                own = codes[bounds[i] : bounds[i + 1]]
                padded = np.concatenate([np.zeros(reach, ">u4"), own, np.zeros(reach, ">u4")])
                mine = marks[lo + i].as_py()
                for cut in range(0, len(mine), 4096):
                    p = np.array([m["pos"] for m in mine[cut : cut + 4096]], np.int64)
                    right = padded[(p + reach)[:, None] + np.arange(reach)]
                    left = padded[(p + reach - 1)[:, None] - np.arange(reach)]
                    values = np.array([m["value"] for m in mine[cut : cut + 4096]], np.int64)
                    fresh = np.append(True, (values[1:] != values[:-1]) | (np.diff(p) > reach))
                    fresh[1:] |= (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
                    k = np.flatnonzero(fresh)
                    n = len(k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            _binary(right[k]),
                            _binary(left[k]),
                            pa.array([batch.column("_doc")[lo + i].as_py()] * n, pa.int64()),
                            pa.array([batch.column("doc_id")[lo + i].as_py()] * n, pa.int64()),
                            pa.array(p[k].astype(np.int32)),
                            pa.array(p[np.append(k[1:], len(p)) - 1].astype(np.int32)),
                            pa.array(values[k]),
                        ],
                        names=["follows", "precedes", "_doc", "doc_id", "pos", "last", "seed"],
                    )


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape[0], rows.shape[1] * 4
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _codes(column: pa.Array, reach: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, reach), np.uint32)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), reach)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows; padding never agrees."""
    differs = (a != b) | (a == 0)
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


class _Sorted:
    """Suffixes in sorted order, with everything needed to compare them."""

    def __init__(self, follows, precedes, doc, doc_id, known, pos, last, seed) -> None:
        self.columns = (follows, precedes, doc, doc_id, known, pos, last, seed)
        self.follows, self.precedes, self.doc, self.doc_id, self.known, self.pos, self.last, self.seed = self.columns

    @staticmethod
    def of(batch: pa.RecordBatch, reach: int) -> _Sorted:
        ids = batch.column("doc_id")
        return _Sorted(
            _codes(batch.column("follows"), reach),
            _codes(batch.column("precedes"), reach),
            batch.column("_doc").to_numpy(zero_copy_only=False).astype(np.int64),
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            ids.is_valid().to_numpy(zero_copy_only=False),
            batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column("last").to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64),
        )

    def __len__(self) -> int:
        return len(self.doc)

    def __add__(self, other: _Sorted) -> _Sorted:
        return _Sorted(*(np.concatenate(pair) for pair in zip(self.columns, other.columns)))

    def rows(self, index) -> _Sorted:
        return _Sorted(*(c[index] for c in self.columns))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: where its run of rows of one document begins, and where it ends."""
        fresh = np.append(True, self.doc[1:] != self.doc[:-1])
        begin = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        return begin[number], np.append(begin[1:], len(self))[number]


_FOUND = (
    "kind int, _doc long, doc_id long, start int, stop int, other_id long, "
    "follows binary, precedes binary, pos int, last int, seed long, open long"
)
_SPAN, _EDGE, _OPEN = 0, 1, 2


def _found_batch(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrays, names = [], []
    for name, type_ in (c.split() for c in _FOUND.split(", ")):
        names.append(name)
        value = pa.array(np.full(n, kind, np.int32)) if name == "kind" else columns.get(name)
        arrays.append(pa.nulls(n, types[type_]) if value is None else value.cast(types[type_]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _edge_batch(s: _Sorted) -> pa.RecordBatch:
    return _found_batch(
        _EDGE,
        len(s),
        _doc=pa.array(s.doc),
        doc_id=pa.array(s.doc_id, mask=~s.known),
        follows=_binary(s.follows),
        precedes=_binary(s.precedes),
        pos=pa.array(s.pos),
        last=pa.array(s.last),
        seed=pa.array(s.seed),
    )


class _Matcher:
    """Compares rows with neighbours; remembers for each row what stays open.

    An offset ``d`` stands for the run of ``reach`` words that begins ``d`` words before
    the suffix. It is settled when one neighbour agrees on all of the run, and
    impossible when no neighbour agrees on its part after the suffix, as none agrees
    on more than they do.
    """

    def __init__(self, reach: int, offsets: int) -> None:
        self.reach, self.offsets = reach, np.arange(offsets)

    def spans(self, s: _Sorted, rows: np.ndarray, others: np.ndarray) -> Iterator[pa.RecordBatch]:
        for cut in range(0, len(rows), 1 << 14):
            i, j = rows[cut : cut + (1 << 14)], others[cut : cut + (1 << 14)]
            right, left = _common(s.follows[i], s.follows[j]), _common(s.precedes[i], s.precedes[j])
            k = np.flatnonzero(left + right >= self.reach)
            ids = lambda at: pa.array(s.doc_id[at], mask=~s.known[at])
            if len(k):
                yield _found_batch(
                    _SPAN,
                    len(k),
                    _doc=pa.array(s.doc[i[k]]),
                    doc_id=ids(i[k]),
                    start=pa.array(s.pos[i[k]] - left[k]),
                    stop=pa.array(s.last[i[k]] + right[k]),
                    other_id=ids(j[k]),
                )

    def open(self, s: _Sorted, rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows with open offsets as a bit set; ``before`` or ``after`` is -1 where that neighbour is unknown."""
        for cut in range(0, len(rows), 1 << 13):
            i = rows[cut : cut + (1 << 13)]
            most, sure = np.zeros(len(i), np.int64), np.zeros((len(i), len(self.offsets)), bool)
            for j in (before[cut : cut + (1 << 13)], after[cut : cut + (1 << 13)]):
                right, left = _common(s.follows[i], s.follows[j]), _common(s.precedes[i], s.precedes[j])
                right, left = np.where(j < 0, self.reach, right), np.where(j < 0, -1, left)
                most = np.maximum(most, right)
                sure |= (left[:, None] >= self.offsets) & (right[:, None] >= self.reach - self.offsets)
            room = np.where((s.precedes[i] == 0).any(axis=1), (s.precedes[i] == 0).argmax(axis=1), self.reach)
            ahead = np.where((s.follows[i] == 0).any(axis=1), (s.follows[i] == 0).argmax(axis=1), self.reach)
            possible = (self.offsets <= room[:, None]) & (np.minimum(most, ahead)[:, None] >= self.reach - self.offsets)
            bits = ((possible & ~sure).astype(np.int64) << self.offsets).sum(axis=1)
            k = np.flatnonzero(bits)
            if len(k):
                yield _found_batch(_OPEN, len(k), seed=pa.array(s.seed[i[k]]), open=pa.array(bits[k]))


def _compare(batches: Iterator[pa.RecordBatch], reach: int, offsets: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Compare each suffix with the nearest ones of other documents before and after it.

    Held back between batches: the last run of rows of one document and the row before
    it. With ``edges`` the first and last run of the partition and the row next to each
    are put out as well, as they may have neighbours in another partition.
    """
    match = _Matcher(reach, offsets)
    held: _Sorted | None = None
    led = opened = False  # whether ``held`` begins with a predecessor row; whether the first run is out
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _Sorted.of(batch, reach)
        s, done = (new, 0) if held is None else (held + new, len(held))
        begin, end = s.runs()
        rows = np.arange(done, len(s))
        rows = rows[begin[rows] > 0]
        yield from match.spans(s, rows, begin[rows] - 1)
        rows = np.arange(int(led), len(s))
        rows = rows[end[rows] < len(s)]
        yield from match.spans(s, rows, end[rows])
        if edges:
            yield from match.open(s, rows, begin[rows] - 1, end[rows])
            if not opened and end[0] < len(s):
                yield _edge_batch(s.rows(slice(0, int(end[0]) + 1)))
                opened = True
        led = bool(begin[-1] > 0)
        held = s.rows(slice(int(begin[-1]) - int(led), None))
    if held is not None and edges:
        begin, _ = held.runs()
        last = np.arange(int(led), len(held))
        yield from match.open(held, last, begin[last] - 1, np.full(len(last), -1))
        yield _edge_batch(held)


def _run_rows(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Hash, document and start of every open run of words; ``marks`` hold a position and its offsets."""
    for batch in batches:
        marks = batch.column("marks")
        for lo, hi, words, bounds in _words(batch.column("text")):
            hashes = window_hashes(words, reach)
            for i in range(hi - lo):
                starts = {m["pos"] - d for m in marks[lo + i].as_py() for d in range(m["value"].bit_length()) if m["value"] >> d & 1}
                size = int(bounds[i + 1] - bounds[i])
                at = np.array(sorted(a for a in starts if 0 <= a <= size - reach), np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes[bounds[i] + at].view(np.int64)),
                            pa.array([batch.column("_doc")[lo + i].as_py()] * len(at), pa.int64()),
                            pa.array([batch.column("doc_id")[lo + i].as_py()] * len(at), pa.int64()),
                            pa.array(at.astype(np.int32)),
                        ],
                        names=["run", "_doc", "doc_id", "start"],
                    )


def _marked(own: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """Documents with ``marks(_doc, pos, value)`` gathered per document, in place if the marks are few."""
    marks = marks.groupBy("_doc").agg(F.array_sort(F.collect_set(F.struct("pos", "value"))).alias("marks"))
    marks = stored(marks, name)
    size = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("marks")), F.lit(0))).collect()[0]
    fits = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_ENTRIES
    return own.join(F.broadcast(marks) if fits else marks, "_doc")


def _open_runs(own: DataFrame, seeds: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Spans of open runs that another document has: every document with the seed looks up the same offsets."""
    wanted = found.where(F.col("kind") == _OPEN).groupBy("seed").agg(F.bit_or("open").alias("value"))
    wanted = stored(wanted, "open")
    few = wanted.count() <= BROADCAST_ROWS
    marks = seeds.join(F.broadcast(wanted) if few else wanted, "seed").select("_doc", "pos", "value")
    runs = _marked(own, marks, "open-marks").mapInArrow(
        lambda it: _run_rows(it, min_words), "run long, _doc long, doc_id long, start int"
    )
    runs = stored(runs, "runs")
    shared = runs.groupBy("run").agg(
        F.min("_doc").alias("a"), F.max("_doc").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    shared = stored(shared.where("a < b").select("run", "low", "high"), "shared-runs")
    few = shared.count() <= BROADCAST_ROWS
    other = F.when(F.col("low").eqNullSafe(F.col("doc_id")), F.col("high")).otherwise(F.col("low"))
    return runs.join(F.broadcast(shared) if few else shared, "run").select(
        "_doc", "doc_id", "start", (F.col("start") + min_words).alias("stop"), other.alias("other_id")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words that also stand in another document.

    Covers exactly the words that lie in a run of ``min_words`` words of another document.

    One row per maximal span of ``docs(doc_id, text)``: doc_id, start_word, end_word
    (exclusive), n_words, other_id (the smallest doc_id it was compared with). Words are
    runs between ASCII white space, compared as they are. Spans that touch are joined.
    Rows that are equal in doc_id and text are one document; repeats inside one
    document do not count. Null and short texts have no spans; a null doc_id stays null.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("_doc", F.xxhash64("doc_id", "text"))
    seeds = own.select("_doc", "text").mapInArrow(
        lambda it: _seed_rows(it, min_words, seed_words), "seed long, _doc long, pos int"
    )
    seeds = stored(seeds, "seeds")
    shared = seeds.groupBy("seed").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a < b").select("seed")
    shared = stored(shared, "shared")
    few = shared.count() <= BROADCAST_ROWS
    marks = seeds.join(F.broadcast(shared) if few else shared, "seed", "left_semi")
    marked = _marked(own, marks.select("_doc", "pos", F.col("seed").alias("value")), "marks")
    order = ["follows", "precedes", "_doc", "pos"]
    offsets = min_words - seed_words + 1
    suffixes = marked.mapInArrow(lambda it: _suffix_rows(it, min_words), _SUFFIX)
    suffixes = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(suffixes.mapInArrow(lambda it: _compare(it, min_words, offsets, True), _FOUND), "found")
    # the outer runs of each partition, a few rows each: their neighbours may lie in the next one
    outer = found.where(F.col("kind") == _EDGE).select(*order, "doc_id", "last", "seed")
    outer = outer.repartition(1).sortWithinPartitions(*order)
    across = outer.mapInArrow(lambda it: _compare(it, min_words, offsets, False), _FOUND)
    columns = ["_doc", "doc_id", "start", "stop", "other_id"]
    spans = found.where(F.col("kind") == _SPAN).select(*columns).unionAll(across.select(*columns))
    spans = spans.unionAll(_open_runs(own, seeds, found, min_words).select(*columns))
    before = Window.partitionBy("_doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    spans = spans.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(upto))
    return (
        spans.groupBy("_doc", "doc_id", "island")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other_id").alias("other_id"))
        .select(
            "doc_id",
            F.col("start_word").cast("long").alias("start_word"),
            F.col("end_word").cast("long").alias("end_word"),
            (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
            "other_id",
        )
    )
