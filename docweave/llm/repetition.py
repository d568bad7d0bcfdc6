"""Quality rules from repetition coverage: characters inside duplicated n-grams and lines.

Words and lines get 64-bit hashes, windows of several lengths get rolling hashes
from prefix sums, and duplicates are found per text by sorting. All of it runs
over blocks of whole texts in numpy, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import (
    SPACE,
    char_starts,
    mix,
    text_blocks,
    window_hashes,
    windows_inside,
    word_bounds,
    word_hashes,
)

#: Largest share of word characters inside later copies of n-grams, per n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside later copies of lines, and of lines that are later copies.
LINE_CHAR_LIMIT = 0.20
LINE_LIMIT = 0.50
#: Fewer repeated characters than this (one header line, say) condemn no text, however short it is.
MIN_REPEATED_CHARS = 100
BASE_WINDOW = 8
BASE_MIN_WORDS = 20
BASE_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def _columns(ngrams: list[int]) -> list[str]:
    return _COUNTS + [f"dup_chars_{n}" for n in ngrams]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more for its owner, and whether it has occurred before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = keys ^ mix(owner.astype(np.uint64) + np.uint64(1))
    _, first, inverse, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse] > 1, first[inverse] != np.arange(len(keys))


def _cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for words inside a window of ``n`` words that begins at one of ``starts``."""
    steps = np.bincount(starts, minlength=total + n + 1) - np.bincount(starts + n, minlength=total + n + 1)
    return np.cumsum(steps)[:total] > 0


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def measure(buf: np.ndarray, offsets: np.ndarray, ngrams: list[int]) -> dict[str, np.ndarray]:
    """Counts of each text of a block."""
    chars = np.concatenate([[0], np.cumsum(char_starts(buf) & ~SPACE[buf], dtype=np.int64)])
    starts, ends, bounds = word_bounds(buf, offsets, ~SPACE)
    hashes, total = word_hashes(buf, starts, ends), len(starts)
    sizes = chars[ends] - chars[starts]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": np.diff(chars[offsets]),
        "n_symbols": _per_text(_SYMBOL[buf], offsets),
    }
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    for n in sorted({BASE_WINDOW, *ngrams}):
        inside = np.flatnonzero(windows_inside(bounds, total, n))
        twice, again = _repeats(window_hashes(hashes, n)[inside], owner[inside])
        if n == BASE_WINDOW:
            out["n_repeat_words"] = _per_text(_cover(inside[twice], n, total), bounds)
        if n in ngrams:
            out[f"dup_chars_{n}"] = _per_text(np.where(_cover(inside[again], n, total), sizes, 0), bounds)

    a, b, lines = word_bounds(buf, offsets, ~_NEWLINE)
    filled = chars[b] > chars[a]
    a, b = a[filled], b[filled]
    lines = np.concatenate([[0], np.cumsum(filled)])[lines]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    _, again = _repeats(word_hashes(buf, a, b), owner)
    out["n_lines"] = np.diff(lines)
    out["n_dup_lines"] = _per_text(again, lines)
    out["dup_line_chars"] = _per_text(np.where(again, chars[b] - chars[a], 0), lines)
    return out


def _measured(batches: Iterator[pa.RecordBatch], ngrams: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_blocks(batch.column("text")):
            found = measure(buf, offsets, ngrams)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(found[c], pa.int64()) for c in _columns(ngrams))],
                names=["doc_id", *_columns(ngrams)],
            )


def repetition_counts(docs: DataFrame, ngrams: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """Counts per row of ``docs(doc_id, text)``; a null or empty text has zeros everywhere.

    ``dup_chars_n`` are code points of words inside the second or a later copy of an
    n-gram, each counted once; ``dup_line_chars`` the same for whole lines. Repeated
    rows are counted each on its own; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = list(ngrams)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _columns(sizes))
    return rows.mapInArrow(lambda it: _measured(it, sizes), schema)


def repetition_rules(
    docs: DataFrame,
    ngram_limits: dict[int, float] | None = None,
    line_char_limit: float = LINE_CHAR_LIMIT,
    line_limit: float = LINE_LIMIT,
    min_repeated_chars: int = MIN_REPEATED_CHARS,
) -> DataFrame:
    """Counts with ``base_failed`` and ``kept``.

    The base fails texts of under 20 words and those with over 30 % of words in
    repeated 8-word windows. Others are kept while every share of repeated characters
    and lines is at most its limit; a share counts from ``min_repeated_chars`` on.
    """
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    counts = repetition_counts(docs, tuple(limits))
    base = (F.col("n_words") < BASE_MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT_PERCENT
    )
    bad = F.col("n_dup_lines") > F.col("n_lines") * F.lit(line_limit)
    bad = bad & (F.col("dup_line_chars") >= min_repeated_chars)
    for name, limit in [("dup_line_chars", line_char_limit), *((f"dup_chars_{n}", x) for n, x in limits.items())]:
        share = F.col(name) > F.col("word_chars") * F.lit(limit)
        bad = bad | (share & (F.col(name) >= min_repeated_chars))
    return counts.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~bad)
