"""Text splitting (C1-C5) as native expressions: no shuffle, no Python rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.binding import let
from docweave.functions.text import content_id, strip

DEFAULT_SEPARATORS = ("\n\n", "\n", ". ", " ")
BLOCK_CHUNKS = 256


def check_sizes(size: int, overlap: int, request: bool = False) -> None:
    """Argument rules (C3); ``request`` adds the narrower limits of the service."""
    if overlap < 0 or overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be at least 0 and smaller than size ({size})")
    if request and not (100 <= size <= 4000 and overlap <= 500):
        raise ValueError("size must be 100-4000 and overlap 0-500")


def _fold(text: Column, sep: str, size: int, overlap: int, reference_compat: bool) -> Column:
    """Pack the parts of ``text`` between ``sep`` into overlapping chunks."""
    parts = F.split(text, re.escape(sep), -1)
    start = F.struct(
        F.array().cast("array<array<string>>").alias("full"),
        F.array().cast("array<string>").alias("last"),
        F.lit("").alias("cur"),
    )

    def tail(cur: Column) -> Column:
        if overlap:
            return F.right(cur, F.lit(overlap))
        # a carried overlap of 0 characters; the reference carries the whole chunk
        return cur if reference_compat else F.lit("")

    def step(acc: Column, part: Column) -> Column:
        # appending copies an array, so chunks collect in short blocks
        cur, last = acc["cur"], acc["last"]
        over = (F.length(cur) + F.length(part)) > size
        emit, seal = over & (cur != ""), F.size(last) == BLOCK_CHUNKS
        return F.struct(
            F.when(emit & seal, F.array_append(acc["full"], last)).otherwise(acc["full"]).alias("full"),
            F.when(emit & seal, F.array(strip(cur)))
            .when(emit, F.array_append(last, strip(cur)))
            .otherwise(last)
            .alias("last"),
            F.when(cur == "", part)
            .when(over, F.concat(tail(cur), F.lit(sep), part))
            .otherwise(F.concat(cur, F.lit(sep), part))
            .alias("cur"),
        )

    def finish(acc: Column) -> Column:
        rest = F.when(acc["cur"] != "", F.array(strip(acc["cur"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.flatten(acc["full"]), acc["last"], rest)

    return F.aggregate(parts, start, step, finish)


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, blank ones dropped.

    One regex pass: the look-ahead takes the window and the match body moves
    by one step, so cost grows with the text and not with its square.
    """
    check_sizes(size, overlap)
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"), F.lit(1))
    return F.filter(F.transform(windows, strip), lambda c: c != "")


def split_text(
    text: Column,
    size: int = 1000,
    overlap: int = 200,
    separators: Sequence[str] | None = None,
    reference_compat: bool = False,
) -> Column:
    """Chunks of ``text`` by the first separator that occurs in it.

    Text without a separator, or without any chunk, falls back to C2. With
    ``overlap=0`` nothing is carried over unless ``reference_compat``.
    """
    check_sizes(size, overlap)
    picked = F.array().cast("array<string>")
    for sep in reversed([s for s in (separators or DEFAULT_SEPARATORS) if s]):
        picked = F.when(F.contains(text, F.lit(sep)), _fold(text, sep, size, overlap, reference_compat)).otherwise(picked)
    fallback = fixed_chunks(text, size, overlap)
    return let(picked, lambda chunks: F.when(F.size(chunks) > 0, chunks).otherwise(fallback))


def explode_chunks(docs: DataFrame, chunks: Column, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per chunk with index, total, parent and its own content id (C4).

    All other columns of the document are inherited.
    """
    rows = docs.withColumn("_chunks", chunks)
    keep = [c for c in docs.columns if c not in (doc_id, "content", "text")]
    # an outer explode: the plain one adds a filter that splits every text a second time
    return (
        rows.select(
            F.col(doc_id).alias("original_doc_id"),
            *keep,
            F.size("_chunks").alias("total_chunks"),
            F.posexplode_outer("_chunks").alias("chunk_index", "content"),
        )
        .where("chunk_index IS NOT NULL")
        .withColumn("chunk_id", content_id(F.col(source), F.col("content")))
    )


def chunk_documents(
    docs: DataFrame,
    content: str = "content",
    doc_id: str = "doc_id",
    source: str = "source",
    size: int = 1000,
    overlap: int = 200,
    separators: Sequence[str] | None = None,
    reference_compat: bool = False,
) -> DataFrame:
    return explode_chunks(docs, split_text(F.col(content), size, overlap, separators, reference_compat), doc_id, source)
