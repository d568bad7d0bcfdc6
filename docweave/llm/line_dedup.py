"""Drop lines that many documents share; DataFrame operations only.

Lines are exploded, normalised and hashed where the documents are read. A partially
aggregated count finds hashes with enough lines, the lines of those alone are
looked at again for the exact number of documents, and what is dropped comes back to
each document as a list of positions from which the text is put together again. Texts
are not shuffled unless the list of positions is too large to send to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Rows and array entries up to which a table goes to every task; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_ENTRIES = 2_000_000

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """``_doc, doc_id, pos, k1, k2`` of every line whose key is long enough."""
    folded = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    lines = docs.select("_doc", "doc_id", F.posexplode(F.split(folded, "\n", -1)).alias("pos", "line"))
    keys = lines.select("_doc", "doc_id", "pos", F.trim("line", F.lit(_BLANK)).alias("key"))
    long_ = keys.where(F.char_length("key") >= min_chars)
    # two independent 64-bit hashes stand for the key: one alone would collide at 10^10 lines
    return long_.select("_doc", "doc_id", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``_doc, gone`` for documents that lose lines; ``gone`` are their sorted line numbers from 0."""
    keyed = _keyed(docs, min_chars)
    often = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    often = stored(often.select("k1", "k2"), "often")
    hits = stored(keyed.join(_small(often, often.count() <= BROADCAST_ROWS), ["k1", "k2"]), "hits")
    per_key = hits.groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    per_key = stored(per_key.where(F.col("n") >= min_docs).select("k1", "k2", "last"), "frequent")
    lost = hits.join(_small(per_key, per_key.count() <= BROADCAST_ROWS), ["k1", "k2"])
    lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("_doc").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """Lines left over, as slices between consecutive dropped positions: linear in the lines."""
    cuts = F.concat(gone, F.array(F.size(lines)))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(cuts, i - 1))
    return F.flatten(F.transform(cuts, lambda cut, i: F.slice(lines, before(i) + 2, cut - before(i) - 1)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct), n_lines, n_dropped and kept (the text left).

    A line's key is the line without ASCII white space at both ends and with A-Z in
    lower case. Keys of at least ``min_chars`` code points in at least ``min_docs``
    different doc_ids lose all their lines, except those in the largest doc_id.
    Rows that are equal in doc_id and text are one document and get the same result;
    rows that share only the doc_id count once and each keeps its own lines. A null
    doc_id counts as no document and is never the largest. Empty tables give no rows.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    # rows with equal doc_id and text share the key, and with it their dropped positions
    own = own.withColumn("_doc", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")))
    gone = stored(dropped_lines(own.drop("row"), min_chars, min_docs), "gone")
    size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).collect()[0]
    fits = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_ENTRIES
    joined = own.drop("doc_id").join(_small(gone, fits), "_doc", "left").select("row", text_lines(F.col("text")).alias("lines"), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(
        F.array_join(_without(F.col("lines"), F.col("gone")), "\n")
    )
    return joined.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(kept, F.lit("")).alias("kept"),
    )
