"""Batch ingestion: duplicates, reports, corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import content_id

MAX_BATCH_ROWS = 1000


def duplicate_ids(batch: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once in a batch."""
    return batch.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_batch(batch: DataFrame, key: str = "id") -> DataFrame:
    """Whether a batch keeps the size limit and has unique ids."""
    per_id = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicated_ids")
    ).withColumn("accepted", (F.col("rows") <= MAX_BATCH_ROWS) & (F.col("duplicated_ids") == 0))


def collapse_exact(docs: DataFrame, order: str, source: str = "source", content: str = "content") -> DataFrame:
    """Keep the first document per content-addressed id.

    An aggregate combines copies before the shuffle, so a text that fills a
    third of the corpus arrives as one row per task. Equal ids mean equal
    source and content; only the smallest ``order`` and the number of copies differ.
    """
    keyed = docs.withColumn("content_key", content_id(F.col(source), F.col(content)))
    return keyed.groupBy("content_key").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def corpus_stats(docs: DataFrame, chunks_per_doc: Column, collection: str = "collection") -> DataFrame:
    """Documents, chunks and collections (A4); collections are named in a sorted text."""
    per = docs.groupBy(collection).agg(F.count(F.lit(1)).alias("_d"), F.sum(chunks_per_doc).alias("_c"))
    return per.agg(
        F.sum("_d").cast("long").alias("total_documents"),
        F.sum("_c").cast("long").alias("total_chunks"),
        F.array_join(F.array_sort(F.collect_set(collection)), ",").alias("collections"),
    )


def ingest_errors(batch: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """Rows with the reason why they cannot be ingested; null reason means fine (A5)."""
    reason = F.when(F.col(key).isNull(), "missing id").when(F.col(content).isNull(), "missing content")
    return batch.withColumn("error", reason)


def ingest_report(checked: DataFrame, chunks: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Totals of a batch, and one row per failed document (A5).

    Errors stay rows of a table because a bad batch may have very many.
    """
    good = F.col("error").isNull()
    totals = checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(F.when(good, chunks)), F.lit(0)).cast("long").alias("chunks_created"),
    )
    errors = checked.where(~good).select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("doc_id"), "error")
    return totals, errors
