"""Context text, source rows, confidence and empty answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import NO_RESULT_TEXT, preview

# --- fixed values -------------------------------------------------------------------
TOKEN_BUDGET = 4000
CHARS_PER_TOKEN = 4
ANSWER_CHARS = 200
HIGH_SCORE = 0.7
# --------------------------------------------------------------------------------------


def pack_context(
    results: DataFrame, budget: int = TOKEN_BUDGET, document: str = "document", method: str = "truncate"
) -> DataFrame:
    """One context text per query from its results in rank order (K1, K2).

    Estimates are not negative, so a running total within the budget is the
    same as stopping at the first result that does not fit. A query's results
    are few (its ``k``), which bounds window and list.
    """
    if method not in ("truncate", "rerank"):
        raise ValueError("method must be 'truncate' or 'rerank'")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    page = F.col("page").cast("string") if "page" in results.columns else F.lit(None).cast("string")
    page_info = F.when(
        page.isNotNull() & ~page.isin("", "0"), F.concat(F.lit(" (page "), page, F.lit(")"))
    ).otherwise("")
    name = F.coalesce(F.col("filename"), F.lit("unknown")) if "filename" in results.columns else F.lit("unknown")
    block = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), name, page_info, F.lit("]\n"), F.col(document), F.lit("\n")
    )
    rows = results.select(
        "query_id",
        "rank",
        block.alias("_block"),
        F.sum(F.floor(F.length(document) / CHARS_PER_TOKEN)).over(w).alias("_total"),
    )
    fits = F.col("_total") <= budget
    packed = F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "_block"))))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(packed, lambda b: b["_block"]), "\n---\n").alias("context"),
        F.count_if(fits).alias("sources_used"),
        F.coalesce(F.max(F.when(fits, F.col("_total"))), F.lit(0)).cast("long").alias("estimated_tokens"),
    )


def stream_context(results: DataFrame, document: str = "document") -> DataFrame:
    """All results without a budget, joined by blank lines (K3)."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.col(document))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context")
    )


def source_rows(results: DataFrame, document: str = "document", stream: bool = False) -> DataFrame:
    """Rows shown as sources of an answer: index, file, page, score, preview."""
    page = F.col("page") if "page" in results.columns else F.lit(None).cast("int")
    return results.select(
        "query_id",
        F.col("rank").cast("int").alias("index"),
        F.coalesce("filename", F.lit("unknown")).alias("document"),
        page.alias("page"),
        (F.col("score") if stream else F.round("score", 3)).alias("relevance_score"),
        preview(F.col(document), always_dots=stream).alias("text_preview"),
    )


def confidence(queries: DataFrame, results: DataFrame, answer: str = "answer", decimals: int = 2) -> DataFrame:
    """Confidence per query from its scores and its answer; 0 without results (K4)."""
    stats = results.groupBy("query_id").agg(
        F.min_by("score", "rank").alias("_top"),
        F.avg((F.col("score") > HIGH_SCORE).cast("double")).alias("_high"),
    )
    length = F.least(F.length(F.coalesce(F.col(answer), F.lit(""))) / ANSWER_CHARS, F.lit(1.0))
    raw = 0.5 * F.col("_top") + 0.3 * F.col("_high") + 0.2 * length
    value = F.when(F.col("_top").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))))
    return queries.join(stats, "query_id", "left").select(
        *queries.columns, F.round(value, decimals).alias("confidence")
    )


def answer_or_none(has_results: Column, answer: Column) -> Column:
    """The fixed sentence when a query found nothing (K5)."""
    return F.when(has_results, answer).otherwise(F.lit(NO_RESULT_TEXT))
