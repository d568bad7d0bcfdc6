"""Fusion, dispatch, re-ranking and lookup of candidates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.ranks import top_per_group
from docweave.functions.text import is_blank, tokens

# --- fixed values -------------------------------------------------------------------
RRF_OFFSET = 60
OVER_FETCH = 50
# --------------------------------------------------------------------------------------


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, alpha: float = 0.5, decimals: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per query.

    Ranks are 1-based columns; a missing side adds nothing. Ties keep the
    semantic order first, then the keyword order.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.col(rank) + (RRF_OFFSET - 1)), F.lit(0.0))

    both = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank")).join(
        keyword.select("query_id", "id", F.col("rank").alias("keyword_rank")), ["query_id", "id"], "full_outer"
    )
    score = F.round(part("semantic_rank", alpha) + part("keyword_rank", 1 - alpha), decimals)
    order = [F.col("score").desc(), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()]
    return top_per_group(both.withColumn("score", score), ["query_id"], order, k)


def retrieve(
    semantic: Callable[[int], DataFrame],
    keyword: Callable[[int], DataFrame] | None,
    k: int,
    use_hybrid: bool = True,
    alpha: float = 0.5,
) -> DataFrame:
    """Hybrid when asked for and a keyword search exists, else semantic.

    The two arguments build a ranked list of a given length; hybrid fetches
    twice the wanted length from each.
    """
    if use_hybrid and keyword is not None:
        return fuse(semantic(2 * k), keyword(2 * k), k, alpha).select("query_id", "id", "score", "rank")
    return semantic(k).select("query_id", "id", "score", "rank")


def overlap_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens that occur in the document."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(document))) / F.size(q)).otherwise(F.lit(0.0))


def pair_scorer(model: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """Turn a batch model ``(queries, documents) -> scores`` into a scorer."""
    return F.pandas_udf(model, "double")


def rerank(
    candidates: DataFrame,
    k: int | None,
    query: str = "query",
    document: str = "document",
    scorer: Callable[[Column, Column], Column] = overlap_score,
    decimals: int = 6,
) -> DataFrame:
    """Re-order candidates by a pair score; equal scores keep the old order.

    A blank query, or a pair without a score, counts as zero, so such a query
    keeps its order.
    """
    raw = scorer(F.col(query), F.col(document))
    score = F.when(is_blank(F.col(query)), F.lit(0.0)).otherwise(F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0)))
    scored = candidates.withColumn("rerank_score", F.round(score, decimals)).withColumnRenamed("rank", "first_rank")
    order = [F.col("rerank_score").desc(), F.col("first_rank").asc()]
    return top_per_group(scored, ["query_id"], order, k if k and k > 0 else 2**31 - 1)


def lookup(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Text and attributes of the hits; a missing source reads ``unknown``.

    Hits are at most queries x k rows; AQE sends them to the tasks when small.
    """
    found = hits.join(docs.withColumnRenamed(doc_id, "id"), "id", "left")
    return found.withColumn("source", F.coalesce("source", F.lit("unknown"))) if "source" in found.columns else found


def batch_summary(responses: DataFrame) -> DataFrame:
    """Mean confidence and latency of a batch."""
    return responses.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
    )
