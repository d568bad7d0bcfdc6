"""Ranking quality against relevance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(hits: DataFrame, relevant_total: DataFrame, mrr_at: int = 10, ndcg_at: int = 10, recall_at: int = 20) -> DataFrame:
    """Mean MRR, NDCG and recall of ``hits(query_id, rank, relevant)``.

    ``relevant_total(query_id, n_relevant)`` counts all relevant documents; the
    ideal DCG is a sum over at most ``ndcg_at`` positions, so it is an expression.
    """
    relevant = F.col("relevant")
    per_query = hits.groupBy("query_id").agg(
        F.max(F.when(relevant & (F.col("rank") <= mrr_at), 1.0 / F.col("rank"))).alias("rr"),
        F.sum(F.when(relevant & (F.col("rank") <= ndcg_at), 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.count_if(relevant & (F.col("rank") <= recall_at)).alias("found"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(ndcg_at)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    joined = relevant_total.where("n_relevant > 0").join(per_query, "query_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
        F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("n_relevant")), 6).alias("recall"),
    )
