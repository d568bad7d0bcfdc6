"""Feature-based ranking of results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.ranks import top_per_group
from docweave.functions.text import WS

FEATURES = ["semantic_score", "keyword_score", "length_penalty", "freshness", "popularity", "ql_ratio"]
DECAY_DAYS = 90.0
DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Weights:
    """Feature weights (K11): kept as given, scaled to 1 by ``normalized``."""

    semantic: float = 0.4
    keyword: float = 0.3
    freshness: float = 0.1
    popularity: float = 0.2

    @property
    def total(self) -> float:
        return self.semantic + self.keyword + self.freshness + self.popularity

    def checked(self) -> Weights:
        """Configured weights must not be negative."""
        if min(self.semantic, self.keyword, self.freshness, self.popularity) < 0:
            raise ValueError("ranking weights must be at least 0")
        return self

    def normalized(self) -> Weights:
        """Scale only when the sum is positive and outside [0.9, 1.1]."""
        t = self.total
        if t <= 0 or 0.9 <= t <= 1.1:
            return self
        return Weights(self.semantic / t, self.keyword / t, self.freshness / t, self.popularity / t)

    def update(self, **changes: float) -> Weights:
        return replace(self, **changes)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def freshness(date: Column, given: Column, as_of: Column) -> Column:
    """``exp(-days/90)`` of a date string; future is 1, unparsable falls back (K7)."""
    parsed = date.try_cast("timestamp")
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(parsed)
    days = F.floor(micros / F.lit(DAY_MICROS))
    decayed = F.when(days >= 0, F.exp(-days / DECAY_DAYS)).otherwise(F.lit(1.0))
    fallback = F.coalesce(given, F.lit(0.5))
    return _clamp(F.when(date.isNull(), 0.5).when(parsed.isNull(), fallback).otherwise(decayed))


def features(results: DataFrame, as_of: Column, query: str = "query") -> DataFrame:
    """Add the feature columns to rows of (query_id, rank, query, score, ...) (K6).

    Optional inputs: keyword_score, doc_length, last_updated, created_at,
    freshness_hint, view_count. The best score of a query comes from a window
    over its at most ``k`` results.
    """
    null = F.lit(None)
    score = _column(results, "score", _column(results, "relevance_score", F.lit(0.0))).cast("double")
    top = F.max(score).over(Window.partitionBy("query_id"))
    best = F.when(top == 0, F.lit(1.0)).otherwise(top)
    length = _column(results, "doc_length", F.lit(0)).cast("double")
    words = F.size(F.filter(F.split(F.col(query), f"{WS}+"), lambda w: w != ""))
    date = F.coalesce(
        _column(results, "last_updated", null.cast("string")), _column(results, "created_at", null.cast("string"))
    )
    return (
        results.withColumn("semantic_score", F.when(best > 0, score / best).otherwise(F.lit(0.0)))
        .withColumn("keyword_score", _clamp(_column(results, "keyword_score", F.lit(0.0)).cast("double")))
        .withColumn("length_penalty", F.when(length > 0, 1.0 / (1.0 + length / 1000.0)).otherwise(F.lit(0.5)))
        .withColumn(
            "freshness", freshness(date, _column(results, "freshness_hint", null.cast("double")).cast("double"), as_of)
        )
        .withColumn("popularity", _clamp(_column(results, "view_count", F.lit(0)).cast("double") / 100.0))
        .withColumn("ql_ratio", F.when(length > 0, F.least(words / length, F.lit(1.0))).otherwise(F.lit(0.0)))
    )


def weighted_score(weights: Weights = Weights()) -> Column:
    """Weighted sum times the length penalty, clamped to [0, 1] (K8)."""
    total = (
        F.lit(weights.semantic) * F.col("semantic_score")
        + F.lit(weights.keyword) * F.col("keyword_score")
        + F.lit(weights.freshness) * F.col("freshness")
        + F.lit(weights.popularity) * F.col("popularity")
    )
    return F.coalesce(_clamp(total * F.col("length_penalty")), F.lit(0.0))


def rank_results(
    results: DataFrame,
    as_of: Column,
    weights: Weights = Weights(),
    k: int | None = None,
    query: str = "query",
    decimals: int = 6,
) -> DataFrame:
    """Features, score and the new order; ties keep the old order (K9)."""
    scored = features(results, as_of, query).withColumn("ranking_score", F.round(weighted_score(weights), decimals))
    order = [F.col("ranking_score").desc(), F.col("first_rank").asc()]
    return top_per_group(
        scored.withColumnRenamed("rank", "first_rank"), ["query_id"], order, k if k and k > 0 else 2**31 - 1
    )


def rank_retrieved(
    results: DataFrame, as_of: Column, weights: Weights = Weights(), k: int | None = None, document: str = "document"
) -> DataFrame:
    """Rank retrieval rows: length from the text, the new score replaces the old."""
    ranked = rank_results(results.withColumn("doc_length", F.length(document)), as_of, weights, k)
    return ranked.withColumn("score", F.col("ranking_score")).drop("ranking_score", "doc_length", *FEATURES)
