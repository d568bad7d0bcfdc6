"""Ranks and running totals that do not put one hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their 1-based rank.

    Spark plans a group limit below the shuffle, so each input partition sends
    at most ``k`` rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# A key is hot when it holds more than 1/HOT_SHARE of all rows and more rows than
# one task should get. At most HOT_SHARE keys can hold such a share, so a table
# of hot keys is always small enough to send to every task.
HOT_SHARE = 1000
HOT_ROWS = 100_000
HOT_SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Hot keys of a table with one row and one row count per key; at most HOT_SHARE of them."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.where((F.col(count) > HOT_ROWS) & (F.col(count) * HOT_SHARE > total)).select(*keys)


def tag_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_hot``: true for hot keys, else null."""
    return df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")


def salt_rows(df: DataFrame, hot: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Give rows of hot keys a salt from the hash of ``spread_by``; all others salt 0."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(HOT_SALTS)).cast("int")).otherwise(0)
    return tag_hot(df, hot, keys).withColumn("_salt", salt).drop("_hot")


def repeat_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat rows of hot keys once per salt; all others stay one row."""
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return tag_hot(df, hot, keys).withColumn("_salt", F.explode(salts)).drop("_hot")


def skew_join(
    rows: DataFrame, per_key: DataFrame, on: list[str], spread_by: list[str], hot: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join many rows to few rows per key; only hot keys are spread over salts."""
    left, right = salt_rows(rows, hot, on, spread_by), repeat_hot(per_key, hot, on)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def bucketed_row_number(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "row_number"
) -> DataFrame:
    """``row_number()`` per key where a hot key is split at ``bucket`` borders.

    ``bucket`` must not decrease along ``order`` (for example the hour of a
    timestamp). Rows are numbered inside a bucket; earlier buckets of the key
    add an offset taken from partially aggregated counts.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(inner))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_pos") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_pos", "_offset")
    )
