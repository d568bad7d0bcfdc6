"""Windowed request metrics and limits on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _windowed(stream: DataFrame, ts: str, seconds: int, lateness: str, *labels: str):
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, f"{seconds} seconds"), *labels)


def _flat(df: DataFrame, *labels: str) -> DataFrame:
    start = F.unix_seconds(F.col("window.start")).alias("window_start")
    rest = [c for c in df.columns if c not in ("window", *labels)]
    return df.select(start, *labels, *rest)


def live_metrics(
    stream: DataFrame,
    value: str,
    success: Column,
    *labels: str,
    ts: str = "ts",
    seconds: int = 300,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Rate, mean latency and success ratio per window.

    Rows later than the watermark are dropped. Append mode emits a window once, after
    it closed; ``start_updates`` keeps the open ones as well.
    """
    agg = _windowed(stream, ts, seconds, lateness, *labels).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.count(F.lit(1)) / F.lit(float(seconds)), 6).alias("rate"),
        F.round(F.avg(value), 6).alias("mean_latency"),
        F.round(F.count_if(success) / F.count(F.lit(1)), 6).alias("ratio"),
    )
    return _flat(agg, *labels)


def live_over_limit(
    stream: DataFrame, key: str, limit: int, ts: str = "ts", seconds: int = 60, lateness: str = "2 minutes"
) -> DataFrame:
    """Keys above their limit per window (X4); update mode shows a breach while it grows."""
    agg = _windowed(stream, ts, seconds, lateness, key).agg(F.count(F.lit(1)).alias("requests"))
    return _flat(agg, key).where(F.col("requests") > limit)


def start_updates(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Write what changes in each micro-batch (update mode), also of windows that are still open.

    A micro-batch owns one folder and overwrites it when it is replayed; ``read_updates``
    gives the newest state per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, store: str, *keys: str) -> DataFrame:
    """Newest row per key over all micro-batches; rows combine before the shuffle."""
    rows = spark.read.parquet(store)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_new"))
    return newest.select(*keys, "_new.*")
