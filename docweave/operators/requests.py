"""Questions asked of a request log (M1-M8).

Rows: ``ts`` and whatever labels the caller groups by. All groupings are by
window and label, so rows combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
INPUT_COST, OUTPUT_COST = 0.00003, 0.00006
REQUEST_LIMITS = {"query": 60, "ingest": 20, "health": 120}
# --------------------------------------------------------------------------------------


def window_start(ts: str = "ts", seconds: int = 300) -> Column:
    """Start of the fixed window of ``ts`` in epoch seconds."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return (F.floor(micros / F.lit(seconds * 1_000_000)) * seconds).cast("long")


def _windowed(log: DataFrame, ts: str, seconds: int) -> DataFrame:
    return log.withColumn("window_start", window_start(ts, seconds))


def request_rate(log: DataFrame, *labels: str, ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Requests and requests per second (M1)."""
    counted = _windowed(log, ts, seconds).groupBy("window_start", *labels).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("rate", F.round(F.col("requests") / F.lit(float(seconds)), 6))


def mean_latency(log: DataFrame, value: str, *labels: str, ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Sum over count (M3)."""
    return (
        _windowed(log, ts, seconds)
        .groupBy("window_start", *labels)
        .agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(value), 6).alias("mean_latency"))
    )


def _bin(value: Column) -> Column:
    """A bin number that never decreases with the value; about 0.1 % wide."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 1024)).cast("long")


def exact_quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact interpolated quantile per group without gathering a group.

    Counts per bin, combined before the shuffle, locate the bins that hold the
    two neighbouring ranks. A second pass keeps only rows of those bins and
    ranks their distinct values, so a group may hold any share of the rows.
    """
    data = rows.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), _bin(F.col(value).cast("double")).alias("_bin")
    )
    bins = data.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    located = (
        bins.withColumn("_before", F.sum("_n").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_lo", F.floor((F.col("_total") - 1) * F.lit(q)))
        .withColumn("_hi", F.ceil((F.col("_total") - 1) * F.lit(q)))
    )
    end = F.col("_before") + F.col("_n")
    needed = located.where(
        ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < end))
        | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < end))
    ).drop("_n")
    counts = (
        data.join(needed, [*keys, "_bin"])
        .groupBy(*keys, "_bin", "_before", "_total", "_lo", "_hi", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    first = F.col("_end") - F.col("_n")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= first) & (F.col(rank) < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        at("_lo").alias("_low"), at("_hi").alias("_high"), F.max("_total").alias("_total"), F.max("_lo").alias("_lo")
    )
    part = (F.col("_total") - 1) * F.lit(q) - F.col("_lo")
    return picked.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(name))


def latency_quantile(
    log: DataFrame, value: str, *labels: str, q: float = 0.95, ts: str = "ts", seconds: int = 300
) -> DataFrame:
    """Exact latency quantile with mean and count per window (M2, M3)."""
    rows = _windowed(log, ts, seconds)
    keys = ["window_start", *labels]
    exact = exact_quantile(rows, keys, value, q, "latency_quantile")
    means = mean_latency(log, value, *labels, ts=ts, seconds=seconds)
    return means.join(exact.withColumn("latency_quantile", F.round("latency_quantile", 6)), keys)


def histogram_quantile(
    log: DataFrame,
    value: str,
    *labels: str,
    q: float = 0.95,
    buckets: list[float] | None = None,
    ts: str = "ts",
    seconds: int = 300,
) -> DataFrame:
    """Quantile interpolated inside cumulative buckets, as dashboards draw it (M2).

    One row per window leaves each task; the bucket counts are columns.
    """
    bounds = buckets or LATENCY_BUCKETS
    keys = ["window_start", *labels]
    counts = [F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    agg = _windowed(log, ts, seconds).groupBy(*keys).agg(F.count(value).alias("_total"), *counts)
    target = F.col("_total") * q
    # beyond the last finite bound the answer is that bound
    result = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low = F.lit(0.0 if i == 0 else bounds[i - 1])
        below = F.lit(0) if i == 0 else F.col(f"_le{i - 1}")
        inside = low + (F.lit(bounds[i]) - low) * (target - below) / (F.col(f"_le{i}") - below)
        result = F.when(F.col(f"_le{i}") >= target, inside).otherwise(result)
    return agg.select(*keys, F.when(F.col("_total") > 0, F.round(result, 6)).alias("latency_quantile"))


def ratio(log: DataFrame, condition: Column, *labels: str, ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Share of rows that meet a condition: success or cache-hit ratio (M4)."""
    agg = (
        _windowed(log, ts, seconds)
        .groupBy("window_start", *labels)
        .agg(F.count_if(condition).alias("matching"), F.count(F.lit(1)).alias("requests"))
    )
    return agg.withColumn("ratio", F.round(F.col("matching") / F.col("requests"), 6))


def token_cost(usage: DataFrame, input_tokens: Column, output_tokens: Column, *labels: str) -> DataFrame:
    """Tokens and their price (M5)."""
    agg = usage.groupBy(*labels).agg(
        F.coalesce(F.sum(input_tokens), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum(output_tokens), F.lit(0)).cast("long").alias("output_tokens"),
    )
    return agg.withColumn(
        "cost", F.round(F.col("input_tokens") * INPUT_COST + F.col("output_tokens") * OUTPUT_COST, 6)
    )


def alerts(
    metric: DataFrame, value: str, breach: Column, held_seconds: int, *labels: str, seconds: int = 300
) -> DataFrame:
    """Spans in which every consecutive window breaches for long enough (M6).

    ``metric`` has one row per window and label, so a label's group is as long
    as the observed time divided by the window. A missing window ends a span.
    """
    w = Window.partitionBy(*labels).orderBy("window_start")
    breaching = metric.where(breach)
    number = F.row_number().over(w)
    spans = breaching.withColumn("_island", F.col("window_start") - number * seconds)
    return (
        spans.groupBy(*labels, "_island")
        .agg(
            F.min("window_start").alias("started"),
            (F.max("window_start") + seconds).alias("ended"),
            F.count(F.lit(1)).alias("windows"),
            F.round(F.max(value), 6).alias("peak"),
        )
        .where(F.col("ended") - F.col("started") >= held_seconds)
        .drop("_island")
    )


def caller_key(api_key: Column, forwarded_for: Column, real_ip: Column, cdn_ip: Column, peer: Column) -> Column:
    """Key of a caller: its API key, else the first known address (M7)."""
    trimmed = F.trim(F.coalesce(api_key, F.lit("")))

    def given(c: Column, value: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", value)

    ip = F.coalesce(
        given(forwarded_for, F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))),
        given(real_ip, F.trim(real_ip)),
        given(cdn_ip, F.trim(cdn_ip)),
        peer,
        F.lit("unknown"),
    )
    return F.when(trimmed != "", F.concat(F.lit("key:"), trimmed)).otherwise(F.concat(F.lit("ip:"), ip))


def over_limit(log: DataFrame, key: str, limit: int, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Keys above their request limit in a fixed window (M7)."""
    counted = _windowed(log, ts, seconds).groupBy("window_start", key).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > limit).withColumn("excess", F.col("requests") - limit)


def peak_concurrency(spans: DataFrame, start_us: str, end_us: str, bucket_seconds: int = 3600) -> DataFrame:
    """Number of spans, and the most that were open at once, per bucket and in all (M8).

    Every bucket from the first start to the last end has a row, also without any
    start or end, as spans may stay open through it; the row without a
    ``bucket_start`` is the whole run. A span is open from its start up to, not
    including, its end. Starts and ends are summed per instant first; a bucket is cut
    into sixty slices, which are ranked on their own and continue from the net sum of
    all earlier ones. Only the short list of buckets is ever in one task.
    """
    width = bucket_seconds * 1_000_000
    ends = spans.select(F.col(start_us).alias("at"), F.lit(1).alias("d")).unionAll(
        spans.select(F.col(end_us).alias("at"), F.lit(-1).alias("d"))
    )
    instants = (
        ends.groupBy("at")
        .agg(F.sum("d").alias("net"), F.count_if(F.col("d") > 0).alias("started"))
        .withColumn("bucket", F.floor(F.col("at") / F.lit(width)))
        .withColumn("slice", F.floor((F.col("at") - F.col("bucket") * width) * 60 / F.lit(width)))
    )
    inside = Window.partitionBy("bucket", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        instants.withColumn("run", F.sum("net").over(inside))
        .groupBy("bucket", "slice")
        .agg(F.sum("net").alias("net"), F.max("run").alias("top"), F.sum("started").alias("started"))
    )
    earlier = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        slices.withColumn("top", F.col("top") + F.coalesce(F.sum("net").over(earlier), F.lit(0)))
        .groupBy("bucket")
        .agg(F.sum("net").alias("net"), F.max("top").alias("top"), F.sum("started").alias("started"))
    )
    every = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo IS NOT NULL")
    every = every.select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    peaks = (
        every.join(buckets, "bucket", "left")
        .withColumn("open", F.coalesce(F.sum("net").over(before), F.lit(0)))
        .select(
            (F.col("bucket") * bucket_seconds).cast("long").alias("bucket_start"),
            F.coalesce("started", F.lit(0)).alias("started"),
            F.greatest("open", F.col("open") + F.col("top")).alias("peak"),
        )
    )
    # the grand total of a rollup is the whole run; an empty log has none
    return (
        peaks.rollup("bucket_start")
        .agg(F.sum("started").cast("long").alias("total_requests"), F.max("peak").cast("long").alias("peak_concurrent"))
        .where("peak_concurrent IS NOT NULL")
    )
