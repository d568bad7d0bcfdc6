"""Queries on the request log, in batch and as streams (M, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import query_key
from docweave.operators import requests as rq
from docweave.operators import validation
from docweave.plans.documents import CHUNKS_SQL, LENGTH_SQL, any_sql
from docweave.plans.registry import query
from docweave.session import work_path
from docweave.sources.slices import feed
from docweave.sources.tables import table
from docweave.streaming import ingest as live_ingest
from docweave.streaming import live, repeats


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _start(seconds: int) -> str:
    return f"(floor(epoch_us(ts) / {seconds * 1_000_000}.0)::BIGINT * {seconds})"


# ---- windows -------------------------------------------------------------------------------


@query(
    "request_rate_5m",
    f"""SELECT {_start(300)} AS window_start, event_type, count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS rate
        FROM events GROUP BY 1, 2""",
)
def request_rate_5m(spark, d):
    return rq.request_rate(events(spark, d), "event_type")


_P95_SQL = f"""
p95 AS (SELECT {_start(3600)} AS window_start, event_type, count(*) AS requests, round(avg(value), 6) AS mean_latency,
               round(quantile_cont(value, 0.95), 6) AS latency_quantile FROM events GROUP BY 1, 2)"""


@query(
    "latency_p95_5m",
    f"""SELECT {_start(300)} AS window_start, count(*) AS requests, round(avg(value), 6) AS mean_latency,
               round(quantile_cont(value, 0.95), 6) AS latency_quantile FROM events GROUP BY 1""",
)
def latency_p95_5m(spark, d):
    return rq.latency_quantile(events(spark, d), "value")


def latency_p95_1h(spark: SparkSession, d: str) -> DataFrame:
    return rq.latency_quantile(events(spark, d), "value", "event_type", seconds=3600)


@query("latency_p95_by_type", f"WITH {_P95_SQL} SELECT * FROM p95")
def latency_p95_by_type(spark, d):
    return latency_p95_1h(spark, d)


_BUCKETS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def _histogram_sql() -> str:
    les = ", ".join(f"count(*) FILTER (value <= {b}) AS le{i}" for i, b in enumerate(_BUCKETS))
    whens = []
    for i, b in enumerate(_BUCKETS):
        low, below = (_BUCKETS[i - 1], f"le{i - 1}") if i else (0.0, "0")
        whens.append(f"WHEN le{i} >= target THEN {low} + ({b} - {low}) * (target - {below}) / (le{i} - {below})")
    return f"""WITH counted AS (SELECT {_start(3600)} AS window_start, event_type, count(*) * 0.95::DOUBLE AS target, {les}
                              FROM events GROUP BY 1, 2)
      SELECT window_start, event_type, round((CASE {' '.join(whens)} ELSE {_BUCKETS[-1]} END)::DOUBLE, 6) AS latency_quantile
      FROM counted"""


@query("latency_histogram", _histogram_sql())
def latency_histogram(spark, d):
    return rq.histogram_quantile(events(spark, d), "value", "event_type", buckets=_BUCKETS, seconds=3600)


@query(
    "success_ratio_5m",
    f"""SELECT {_start(300)} AS window_start, count(*) FILTER (event_type <> 'error') AS matching, count(*) AS requests,
               round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS ratio FROM events GROUP BY 1""",
)
def success_ratio_5m(spark, d):
    return rq.ratio(events(spark, d), F.col("event_type") != "error")


@query(
    "token_cost",
    """SELECT role, input_tokens, output_tokens,
              round(input_tokens * 0.00003::DOUBLE + output_tokens * 0.00006::DOUBLE, 6) AS cost FROM (
         SELECT role, sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END)::BIGINT AS input_tokens,
                sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END)::BIGINT AS output_tokens
         FROM conversations GROUP BY role)""",
)
def token_cost(spark, d):
    tokens = F.floor(F.length("text") / 4)
    answer = F.col("role") == "assistant"
    return rq.token_cost(
        table(spark, d, "conversations"),
        F.when(answer, F.lit(0)).otherwise(tokens),
        F.when(answer, tokens).otherwise(F.lit(0)),
        "role",
    )


_ALERTS_SQL = f"""
errors AS (SELECT {_start(3600)} AS window_start,
                  round(count(*) FILTER (event_type = 'error') / count(*), 6) AS v FROM events GROUP BY 1),
slow AS (SELECT {_start(3600)} AS window_start, round(quantile_cont(value, 0.95), 6) AS v FROM events GROUP BY 1),
breaches AS (SELECT 'HighErrorRate' AS alert, * FROM errors WHERE v > 0.05
             UNION ALL SELECT 'SlowResponseTime', * FROM slow WHERE v > 100),
spans AS (SELECT *, window_start - 3600 * row_number() OVER (PARTITION BY alert ORDER BY window_start) AS island FROM breaches)"""


@query(
    "alerts",
    f"""WITH {_ALERTS_SQL}
        SELECT alert, min(window_start) AS started, max(window_start) + 3600 AS ended, count(*) AS windows, max(v) AS peak
        FROM spans GROUP BY alert, island HAVING max(window_start) + 3600 - min(window_start) >= 10800""",
)
def alerts(spark, d):
    ev = events(spark, d)
    errors = rq.ratio(ev, F.col("event_type") == "error", seconds=3600)
    slow = rq.latency_quantile(ev, "value", seconds=3600)
    metric = errors.select(F.lit("HighErrorRate").alias("alert"), "window_start", F.col("ratio").alias("v")).union(
        slow.select(F.lit("SlowResponseTime"), "window_start", "latency_quantile")
    )
    breach = F.when(F.col("alert") == "HighErrorRate", F.col("v") > 0.05).otherwise(F.col("v") > 100)
    return rq.alerts(metric, "v", breach, 10_800, "alert", seconds=3600)


@query(
    "over_limit",
    f"""SELECT {_start(3600)} AS window_start, caller, count(*) AS requests, count(*) - 2 AS excess
        FROM (SELECT ts, CASE WHEN event_type = 'view' THEN 'ip:10.0.0.' || user_id::VARCHAR
                              ELSE 'key:' || event_type END AS caller FROM events)
        GROUP BY 1, 2 HAVING count(*) > 2""",
)
def over_limit(spark, d):
    """Views come without an API key and are counted by forwarded address."""
    keyed = F.col("event_type") != "view"
    caller = rq.caller_key(
        F.when(keyed, F.concat("event_type", F.lit(" "))).otherwise(F.lit(" ")),
        F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 172.16.0.1")),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        F.lit("127.0.0.1"),
    )
    return rq.over_limit(events(spark, d).withColumn("caller", caller), "caller", 2, seconds=3600)


@query(
    "peak_concurrency",
    """WITH spans AS (SELECT epoch_us(ts) AS a, epoch_us(ts) + round(value * 100)::BIGINT * 10000 AS b FROM events),
       buckets AS (SELECT unnest(range((SELECT min(a) FROM spans) // 3600000000, (SELECT max(b) FROM spans) // 3600000000 + 1)) AS n),
       points AS (SELECT DISTINCT n, n * 3600000000 AS t FROM buckets
                  UNION SELECT a // 3600000000, a FROM spans),
       levels AS (SELECT p.n, p.t, count(s.a) AS open FROM points p LEFT JOIN spans s ON s.a <= p.t AND s.b > p.t GROUP BY 1, 2),
       peaks AS (SELECT n, max(open) AS peak FROM levels GROUP BY n),
       starts AS (SELECT a // 3600000000 AS n, count(*) AS started FROM spans GROUP BY 1)
       SELECT n * 3600 AS bucket_start, coalesce(started, 0)::BIGINT AS total_requests, peak::BIGINT AS peak_concurrent
       FROM peaks LEFT JOIN starts USING (n)
       UNION ALL SELECT NULL, (SELECT count(*) FROM spans), (SELECT max(peak) FROM peaks)""",
)
def peak_concurrency(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = events(spark, d).select(
        start.alias("start_us"), (start + F.round(F.col("value") * 100).cast("long") * 10_000).alias("end_us")
    )
    return rq.peak_concurrency(spans, "start_us", "end_us")


# ---- streams over the same table -----------------------------------------------------------


SLICES = 3  # the tables come to the streams in so many runs


def _updated(rows: DataFrame, live_rows, name: str, *keys: str) -> DataFrame:
    """Run a windowed stream in update mode over slices; every window comes out, open ones too."""
    out = work_path(rows.sparkSession, name)
    feed(rows, "ts", SLICES, lambda s: live.start_updates(live_rows(s), f"{out}/rows", f"{out}/checkpoint"))
    return live.read_updates(rows.sparkSession, f"{out}/rows", *keys)


@query(
    "stream_metrics",
    f"""SELECT {_start(300)} AS window_start, event_type, count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS rate,
               round(avg(value), 6) AS mean_latency, round(count(*) FILTER (value < 50) / count(*), 6) AS ratio
        FROM events GROUP BY 1, 2""",
)
def stream_metrics(spark, d):
    return _updated(
        events(spark, d),
        lambda s: live.live_metrics(s, "value", F.col("value") < 50, "event_type"),
        "live-metrics",
        "window_start",
        "event_type",
    )


@query(
    "stream_over_limit",
    f"SELECT {_start(3600)} AS window_start, user_id, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def stream_over_limit(spark, d):
    return _updated(
        events(spark, d), lambda s: live.live_over_limit(s, "user_id", 1, seconds=3600), "live-limit", "window_start", "user_id"
    )


@query(
    "stream_first_asked",
    """WITH RECURSIVE asked AS (SELECT event_type || '|' || props AS asked, epoch_us(ts) AS t FROM events),
       stored AS (
         SELECT asked, min(t) AS t FROM asked GROUP BY asked
         UNION ALL
         SELECT s.asked, min(a.t) FROM stored s JOIN asked a ON a.asked = s.asked AND a.t >= s.t + 3600000000 GROUP BY s.asked, s.t)
       SELECT asked, t AS asked_at FROM stored""",
)
def stream_first_asked(spark, d):
    """Requests that find no answer younger than an hour, out of a log that comes in slices."""
    return first_asked_in(spark, d, SLICES)


def first_asked_in(spark: SparkSession, d: str, slices: int) -> DataFrame:
    rows = events(spark, d).select("ts", "event_type", "props")
    out = work_path(spark, "first-asked")
    props = F.create_map(F.lit("props"), F.col("props"))
    parts = (F.col("event_type"), F.lit("default"), F.lit(5), F.lit(True), F.lit(True), props)
    key = F.when(F.col("event_type").isNotNull(), F.concat_ws("|", query_key(*parts), "event_type", "props"))

    def start(stream: DataFrame):
        passed = repeats.first_asked(stream.withColumn("cache_key", key), "cache_key")
        sink = passed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        return sink.outputMode("append").trigger(availableNow=True).start()

    # a heartbeat far behind the last request moves the watermark past it
    heartbeat = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).where("ts IS NOT NULL")
    feed(rows, "ts", slices, start, heartbeat.select("ts", F.lit(None).alias("event_type"), F.lit(None).alias("props")))
    passed = spark.read.schema("key string, asked_at timestamp").parquet(f"{out}/rows")
    return passed.select(F.substring_index("key", "|", -2).alias("asked"), F.unix_micros("asked_at").alias("asked_at"))


def _ingest(spark: SparkSession, d: str) -> str:
    out = work_path(spark, "ingest")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    metadata = F.create_map(
        F.lit("source"), F.col("source"), F.lit("file_type"), F.lit("txt"), F.lit("filename"), F.col("doc_id")
    )

    def start(stream: DataFrame):
        named = stream.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.col("text").alias("content"))
        return live_ingest.start_ingest(named, metadata, out, f"{out}/checkpoint")

    feed(docs, "doc_id", SLICES, start)
    return out


_VALID_SQL = f"{LENGTH_SQL} >= 50 AND NOT (" + " OR ".join(
    any_sql("text", p) for p in validation.DOCUMENT_RULES.values()
) + ")"


@query(
    "stream_ingest",
    f"""WITH {CHUNKS_SQL}, valid AS (SELECT doc_id, {_VALID_SQL} AS ok FROM documents)
        SELECT source || '_' || substr(sha256(chunks[i]), 1, 16) AS chunk_id, length(any_value(chunks[i])) AS chars
        FROM (SELECT source, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM chunked JOIN valid USING (doc_id) WHERE ok)
        GROUP BY 1""",
)
def stream_ingest(spark, d):
    chunks = live_ingest.read_chunks(spark, _ingest(spark, d))
    return chunks.select("chunk_id", F.length("content").cast("long").alias("chars"))


@query(
    "stream_rejects",
    f"SELECT source, count(*) AS rejected FROM documents WHERE NOT ({_VALID_SQL}) GROUP BY source",
)
def stream_rejects(spark, d):
    return live_ingest.read_rejected(spark, _ingest(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("rejected"))
