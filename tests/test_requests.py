import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import requests as rq

T0 = datetime(2024, 1, 1)
EPOCH = int(T0.replace(tzinfo=timezone.utc).timestamp())


def log(spark, rows):
    data = [(T0 + timedelta(seconds=s), k, v) for s, k, v in rows]
    return spark.createDataFrame(data, "ts timestamp_ntz, k string, v double")


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantile_equals_numpy(spark, q):
    rng = random.Random(4)
    groups = {
        "ties": [rng.choice([1.0, 2.0, 2.0]) for _ in range(80)],
        "wide": [rng.lognormvariate(0, 3) for _ in range(97)],
        "signs": [rng.uniform(-50, 50) for _ in range(60)] + [0.0],
        "one": [7.5],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("ties", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.quantile for r in rq.exact_quantile(df, ["k"], "v", q).collect()}
    assert got == {k: pytest.approx(np.quantile(v, q), abs=1e-9) for k, v in groups.items()}


def test_rate_mean_ratio(spark):
    df = log(spark, [(0, "a", 1.0), (299, "a", 3.0), (300, "b", 5.0)])
    rate = {(r.window_start - EPOCH, r.k): r.requests for r in rq.request_rate(df, "k").collect()}
    assert rate == {(0, "a"): 2, (300, "b"): 1}
    assert {r.mean_latency for r in rq.mean_latency(df, "v").collect()} == {2.0, 5.0}
    assert sorted(r.ratio for r in rq.ratio(df, F.col("v") > 2).collect()) == [0.5, 1.0]


def test_histogram_quantile(spark):
    df = log(spark, [(i, "a", v) for i, v in enumerate([0.5, 0.5, 1.5, 3.0])])
    r = rq.histogram_quantile(df, "v", q=0.5, buckets=[1.0, 2.0, 4.0]).first()
    assert r.latency_quantile == 1.0
    r = rq.histogram_quantile(df, "v", q=0.75, buckets=[1.0, 2.0, 4.0]).first()
    assert r.latency_quantile == 2.0
    beyond = rq.histogram_quantile(df, "v", q=0.99, buckets=[1.0, 2.0]).first()
    assert beyond.latency_quantile == 2.0


def test_token_cost(spark):
    df = spark.createDataFrame([(1000, 2000), (0, 0)], "i int, o int")
    r = rq.token_cost(df, F.col("i"), F.col("o")).first()
    assert (r.input_tokens, r.output_tokens, r.cost) == (1000, 2000, 0.15)


def test_alerts_need_consecutive_windows(spark):
    rows = [(0, 0.9), (300, 0.8), (600, 0.1), (900, 0.7), (1500, 0.7), (1800, 0.95), (2100, 0.6)]
    df = spark.createDataFrame([("x", s, v) for s, v in rows], "k string, window_start long, v double")
    got = sorted((r.started, r.ended, r.windows, r.peak) for r in rq.alerts(df, "v", F.col("v") > 0.5, 600, "k").collect())
    assert got == [(0, 600, 2, 0.9), (1500, 2400, 3, 0.95)]


def test_caller_key(spark):
    rows = [
        (" key1 ", "9.9.9.9", None, None, "p"),
        ("  ", " 1.1.1.1 , 2.2.2.2", "3.3.3.3", None, "p"),
        (None, None, " 3.3.3.3 ", "4.4.4.4", "p"),
        (None, "", "", " 4.4.4.4", "p"),
        (None, None, None, None, "p"),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = [r[0] for r in df.select(rq.caller_key(*[F.col(x) for x in "abcde"])).collect()]
    assert got == ["key:key1", "ip:1.1.1.1", "ip:3.3.3.3", "ip:4.4.4.4", "ip:p", "ip:unknown"]


def test_over_limit(spark):
    df = log(spark, [(i, "a", 0.0) for i in range(5)] + [(61, "a", 0.0), (0, "b", 0.0)])
    got = [(r.window_start - EPOCH, r.k, r.requests, r.excess) for r in rq.over_limit(df, "k", 3).collect()]
    assert got == [(0, "a", 5, 2)]


def test_peak_concurrency_counts_overlaps(spark):
    rng = random.Random(2)
    spans = [(s := rng.randrange(0, 40_000_000), s + rng.randrange(0, 9_000_000)) for _ in range(200)]
    spans += [(100_000_000, 155_000_000)]  # buckets without any start or end
    df = spark.createDataFrame(spans, "s long, e long").repartition(4)
    got = {r.bucket_start: (r.total_requests, r.peak_concurrent) for r in rq.peak_concurrency(df, "s", "e", 10).collect()}
    expected = {}
    for b in range(min(s for s, _ in spans) // 10_000_000, max(e for _, e in spans) // 10_000_000 + 1):
        points = [b * 10_000_000, *(s for s, _ in spans if s // 10_000_000 == b)]
        peak = max(sum(s <= p < e for s, e in spans) for p in points)
        expected[b * 10] = (sum(s // 10_000_000 == b for s, _ in spans), peak)
    expected[None] = (len(spans), max(p for _, p in expected.values()))
    assert got == expected


def test_peak_concurrency_carries_open_spans(spark):
    df = spark.createDataFrame([(0, 25_000_000), (1_000_000, 12_000_000)], "s long, e long")
    got = {r.bucket_start: r.peak_concurrent for r in rq.peak_concurrency(df, "s", "e", 10).collect()}
    assert got == {0: 2, 10: 2, 20: 1, None: 2}
    assert rq.peak_concurrency(df.where("false"), "s", "e").count() == 0
