import math

import pytest
from pyspark.sql import functions as F

from docweave.operators import context, evaluation, ranking
from docweave.operators.ranking import Weights

SCHEMA = (
    "query_id int, rank int, query string, score double, document string, created_at string, last_updated string,"
    "view_count long, freshness_hint double, keyword_score double, doc_length int"
)
ROWS = [
    (1, 1, "two words", 0.8, "d1", None, None, 150, None, 0.5, None),
    (1, 2, "two words", 0.4, "d2", "2024-01-01", None, 50, None, 1.7, 50),
    (1, 3, "two words", -0.2, "d3", "2023-01-01", "2024-03-31T00:00:00Z", None, None, None, 500),
    (1, 4, "two words", 0.1, "d4", "bad", "not a date", 30, 0.9, -1.0, 150),
    (2, 1, "q", 0.0, "d5", "2030-01-01T00:00:00", None, 0, None, 0.0, 0),
    (3, 1, "q", -0.5, "d6", None, "2024-03-30T12:00:00+00:00", 0, None, 0.0, 1),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def features(rows):
    out = ranking.features(rows, F.lit("2024-03-31 12:00:00")).collect()
    return {r.document: r for r in out}


def test_features(rows):
    f = features(rows)
    assert [round(f[d].semantic_score, 9) for d in ("d1", "d2", "d3", "d5", "d6")] == [1.0, 0.5, -0.25, 0.0, 0.0]
    assert [f[d].keyword_score for d in ("d1", "d2", "d3", "d4")] == [0.5, 1.0, 0.0, 0.0]
    assert [f[d].popularity for d in ("d1", "d2", "d3")] == [1.0, 0.5, 0.0]
    assert [f[d].length_penalty for d in ("d1", "d5")] == [0.5, 0.5]
    assert f["d3"].length_penalty == pytest.approx(1 / 1.5)
    assert [f[d].ql_ratio for d in ("d1", "d2", "d6")] == [0.0, 0.04, 1.0]


def test_freshness(rows):
    f = {d: r.freshness for d, r in features(rows).items()}
    assert f["d1"] == 0.5  # no date
    assert f["d2"] == pytest.approx(math.exp(-90 / 90))
    assert f["d3"] == 1.0  # same day, last update wins over creation
    assert f["d4"] == 0.9  # unparsable, given value
    assert f["d5"] == 1.0  # future
    assert f["d6"] == pytest.approx(math.exp(-1 / 90))  # whole days only


def test_order_top_k_and_ties(rows, spark):
    as_of = F.lit("2024-03-31 12:00:00")
    got = [r.document for r in ranking.rank_results(rows.where("query_id = 1"), as_of).orderBy("rank").collect()]
    assert got == ["d2", "d1", "d4", "d3"]
    assert ranking.rank_results(rows, as_of, k=1).count() == 3
    zero = ranking.rank_results(rows.where("query_id = 1"), as_of, Weights(0, 0, 0, 0)).orderBy("rank").collect()
    assert [r.document for r in zero] == ["d1", "d2", "d3", "d4"] and {r.ranking_score for r in zero} == {0.0}
    plain = rows.select("query_id", "rank", "query", F.col("score").alias("relevance_score"), "document")
    ranked = ranking.rank_retrieved(plain.where("query_id = 1"), as_of).orderBy("rank").collect()
    assert ranked[0].document == "d1" and "semantic_score" not in ranked[0].asDict()


def test_weights():
    assert Weights(4, 3, 2, 1).normalized() == Weights(0.4, 0.3, 0.2, 0.1)
    assert Weights(0.5, 0.3, 0.1, 0.15).normalized() == Weights(0.5, 0.3, 0.1, 0.15)
    assert Weights(0, 0, 0, 0).normalized() == Weights(0, 0, 0, 0)
    assert Weights(-1, 0.2, 0.1, 0).normalized() == Weights(-1, 0.2, 0.1, 0)
    assert Weights().update(semantic=0.9).semantic == 0.9
    with pytest.raises(ValueError):
        Weights(semantic=-0.1).checked()


def results(spark, texts, pages=None):
    rows = [(1, i + 1, t, f"f{i}", (pages or [None] * len(texts))[i], 0.9 - i / 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id int, rank int, document string, filename string, page int, score double")


def test_context_stops_at_budget(spark):
    packed = context.pack_context(results(spark, ["x" * 40, "y" * 400, "z" * 4], [3, 0, None]), budget=20).first()
    assert packed.context == "[Source 1: f0 (page 3)]\n" + "x" * 40 + "\n"
    assert (packed.sources_used, packed.estimated_tokens) == (1, 10)
    both = context.pack_context(results(spark, ["a" * 7, "b"]), budget=1, method="rerank").first()
    assert both.context == "[Source 1: f0]\n" + "a" * 7 + "\n\n---\n[Source 2: f1]\nb\n"
    none = context.pack_context(results(spark, ["x" * 40]), budget=1).first()
    assert (none.context, none.sources_used) == ("", 0)


def test_stream_context_and_sources(spark):
    r = results(spark, ["one", "y" * 201], [2, None])
    assert context.stream_context(r).first().context == "[Source 1] one\n\n[Source 2] " + "y" * 201
    plain = context.source_rows(r).orderBy("index").collect()
    assert [tuple(x)[1:4] for x in plain] == [(1, "f0", 2), (2, "f1", None)]
    assert [x.text_preview[-3:] for x in plain] == ["one", "..."]
    assert context.source_rows(r, stream=True).orderBy("index").first().text_preview == "one..."


def test_confidence(spark):
    r = results(spark, ["a", "b", "c"])  # scores .9 .8 .7, two of them above .7
    q = spark.createDataFrame([(1, "x" * 100), (2, "any")], "query_id int, answer string")
    got = {x.query_id: x.confidence for x in context.confidence(q, r, decimals=6).collect()}
    assert got == {1: pytest.approx(0.45 + 0.3 * 2 / 3 + 0.1, abs=1e-6), 2: 0.0}
    low = r.withColumn("score", F.lit(-0.9))
    assert context.confidence(q.where("query_id = 1").withColumn("answer", F.lit("")), low).first().confidence == 0.0


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, True), (3, 1, False)], "query_id int, rank int, relevant boolean")
    totals = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 1), (5, 0)], "query_id int, n_relevant int")
    r = evaluation.evaluate(hits, totals).first()
    dcg = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert r.queries == 4
    assert r.mrr == pytest.approx((0.5 + 1) / 4)
    assert r.ndcg == pytest.approx((dcg + 1) / 4, abs=1e-6)
    assert r.recall == pytest.approx((1 + 1) / 4)
