"""Plans that must not change by accident."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.operators import graph, validation, vectors
from docweave.plans.registry import QUERIES
from docweave.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pre_filter_reaches_the_scan(spark, small):
    v = table(spark, small, "documents").select(F.col("doc_id").alias("id"), "lang", F.array(F.lit(1.0)).alias("embedding"))
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    text = plan(vectors.exact_topk(q, v, 3, filters={"lang": "en"}))
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("name", ["chunk_documents", "validate_documents", "md_sections", "table_records", "request_rules"])
def test_row_work_has_no_shuffle_but_the_spreading_of_small_files(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert all("REPARTITION_BY_NUM" in line for line in exchanges)
    assert "Python" not in text


def test_chunks_are_computed_once(spark, small):
    text = plan(entry.queries()["chunk_documents"](spark, small))
    assert not [line for line in text.splitlines() if "Filter" in line and "aggregate(" in line]


def test_bm25_moves_no_postings(spark, small):
    text = plan(entry.queries()["bm25_topk"](spark, small))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(doc_id" in line or "Exchange hashpartitioning(term" in line]
    assert all("REPARTITION_BY_NUM" in line or "term" in line for line in moved)
    assert "SortMergeJoin" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_no_cross_joins(spark, small):
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        text = plan(fn(spark, small))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_validation_is_one_projection(spark, small):
    docs = table(spark, small, "documents").select(
        F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("source")).alias("metadata")
    )
    assert "Exchange" not in plan(validation.validate(docs))


def test_window_aggregates_combine_before_the_shuffle(spark, small):
    for name in ("request_rate_5m", "success_ratio_5m", "over_limit", "dedup_exact", "version_latest"):
        assert "partial_" in plan(entry.queries()[name](spark, small)), name


def test_links_stay_in_place_over_the_rounds(spark, few_rows_are_hot):
    edges = spark.range(300).selectExpr("id % 10 AS source_doc", "id AS target_doc")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for shown, hot in ((edges, True), (edges.where("false"), False)):
            links, hubs = graph._links(shown, False)
            assert (hubs is not None) is hot
            text = plan(graph._along(links.select("src").distinct().withColumn("x", F.lit(1)), links, hubs))
            scan = text[: text.rindex("Scan ExistingRDD")].splitlines()
            assert "Exchange" not in scan[-2] and "Sort" not in scan[-2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
