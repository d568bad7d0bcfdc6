"""The registered queries against their SQL, and the pipeline against plain code."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docweave.llm import queries
from tests.conftest import SMALL
from tests.llm import brute
from tests.oracle import compare, connect


def test_one_query_per_operator():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None


def test_pipeline_equals_plain_code(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    kept = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    ids = sorted(r[0] for r in kept.select("doc_id").collect())
    assert len(ids) >= len(docs) - 2
    texts = [x[2] for x in brute.line_dedup([(i, docs[i]) for i in ids])]
    roots = brute.groups([brute.fingerprint(t) for t in texts])
    left = [k for k, root in enumerate(roots) if root == k]
    found = {ids[k]: brute.contamination(texts[k], items) for k in left}
    clean = sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(got["doc_id"].unique()) == clean
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
