import pytest
from pyspark.sql import functions as F

from docweave.functions.ranks import bucketed_row_number, hot_keys, skew_join
from docweave.operators import graph, ingest, tenants, versions
from docweave.sources import tables

VERSIONS = "document_id string, version_number long, created_by string, change_summary string, content string, metadata map<string,string>"
LOG = [
    ("d1", 1, "ann", "first", "one", {"a": "1", "b": "1"}),
    ("d1", 2, "bob", "second", "two words", {"a": "2", "b": "1"}),
    ("d1", 3, "ann", "third", "one", {"a": "3"}),
    ("d2", 1, "bob", "first", "höhe", {}),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, VERSIONS)


def test_bucketed_numbering_equals_window(spark):
    rows = [(k, i % 17, i) for k in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(3)
    got = bucketed_row_number(df, ["k"], F.floor(F.col("t") / 4), ["t", "i"])
    order = {(k, i): n for k in "ab" for n, (_t, i) in enumerate(sorted((t, i) for kk, t, i in rows if kk == k), 1)}
    assert {(r.k, r.i): r.row_number for r in got.collect()} == order


def test_skew_join_keeps_all_rows(spark, few_rows_are_hot):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("m", 3)], "k string, i int")
    per = spark.createDataFrame([("h", 1, 50), ("c", 2, 1)], "k string, v int, n long")
    hot = hot_keys(per, ["k"], "n")
    assert [r.k for r in hot.collect()] == ["h"]
    got = skew_join(rows, per.drop("n"), ["k"], ["i"], hot)
    assert sorted((r.k, r.i, r.v) for r in got.collect()) == sorted([("h", i, 1) for i in range(50)] + [("c", 1, 2)])
    assert skew_join(rows, per.drop("n"), ["k"], ["i"], hot, "left").count() == 53


def test_create(spark, log):
    req = spark.createDataFrame([("d1", "x"), ("d9", "y")], "document_id string, content string")
    made, conflicts = versions.create(log, req)
    assert [(r.document_id, r.version_number, r.file_size_bytes) for r in made.collect()] == [("d9", 1, 1)]
    assert [r.document_id for r in conflicts.collect()] == ["d1"]


def test_requests_of_one_batch(spark, log):
    req = spark.createDataFrame([("n", "b", 2), ("n", "a", 1), ("n", "c", 3), ("d1", "x", 1)], "document_id string, content string, seq int")
    made, conflicts = versions.create(log, req, sequence="seq")
    assert [(r.document_id, r.content, r.version_number) for r in made.collect()] == [("n", "a", 1)]
    assert sorted((r.document_id, r.content) for r in conflicts.collect()) == [("d1", "x"), ("n", "b"), ("n", "c")]
    made, conflicts = versions.create(log, req.drop("seq"))
    assert made.count() == 1 and conflicts.count() == 3
    asked = [("d1", "u1", {"x": "1"}, 3, 1), ("d1", "u2", {"y": "2"}, 3, 2), ("d1", "u3", {"x": "3"}, 4, 3), ("d1", "u4", None, None, 4), ("q", "u", {}, 1, 1)]
    df = spark.createDataFrame(asked, "document_id string, content string, metadata map<string,string>, expected_version int, seq int")
    got = {r.content: (r.status, r.version_number, r.metadata, r.content_hash is None) for r in versions.update(log, df, sequence="seq").collect()}
    assert got == {
        "u1": ("updated", 4, {"a": "3", "x": "1"}, False),
        "u2": ("conflict", None, None, True),
        "u3": ("updated", 5, {"a": "3", "x": "3"}, False),
        "u4": ("updated", 6, {"a": "3", "x": "3"}, False),
        "u": ("not_found", None, None, True),
    }
    back = spark.createDataFrame([("d1", 1, None, 1), ("d1", 9, None, 2), ("d1", 2, None, 3)], "document_id string, target_version long, change_summary string, seq int")
    got = {r.target_version: (r.status, r.version_number) for r in versions.rollback(log, back, sequence="seq").collect()}
    assert got == {1: ("rolled_back", 4), 2: ("rolled_back", 5), 9: ("not_found", None)}


def test_update_merges_and_detects_conflicts(spark, log):
    req = [("d1", "new", {"b": "9"}, 3), ("d1", "late", {}, 2), ("d2", "n", None, None), ("d7", "n", {}, None)]
    df = spark.createDataFrame(req, "document_id string, content string, metadata map<string,string>, expected_version int")
    got = {(r.document_id, r.content): (r.status, r.version_number, r.metadata) for r in versions.update(log, df).collect()}
    assert got == {
        ("d1", "new"): ("updated", 4, {"a": "3", "b": "9"}),
        ("d1", "late"): ("conflict", None, None),
        ("d2", "n"): ("updated", 2, {}),
        ("d7", "n"): ("not_found", None, None),
    }


def test_rollback(spark, log):
    req = [("d1", 2, None), ("d1", 9, None), ("d2", 1, "why"), ("d9", 1, None), ("d1", 0, None)]
    df = spark.createDataFrame(req, "document_id string, target_version long, change_summary string")
    got = {(r.document_id, r.target_version): (r.status, r.version_number, r.change_summary, r.content) for r in versions.rollback(log, df).collect()}
    assert got[("d1", 2)] == ("rolled_back", 4, "Rolled back to version 2", "two words")
    assert got[("d2", 1)] == ("rolled_back", 2, "why", "höhe")
    assert {got[k][0] for k in [("d1", 9), ("d9", 1), ("d1", 0)]} == {"not_found"}


def test_history_get_compare_latest_delete_stats(spark, log, few_rows_are_hot):
    rows = {(r.document_id, r.version_number): r for r in versions.history(log, include_content=True).collect()}
    assert len(rows) == 4 and rows[("d1", 2)].current_version == 3 and rows[("d2", 1)].total_versions == 1
    assert rows[("d2", 1)].file_size_bytes == 5
    wanted = spark.createDataFrame([("d1", 2)], "document_id string, version_number long")
    assert [r.content for r in versions.get_version(log, wanted).collect()] == ["two words"]
    pairs = spark.createDataFrame([("d1", 1, 3), ("d1", 1, 2), ("d1", 0, 1), ("d1", 1, 9)], "document_id string, version1 long, version2 long")
    got = {(r.version1, r.version2): (r.content_same, r.size_difference_bytes) for r in versions.compare(log, pairs).collect()}
    assert got == {(1, 3): (True, 0), (1, 2): (False, 6)}
    assert {r.document_id: r.version_number for r in versions.latest(log).collect()} == {"d1": 3, "d2": 1}
    left = versions.delete_documents(log, spark.createDataFrame([("d1",)], "document_id string"))
    assert [r.document_id for r in left.collect()] == ["d2"]
    s = versions.stats(log).first()
    assert (s.total_documents, s.total_versions, s.total_storage_bytes, s.unique_contributors) == (2, 4, 20, 2)
    assert s.average_versions_per_document == 2.0
    assert versions.stats(log.where("false")).first().average_versions_per_document == 0.0


EDGES = "source_doc string, target_doc string, relationship_type string, weight double"


@pytest.fixture
def net(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefxyz"], "doc_id string")
    edges = [("a", "b", "citation", 0.9), ("b", "c", "citation", 0.4), ("a", "d", "related", 0.7), ("d", "c", "similarity", 1.0),
             ("c", "a", "reference", 0.2), ("x", "y", "hierarchy", 1.0), ("b", "b", "related", 0.1)]
    return nodes, spark.createDataFrame(edges, EDGES)


def test_edge_types(spark, net):
    odd = net[1].union(spark.createDataFrame([("a", "b", "likes", 1.0), ("a", "b", None, 1.0)], EDGES))
    good, bad = graph.checked_edges(odd)
    assert (good.count(), bad.count()) == (7, 2)


def test_related_computes_the_edges_once(spark, net):
    asked = spark.createDataFrame([("A",)], "doc_id string")
    edges = net[1].groupBy("source_doc", "target_doc", "relationship_type").agg(F.sum("weight").alias("weight"))
    plan = graph.related(edges, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(weight") == 1


def test_grouped_rows_are_dealt_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "GROUPED_ROWS", 100)
    rows = spark.range(1050).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    counted = tables.dealt(rows, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert counted.rdd.getNumPartitions() == 11 and counted.count() == 1050
    assert tables.dealt(rows.limit(0), "a").count() == 0


def test_related(spark, net):
    asked = spark.createDataFrame([("a",)], "doc_id string")

    def names(**kw):
        return [r.related_doc for r in graph.related(net[1], asked, **kw).orderBy("rank").collect()]

    assert names(direction="outgoing") == ["b", "d"]
    assert names(direction="incoming") == ["c"]
    assert names(min_weight=0.5, max_results=1) == ["b"]
    assert names(relationship_type="related") == ["d"]


def test_shortest_paths(spark, net, few_rows_are_hot):
    pairs = spark.createDataFrame([(1, "a", "c"), (2, "c", "b"), (3, "a", "y"), (4, "a", "a"), (5, "y", "x")], "pair_id int, source_doc string, target_doc string")
    directed = {r.pair_id: r.path for r in graph.shortest_paths(net[1], pairs, directed=True).collect()}
    assert directed == {1: ["a", "b", "c"], 2: ["c", "a", "b"], 3: None, 4: ["a"], 5: None}
    both = {r.pair_id: r.hops for r in graph.shortest_paths(net[1], pairs).collect()}
    assert both == {1: 1, 2: 1, 3: None, 4: 0, 5: 1}


def test_clusters(spark, net, few_rows_are_hot):
    got = {r.doc_id: (r.cluster, r.size) for r in graph.clusters(*net, min_size=2).collect()}
    assert got == {x: ("a", 4) for x in "abcd"} | {"x": ("x", 2), "y": ("x", 2)}


def test_label_propagation(spark, net, few_rows_are_hot):
    got = {r.doc_id: r.cluster for r in graph.label_propagation(*net, rounds=1).collect()}
    # neighbours of a: b c d; of b: a c; of c: a b d; of d: a c
    assert got == {"a": "b", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "x": "y", "y": "x", "z": "z"}
    sizes = {r.doc_id: r.size for r in graph.clusters(*net, min_size=2, method="labels").collect()}
    assert set(sizes) <= set("abcdxy")


def test_long_chain_settles(spark):
    n = 60
    nodes = spark.range(n).withColumnRenamed("id", "doc_id")
    edges = spark.range(n - 1).select(F.col("id").alias("source_doc"), (F.col("id") + 1).alias("target_doc"))
    assert graph.components(nodes, edges).select("cluster").distinct().count() == 1


def test_pagerank_equals_power_iteration(spark, net, few_rows_are_hot):
    names = list("abcdefxyz")
    out = {x: {} for x in names}
    for s, t, _k, w in [tuple(r) for r in net[1].collect()]:
        out[s][t] = out[s].get(t, 0) + w
    rank = {x: 1 / 9 for x in names}
    for _ in range(5):
        lost = sum(rank[x] for x in names if not out[x])
        new = {x: 0.15 / 9 + 0.85 * lost / 9 for x in names}
        for s in names:
            for t, w in out[s].items():
                new[t] += 0.85 * rank[s] * w / sum(out[s].values())
        rank = new
    got = {r.doc_id: r.rank for r in graph.pagerank(*net, iterations=5).collect()}
    assert got == {x: pytest.approx(v, abs=1e-12) for x, v in rank.items()}
    assert sum(got.values()) == pytest.approx(1.0)


def test_degree_and_stats(spark, net):
    got = {r.doc_id: (r.out_degree, r.in_degree) for r in graph.degree_centrality(*net).collect()}
    assert got["a"] == (2, 1) and got["f"] == (0, 0) and got["b"] == (2, 2)
    total = {r.relationship_type: (r.nodes, r.edges) for r in graph.graph_stats(*net).collect()}
    assert total["(all)"] == (9, 7) and total["citation"] == (9, 2)


def test_similarity_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, embedding array<float>")
    got = {(r.source_doc, r.target_doc) for r in graph.similarity_edges(v, 1, 0.9).collect()}
    assert got == {(1, 4), (2, 1), (4, 1)}


def test_tenants(spark):
    t = spark.createDataFrame([("a", "active", 2), ("b", "suspended", 1), ("c", "active", 1), ("d", "pending", 0)], "tenant_id string, status string, created_at int")
    assert [r.tenant_id for r in tenants.list_tenants(t, "active").collect()] == ["c", "a"]
    assert [r.tenant_id for r in tenants.list_tenants(t, limit=2).collect()] == ["d", "b"]
    assert {r.status: r.tenants for r in tenants.tenant_counts(t).collect()} == {"(all)": 4, "active": 2, "suspended": 1, "pending": 1}
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "tenant_id string, x int")
    assert [r.x for r in tenants.visible_rows(rows, t).collect()] == [1]
    assert [r.x for r in tenants.scope_to(rows, F.lit("b")).collect()] == [2]
    acc = spark.createDataFrame([("a", "a", True), ("a", "b", True), (None, "b", True), ("a", "b", False)], "context_tenant string, target_tenant string, iso boolean")
    assert tenants.violations(acc, F.col("iso")).count() == 2


def test_ingest_report(spark):
    batch = spark.createDataFrame([("1", "text"), ("2", None), (None, "x"), ("1", "text")], "id string, content string")
    totals, errors = ingest.ingest_report(ingest.ingest_errors(batch), F.lit(2))
    assert tuple(totals.first()) == (4, 2, 2, 4)
    assert sorted(tuple(r) for r in errors.collect()) == [("2", "missing content"), ("unknown", "missing id")]
    none, _e = ingest.ingest_report(ingest.ingest_errors(batch.where("false")), F.lit(2))
    assert tuple(none.first()) == (0, 0, 0, 0)
    assert [(r.id, r.copies) for r in ingest.duplicate_ids(batch).collect()] == [("1", 2)]
    assert not ingest.check_batch(batch).first().accepted
    assert ingest.check_batch(batch.where("content is null")).first().accepted


def test_paths_have_no_hop_limit(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "citation", 1.0) for i in range(20)], EDGES)
    pairs = spark.createDataFrame([(1, "n00", "n20"), (2, "n20", "nowhere")], "pair_id int, source_doc string, target_doc string")
    got = {r.pair_id: r.hops for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {1: 20, 2: None}
    assert graph.shortest_paths(edges, pairs, max_hops=5).where("hops IS NOT NULL").count() == 0


def test_label_propagation_ends_by_itself(spark):
    """Two triangles with a bridge settle; a single link swaps its labels for ever and is stopped."""
    def labels(links, rounds=None):
        e = spark.createDataFrame(links, "source_doc string, target_doc string")
        n = e.select(F.col("source_doc").alias("doc_id")).union(e.select("target_doc")).distinct()
        return {r.doc_id: r.cluster for r in graph.label_propagation(n, e, rounds).collect()}

    two = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    settled = labels(two)
    assert settled == labels(two, 30)
    assert sorted(labels([("a", "b")]).values()) == ["a", "b"]


def test_components_of_a_long_chain(spark):
    n = 40
    e = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "source_doc long, target_doc long")
    got = graph.components(spark.range(n + 1).select(F.col("id").alias("doc_id")), e).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [1, n]
