import hashlib
import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.operators import approximate, impacts, keyword, retrieval, vectors


def vector_rows(n, dim, seed, collections=("default",)):
    rng = random.Random(seed)
    return [
        (i, [rng.gauss(0, 1) for _ in range(dim)], collections[i % len(collections)], "tech" if i % 3 else "business")
        for i in range(n)
    ]


def frames(spark, n_q=9, n_v=60, collections=("default",)):
    v = vector_rows(n_v, 6, 1, collections)
    v[3] = (3, [0.0] * 6, v[3][2], v[3][3])  # zero vector
    v[7] = (7, v[8][1], v[7][2], v[7][3])  # equal vectors
    q = [(i, x[1], collections[0]) for i, x in enumerate(vector_rows(n_q, 6, 2))]
    vdf = spark.createDataFrame(v, "id long, embedding array<float>, collection string, category string").repartition(5)
    return q, v, spark.createDataFrame(q, "query_id long, embedding array<float>, collection string"), vdf


def brute(q, v, k, metric="cosine", keep=lambda r: True):
    def unit(x):
        x = np.array(x, dtype=np.float32).astype(float)
        n = np.linalg.norm(x)
        return x / n if n else x

    out = {}
    for qid, qe, col in q:
        rows = []
        for vid, ve, vcol, cat in v:
            if vcol == col and keep((vid, ve, vcol, cat)):
                s = float(unit(qe) @ unit(ve)) if metric == "cosine" else float(((unit(qe) - unit(ve)) ** 2).sum())
                rows.append((round(s, 6), vid))
        rows.sort(key=lambda r: (-r[0] if metric == "cosine" else r[0], r[1]))
        out[qid] = [vid for _s, vid in rows[:k]]
    return out


def ranked(df, value="id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r[value])
    return out


def test_grid_searches_a_table_with_itself(spark):
    """Both sides of the grid come from one table, so their columns have one identity."""
    _, v, _, vdf = frames(spark)
    own = vdf.select(F.col("id").alias("query_id"), "embedding", "collection")
    got = ranked(vectors.exact_topk(own, vdf, 4, query_bound=2, vector_block=16))
    assert got == brute([(x[0], x[1], x[2]) for x in v], v, 4)


def test_cuts_of_the_grid_serve_all_cores_with_few_copies():
    rows = (32_768, 32_768)
    assert vectors._cuts(600_000, 600_000, rows, 12) == (19, 19)  # a row moves 19 times, 600 000 of them 38 in all
    q, v = vectors._cuts(10_000, 10_000, rows, 12)
    assert 6 <= q * v <= 48
    assert vectors._cuts(0, 0, rows, 12) == (1, 1)


def test_many_ties_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES_AT_ONCE", 7)
    v = spark.range(90).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding")).repartition(3)
    asked = v.select(F.col("id").alias("query_id"), "embedding").where("query_id < 3")
    for bound in (4096, 1):
        got = vectors.exact_topk(asked, v, 5, query_bound=bound, vector_block=16)
        assert ranked(got) == {i: [0, 1, 2, 3, 4] for i in range(3)}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bound", [4096, 4])
def test_exact_topk_on_both_plans(spark, metric, bound, monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS_AT_ONCE", 30)  # several slices per batch
    q, v, qdf, vdf = frames(spark)
    got = ranked(vectors.exact_topk(qdf, vdf, 5, metric, query_bound=bound, vector_block=16))
    assert got == brute(q, v, 5, metric)


def test_collections_and_unknown_collection(spark):
    q, v, qdf, vdf = frames(spark, collections=("tech", "hr", "default"))
    assert ranked(vectors.exact_topk(qdf, vdf, 4)) == brute(q, v, 4)
    assert vectors.exact_topk(qdf.withColumn("collection", F.lit("none")), vdf, 4).count() == 0


def test_pre_and_post_filter(spark):
    q, v, qdf, vdf = frames(spark)
    pre = ranked(vectors.exact_topk(qdf, vdf, 5, filters={"category": "tech"}))
    assert pre == brute(q, v, 5, keep=lambda r: r[3] == "tech")
    kept = {i: r[3] for i, *r in [(x[0], *x) for x in v]}
    post = ranked(vectors.exact_topk(qdf, vdf, 5, filters={"category": "tech"}, filter_mode="post"))
    expected = {qid: [i for i in ids if kept[i] == "tech"] for qid, ids in brute(q, v, 5).items()}
    assert post == {qid: ids for qid, ids in expected.items() if ids}


def test_ties_go_by_id_and_string_ids_work(spark):
    v = spark.createDataFrame([(f"d{i:02d}", [1.0, 1.0]) for i in range(30)], "id string, embedding array<float>").repartition(4)
    q = spark.createDataFrame([("q", [2.0, 2.0])], "query_id string, embedding array<float>")
    assert ranked(vectors.exact_topk(q, v, 3)) == {"q": ["d00", "d01", "d02"]}


def test_empty_and_odd_inputs(spark):
    _q, _v, qdf, vdf = frames(spark)
    assert vectors.exact_topk(qdf.where("false"), vdf, 3).count() == 0
    assert vectors.exact_topk(qdf, vdf.where("false"), 3).count() == 0
    odd = vdf.unionByName(vdf.limit(1).withColumn("id", F.lit(999).cast("long")).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert 999 not in {r.id for r in vectors.exact_topk(qdf, odd, 60).collect()}


def clustered(spark, n, collections=("a",)):
    """Vectors around 40 centres in 32 dimensions, as arrays and as a table."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    m = centres[rng.integers(0, 40, n)] + 0.35 * rng.standard_normal((n, 32))
    rows = [(i, collections[i % len(collections)], x.tolist()) for i, x in enumerate(m)]
    return m, spark.createDataFrame(rows, "id long, collection string, embedding array<float>")


@pytest.mark.parametrize("broadcast_rows", [4096, 0])
def test_approximate_search_reads_probed_lists_only(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(approximate, "QUERY_ROWS", broadcast_rows)
    monkeypatch.setattr(approximate, "CHUNK_ROWS", 40)  # long lists are cut
    _m, vdf = clustered(spark, 3000, ("a", "b"))
    q = vdf.where("id % 60 = 0").withColumnRenamed("id", "query_id")
    index = approximate.build(vdf, lists=60)
    hits, counts = index.topk(q, 10, probes=6)
    got = vectors.recall(hits, vectors.exact_topk(q, vdf, 10)).first()
    work = counts.first()
    assert got.expected == 500 and got.recall >= 0.9
    assert work.scored <= work.scanned < 0.2 * 3000 * 50 and work.scored < 0.1 * 3000 * 50
    rows = hits.collect()
    assert len({(r.query_id, r.id) for r in rows}) == len(rows)
    exact = {(r.query_id, r.id): r.score for r in vectors.exact_topk(q, vdf, 10).collect()}
    assert all(r.score == exact[r.query_id, r.id] for r in rows if (r.query_id, r.id) in exact)


def test_all_lists_and_an_exact_screen_are_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(approximate, "TAIL_COSINE", 1.0)
    _m, vdf = clustered(spark, 400)
    q = vdf.where("id < 20").withColumnRenamed("id", "query_id")
    hits, _ = approximate.approximate_topk(q, vdf, 7, probes=12, lists=12)
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())
    assert key(hits) == key(vectors.exact_topk(q, vdf, 7))


def test_lists_are_partitions_that_the_scan_prunes(spark):
    _m, vdf = clustered(spark, 500)
    index = approximate.build(vdf, lists=10)
    plan = index.rows.where(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert index.rows.count() == 500


def test_approximate_search_on_odd_input(spark):
    ddl = "id long, collection string, embedding array<float>"
    mixed = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", None), (4, "a", []), (5, "a", [1.0, 0.0, 0.0]), (6, "b", [1.0, 0.0]), (7, "a", [1.0, 0.0])], ddl)
    q = spark.createDataFrame([(9, "a", [2.0, 0.0]), (10, "a", None), (11, "c", [1.0, 0.0]), (12, "a", [1.0])], "query_id long, collection string, embedding array<float>")
    hits, _ = approximate.approximate_topk(q, mixed, 5)
    assert [(r.query_id, r.id, r.score) for r in hits.orderBy("query_id", "rank").collect()] == [(9, 1, 1.0), (9, 7, 1.0), (9, 2, 0.0)]
    assert approximate.approximate_topk(q, mixed.limit(0), 5)[0].count() == 0
    assert approximate.approximate_topk(q.limit(0), mixed, 5)[0].count() == 0
    assert approximate.neighbour_graph(mixed.limit(0), 3).count() == 0


def test_vectors_are_made_once_for_the_neighbour_graph(spark):
    """What makes the vectors may be costly, so the graph reads stored ones."""
    made = spark.sparkContext.accumulator(0)

    def model(texts):
        made.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(t.count("a")), 1.0])

    texts = spark.createDataFrame([(i, "a" * (i % 7) + "b" * (i % 11)) for i in range(60)], "id long, t string")
    links = approximate.neighbour_graph(vectors.embed_with(texts, "t", model).drop("t"), 3, probes=3, lists=6)
    assert links.count() == 180 and made.value == 60


def test_first_look_keeps_the_best_of_a_block():
    best = approximate._Best(2, 3, np.full(2, approximate.NO_BAR), 6)
    scores = np.random.default_rng(3).uniform(-1, 1, (2, 50))
    best.add_block(np.arange(2), scores, np.arange(50))
    assert best.size < 10  # not all hundred pairs
    best.prune()
    q, _, ids = best.rows[0]
    assert [ids[q == i].tolist() for i in range(2)] == np.argsort(-scores, axis=1)[:, :3].tolist()


def test_neighbour_graph_finds_the_nearest(spark):
    m, vdf = clustered(spark, 1500)
    links = approximate.neighbour_graph(vdf, 5, probes=3, rounds=1, lists=40).collect()
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    best = [set(np.lexsort((np.arange(1500), -s[i]))[:5]) for i in range(1500)]
    found = {}
    for r in links:
        found.setdefault(r.source, set()).add(r.target)
        assert abs(s[r.source, r.target] - r.score) < 2e-6
    assert all(len(v) == 5 and k not in v for k, v in found.items()) and len(found) == 1500
    assert sum(len(best[k] & v) for k, v in found.items()) >= 0.95 * 7500


def test_upsert_modes_and_delete(spark):
    base = spark.createDataFrame([("c", 1, [1.0], "a"), ("c", 2, [2.0], "b")], "collection string, id int, embedding array<float>, note string")
    new = spark.createDataFrame([("c", 1, [9.0], "n1", 1), ("c", 1, [8.0], "n2", 2), ("d", 1, [7.0], "x", 1)], "collection string, id int, embedding array<float>, note string, seq int")
    rows = {(r.collection, r.id): (r.embedding, r.note) for r in vectors.upsert(base, new).collect()}
    assert rows == {("c", 1): ([8.0], "n2"), ("c", 2): ([2.0], "b"), ("d", 1): ([7.0], "x")}
    kept = sorted((r.collection, r.id, r.embedding[0], r.note) for r in vectors.upsert(base, new, mode="append").collect())
    assert kept == [("c", 1, 1.0, "n2"), ("c", 1, 8.0, "n2"), ("c", 1, 9.0, "n2"), ("c", 2, 2.0, "b"), ("d", 1, 7.0, "x")]
    left = vectors.delete(base, spark.createDataFrame([("c", 1), ("z", 2)], "collection string, id int"))
    assert [r.id for r in left.collect()] == [2]


def test_caller_models(spark):
    texts = spark.createDataFrame([("ab",), ("c",)], "t string")
    out = vectors.embed_with(texts, "t", lambda s: s.map(lambda x: [float(len(x)), 1.0]))
    assert [r.embedding for r in out.collect()] == [[2.0, 1.0], [1.0, 1.0]]
    hashed = vectors.hash_embed(texts.union(spark.createDataFrame([("",)], "t string")), "t", 8).collect()
    assert [round(math.fsum(x * x for x in r.embedding), 5) for r in hashed] == [1.0, 1.0, 0.0]


CORPUS = [(1, "The cat sat on the mat"), (2, "dogs and cats"), (3, "a cat, a dog; a cat"), (4, ""), (5, "bird")]


def okapi(docs, query):
    toks = {i: t.lower().replace(",", "").replace(";", "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    out = {}
    for i, t in toks.items():
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split())
        if s > 0:
            out[i] = round(s, 6)
    return out


QUERIES = [(1, "cat"), (2, "cat cat the"), (3, "nothing"), (4, "a dog"), (5, "")]


@pytest.mark.parametrize("term_bytes", [32 * 1024 * 1024, -1])
def test_bm25_on_both_plans(spark, tmp_path, few_rows_are_hot, monkeypatch, term_bytes):
    monkeypatch.setattr(keyword, "QUERY_TERMS_BYTES", term_bytes)
    docs = spark.createDataFrame(CORPUS, "doc_id int, text string")
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    expected = {q: okapi(CORPUS, t) for q, t in QUERIES}
    expected = {q: v for q, v in expected.items() if v}
    direct = keyword.search_documents(docs, queries, 10)
    stored = keyword.search_index(keyword.build_index(docs).write(str(tmp_path / "index")), queries, 10)
    for found in (direct, stored):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.id] = r.score
        assert got == expected


def test_bm25_in_small_pieces(spark, tmp_path, monkeypatch):
    """Pieces of any size, documents without terms between them, string ids and ties."""
    corpus = [(f"d{i:03}", t) for i, t in zipf_corpus(150, 8)] + [("x", None), ("a", "t1 t1 t2"), ("b", "t1 t1 t2"), ("", "?!")]
    docs = spark.createDataFrame(corpus, "doc_id string, text string").repartition(3)
    queries = spark.createDataFrame([(i, t) for i, t in zipf_corpus(20, 9)] + [(50, "t1"), (51, "zz")], "query_id int, text string")
    monkeypatch.setattr(keyword, "QUERY_TERMS_BYTES", -1)
    joined = sorted(map(tuple, keyword.search_documents(docs, queries, 6).select("query_id", "id", "score", "rank").collect()))
    monkeypatch.undo()
    monkeypatch.setattr(keyword, "TERMS_AT_ONCE", 50)
    monkeypatch.setattr(keyword, "PARTS_AT_ONCE", 70)
    stored = keyword.write_index(docs, str(tmp_path / "i"))
    for found in (keyword.search_documents(docs, queries, 6), keyword.search_index(stored, queries, 6)):
        assert sorted(map(tuple, found.select("query_id", "id", "score", "rank").collect())) == joined
    assert len({r[0] for r in joined}) == len({q for q, *_ in joined}) > 15


def test_bm25_pairs_never_become_rows(spark):
    """Neither pairs of query and document nor postings are grouped or moved: only the best of each task are."""
    docs = spark.createDataFrame(CORPUS, "doc_id int, text string")
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    plan = keyword.search_documents(docs, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Generate" not in plan


def test_bm25_of_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert keyword.search_documents(docs, spark.createDataFrame(QUERIES, "query_id int, text string"), 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, score double, rank int")


def test_fusion_order_and_ties(spark):
    sem = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)])
    kw = hits(spark, [(1, "c", 5.0, 1), (1, "b", 4.0, 2)])
    got = [(r.id, r.score) for r in retrieval.fuse(sem, kw, 5).orderBy("rank").collect()]
    assert got == [("b", round(1 / 61, 9)), ("a", round(0.5 / 60, 9)), ("c", round(0.5 / 60, 9))]
    assert [r.id for r in retrieval.fuse(sem, kw, 1, alpha=0.0).collect()] == ["c"]
    with pytest.raises(ValueError):
        retrieval.fuse(sem, kw, 1, alpha=1.5)


def test_dispatcher(spark):
    sem = lambda k: hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)]).where(F.col("rank") <= k)
    kw = lambda k: hits(spark, [(1, "c", 5.0, 1)])
    assert {r.id for r in retrieval.retrieve(sem, kw, 3).collect()} == {"a", "b", "c"}
    assert [r.id for r in retrieval.retrieve(sem, kw, 1, use_hybrid=False).collect()] == ["a"]
    assert [r.id for r in retrieval.retrieve(sem, None, 1).collect()] == ["a"]


def test_rerank(spark):
    rows = [(1, "a", 1, "red blue", "nothing"), (1, "b", 2, "red blue", "Blue and red"), (1, "c", 3, "red blue", "red"),
            (2, "x", 1, " ", "same"), (2, "y", 2, " ", "other")]
    df = spark.createDataFrame(rows, "query_id int, id string, rank int, query string, document string")
    assert ranked(retrieval.rerank(df, 2)) == {1: ["b", "c"], 2: ["x", "y"]}
    scorer = retrieval.pair_scorer(lambda q, d: d.str.len().astype(float))
    assert ranked(retrieval.rerank(df, None, scorer=scorer)) == {1: ["b", "a", "c"], 2: ["x", "y"]}


def test_lookup_fills_source(spark):
    docs = spark.createDataFrame([("a", "text", None)], "doc_id string, document string, source string")
    r = retrieval.lookup(hits(spark, [(1, "a", 0.9, 1), (1, "z", 0.5, 2)]), docs).orderBy("rank").collect()
    assert [(x.document, x.source) for x in r] == [("text", "unknown"), (None, "unknown")]


def test_queries_of_other_dimensions_do_not_disturb(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [1.0, 0.0, 0.0]), ("a", 4, None)], "collection string, id long, embedding array<double>")
    asked = [(1, "a", [1.0, 0.1]), (2, "a", [1.0, 0.0, 0.0]), (3, "b", [1.0, 1.0, 0.0]), (4, "c", [1.0, 0.0]), (5, "a", [])]
    q = spark.createDataFrame(asked, "query_id long, collection string, embedding array<double>")
    for bound in (4096, 2):
        got = vectors.exact_topk(q, v, 1, query_bound=bound, vector_block=2)
        assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 1), (3, 3)]
    assert sorted((r.query_id, r.reason) for r in vectors.misfits(q, v).collect()) == [(2, "dimension"), (4, "unknown collection"), (5, "no vector")]
    plain = vectors.misfits(q.drop("collection"), v.drop("collection"))
    assert [(r.query_id, r.reason) for r in plain.collect()] == [(5, "no vector")]
    with pytest.raises(TypeError):
        vectors.exact_topk(q, v.withColumn("id", F.col("id").cast("double")), 1)


def test_index_of_one_pass_equals_the_other(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, ""), (4, None), (5, "b d e f")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b c"), (2, "zz")], "query_id long, text string")
    one, two = keyword.write_index(docs, str(tmp_path / "i")), keyword.build_index(docs)
    assert sorted(map(tuple, one.terms.collect())) == sorted(map(tuple, two.terms.collect()))
    assert one.corpus.first().asDict() == two.corpus.first().asDict()
    assert keyword.search_index(one, asked, 5).collect() == keyword.search_index(two, asked, 5).collect() != []


def zipf_corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(400)]
    chance = 1 / np.arange(1, 401)
    sizes = rng.integers(0, 60, n)
    return [(i, " ".join(rng.choice(words, size, p=chance / chance.sum()))) for i, size in enumerate(sizes)]


@pytest.mark.parametrize("term_bytes,pair_rows,heads", [(32 * 1024 * 1024, 500_000, 64), (-1, -1, 2)])
def test_pruned_search_equals_the_full_one(spark, tmp_path, few_rows_are_hot, monkeypatch, term_bytes, pair_rows, heads):
    monkeypatch.setattr(keyword, "QUERY_TERMS_BYTES", term_bytes)
    monkeypatch.setattr(impacts, "BROADCAST_ROWS", pair_rows)
    monkeypatch.setattr(impacts, "HEADS", heads)
    corpus = zipf_corpus(400, 5) + [(900, None), (901, "t1 t1 t2"), (902, "t1 t1 t2")]  # nulls and ties
    asked = [(i, text) for i, text in zipf_corpus(25, 6)] + [(50, "t0 t0 t0"), (51, "zz"), (52, ""), (53, "t399 zz t0")]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = keyword.build_index(docs).write(str(tmp_path / "index"))
    pruned = impacts.write_impacts(index, str(tmp_path / "impacts"))
    for k in (1, 7):
        full = sorted(map(tuple, keyword.search_index(index, queries, k).select("query_id", "id", "score", "rank").collect()))
        got = sorted(map(tuple, impacts.search_impacts(pruned, queries, k).select("query_id", "id", "score", "rank").collect()))
        assert got == full and full
    monkeypatch.setattr(impacts, "SKIP", 1.0)  # the fewest postings
    work = {r.query_id: r for r in impacts.search_work(pruned, queries, 1).collect()}
    assert sum(r.read for r in work.values()) < 0.5 * sum(r.postings for r in work.values())
    assert 51 not in work and 52 not in work


def test_pruned_search_reads_only_levels_it_needs(spark, tmp_path):
    docs = spark.createDataFrame(zipf_corpus(300, 7), "doc_id long, text string")
    index = impacts.write_impacts(keyword.build_index(docs).write(str(tmp_path / "i")), str(tmp_path / "p"))
    queries = spark.createDataFrame([(1, "t350 t0")], "query_id long, text string")
    _, matches = impacts._plan(index, queries, 1, "text", 6)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]
    assert "shelf" in filters and "level" in filters
    assert matches.count() > 0


def test_models_get_texts_in_short_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "EMBED_ROWS", 3)

    def model(texts):
        return texts.map(lambda t: None if t is None else [float(t), float(len(texts))])

    rows = spark.range(0, 10, 1, 1).selectExpr("id", "IF(id = 4, NULL, cast(id as string)) AS text")
    got = {r.id: r.embedding for r in vectors.embed_with(rows, "text", model).collect()}
    assert got == {i: None if i == 4 else [float(i), 1.0 if i == 9 else 3.0] for i in range(10)}


def test_pruned_search_reads_a_posting_once_for_all_queries(spark, tmp_path):
    docs = spark.createDataFrame(zipf_corpus(300, 8), "doc_id long, text string")
    index = impacts.write_impacts(keyword.build_index(docs).write(str(tmp_path / "i")), str(tmp_path / "p"))
    queries = spark.createDataFrame([(i, f"t0 t1 t{i}") for i in range(40)], "query_id long, text string")
    _, matches = impacts._plan(index, queries, 5, "text", 6)
    assert 0 < matches.count() == matches.select("doc_id", "term").distinct().count()
    work = {r.query_id: r for r in impacts.search_work(index, queries, 5).collect()}
    assert sum(r.read for r in work.values()) > matches.count()  # each query still counts what it reads


def test_pruned_search_of_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = impacts.write_impacts(keyword.build_index(docs).write(str(tmp_path / "i")), str(tmp_path / "p"))
    assert impacts.search_impacts(index, spark.createDataFrame(QUERIES, "query_id int, text string"), 3).count() == 0


def test_pruned_index_holds_all_postings_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK_POSTINGS", 200)  # many blocks, and documents longer than one
    long = " ".join(f"t{i}" for i in range(300))
    corpus = [(f"d{i}", text) for i, text in [*zipf_corpus(120, 9), (500, long), (501, "")]]
    docs = spark.createDataFrame(corpus, "doc_id string, text string")
    for name, texts in (("strings", docs), ("numbers", docs.withColumn("doc_id", F.expr("int(substr(doc_id, 2))")))):
        index = keyword.build_index(texts).write(str(tmp_path / name))
        pruned = impacts.write_impacts(index, str(tmp_path / f"{name}-impacts"))
        rows = pruned.postings.collect()
        avg_len = index.corpus.first()["avg_len"]
        tf, dl = F.col("tf"), F.col("doc_len")
        weight = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))
        want = {(r.term, r.doc_id): r.w for r in index.postings.select("term", "doc_id", weight.alias("w")).collect()}
        assert len(rows) == len(want) and {(r.term, r.doc_id): r.weight for r in rows} == pytest.approx(want)
        blocks = pruned.blocks.select("block").distinct().count()
        assert blocks > 5 and pruned.blocks.count() <= blocks * impacts.SHELVES * (impacts.HIGHEST - impacts.LOWEST + 1)
        queries = spark.createDataFrame(zipf_corpus(12, 10), "query_id int, text string")
        full = keyword.search_index(index, queries, 4).select("query_id", "id", "score", "rank").collect()
        got = impacts.search_impacts(pruned, queries, 4).select("query_id", "id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, full)) != []


def test_kernels_of_the_pruned_search_need_no_package_on_the_worker(tmp_path):
    from pyspark import cloudpickle

    kernels = (impacts._block_batches, impacts._open_batches, impacts._work_batches, impacts._head_batches)
    (tmp_path / "kernels").write_bytes(cloudpickle.dumps(kernels))
    code = "import pickle, sys; print(len(pickle.load(open('kernels', 'rb'))), 'docweave' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split() == ["4", "False"], done.stderr


def found_share(m, links, k):
    """Share of the exact ``k`` neighbours of all rows among the links."""
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    best = {(i, int(j)) for i in range(len(m)) for j in np.lexsort((np.arange(len(m)), -s[i]))[:k]}
    found = {(r.source, r.target): r.score for r in links}
    assert all(a != b and abs(s[a, b] - score) < 2e-6 for (a, b), score in found.items()) and len(found) == len(links) == k * len(m)
    return len(best & set(found)) / len(best)


def test_neighbour_graph_finds_scattered_vectors_too(spark):
    """Vectors far from all others have their neighbours in many lists."""
    m = np.random.default_rng(11).standard_normal((1200, 10))
    vdf = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>").repartition(4)
    assert found_share(m, approximate.neighbour_graph(vdf, 5, probes=4, lists=60).collect(), 5) >= 0.94


def test_neighbour_graph_around_a_hub_of_copies(spark, monkeypatch):
    """Copies all name the same few; areas and what meets a hub are cut into chunks."""
    monkeypatch.setattr(approximate, "CHUNK_ROWS", 64)
    monkeypatch.setattr(approximate, "QUERY_CHUNKS", 1)
    m, _ = clustered(spark, 300)
    m[40:160] = m[40]
    vdf = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>").repartition(4)
    links = approximate.neighbour_graph(vdf, 4, probes=3, lists=12).collect()
    assert found_share(m, links, 4) >= 0.95
    copies = {r.source: set() for r in links if 40 <= r.source < 160}
    for r in links:
        copies.get(r.source, set()).add(r.target)
    assert all(to == set([x for x in range(40, 45) if x != i][:4]) for i, to in copies.items())


def test_term_vectors_equal_the_plain_count():
    texts = ["", None, " ", "a", "_x__ ß12½٣²", "日本語 テキスト、词", "é x", "😀a𝒳b‍", " ".join("ä" * i + " b" for i in range(60)), *("x" * i for i in range(50, 70))]
    plain = [np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16 for w in re.findall(r"\w+", t or "")], minlength=16) for t in texts]
    model = vectors.term_counts_model(16)
    assert [x.tolist() for x in model(pd.Series(texts, dtype=object))] == [x.tolist() for x in plain]
    assert vectors._embedded(pa.array([*texts, "z"]).slice(2, 9), model).to_pylist() == [x.tolist() for x in plain[2:11]]
