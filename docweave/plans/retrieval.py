"""Queries on vectors, keyword search, fusion, ranking, context (R, K, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.ranks import top_per_group
from docweave.functions.text import NO_RESULT_TEXT, WS
from docweave.functions.vector import norm, unit
from docweave.operators import approximate, context, evaluation, impacts, keyword, ranking, retrieval, vectors
from docweave.plans import inputs as inp
from docweave.plans.documents import digest, docs
from docweave.plans.registry import lit, query
from docweave.session import work_path
from docweave.sources.buckets import BucketTable
from docweave.sources.tables import table

BASE = inp.CORPUS_SQL


def long_rank():
    return F.col("rank").cast("long").alias("rank")


def hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "score", long_rank())


def flat(corpus: DataFrame) -> DataFrame:
    """The corpus as one collection."""
    return corpus.drop("collection")


# ---- collections ------------------------------------------------------------------------


@query(
    "normalize_vectors",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS component_sum,
              round(v[1] / n, 6) AS first_component, round(n, 6) AS length
       FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n
             FROM (SELECT vec_id, list_transform(embedding, lambda x: 3.0 * x::DOUBLE) AS v FROM embeddings))""",
)
def normalize_vectors(spark, d):
    v = table(spark, d, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * 3.0)
    ).withColumn("u", unit(F.col("v")))
    return v.select(
        "vec_id",
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"),
        F.round(F.get("u", F.lit(0)), 6).alias("first_component"),
        F.round(norm(F.col("v")), 6).alias("length"),
    )


def _updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Label collections, and updates from the quality table: reversed vectors in two versions."""
    emb, marks = table(spark, d, "embeddings"), table(spark, d, "labels")
    base = emb.select(
        F.col("label").cast("string").alias("collection"), F.col("vec_id").alias("id"), "embedding", F.lit("base").alias("note")
    )
    changed = marks.join(emb, marks["doc_id"] == emb["vec_id"]).select(
        F.col("label").cast("string").alias("collection"),
        # documents of low quality arrive as new ids
        F.when(F.col("quality") == 1, F.col("vec_id")).otherwise(F.col("vec_id") + 1_000_000).alias("id"),
        F.reverse("embedding").alias("embedding"),
    )
    return base, changed.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "note", F.concat(F.lit("v"), F.col("seq").cast("string"))
    )


_UPDATES_SQL = """
base AS (SELECT label::VARCHAR AS collection, vec_id AS id, embedding, 'base' AS note, -1 AS seq FROM embeddings),
changed AS (SELECT label::VARCHAR AS collection, CASE WHEN quality = 1 THEN vec_id ELSE vec_id + 1000000 END AS id,
                   list_reverse(embedding) AS embedding, 'v' || s::VARCHAR AS note, s AS seq
            FROM labels JOIN embeddings ON doc_id = vec_id, (VALUES (1), (2)) t(s)),
merged AS (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY seq DESC) AS r
           FROM (SELECT * FROM base UNION ALL SELECT * FROM changed))"""


@query(
    "vector_upsert",
    f"WITH {_UPDATES_SQL} SELECT collection, id, note, round(embedding[1]::DOUBLE, 6) AS first_component FROM merged WHERE r = 1",
)
def vector_upsert(spark, d):
    """The updates are merged into a stored table, of which only the touched buckets are read and written."""
    base, updates = _updates(spark, d)
    stored = BucketTable(spark, work_path(spark, "collection"), ["collection", "id"], buckets=16)
    stored.merge(base)
    stored.merge(updates, "seq")
    merged = stored.read()
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return merged.select("collection", "id", "note", first.alias("first_component"))


@query(
    "vector_append",
    f"""WITH {_UPDATES_SQL}, newest AS (SELECT collection, id, note FROM merged WHERE r = 1)
        SELECT m.collection, m.id, n.note, count(*) AS vectors FROM merged m JOIN newest n USING (collection, id)
        GROUP BY 1, 2, 3""",
)
def vector_append(spark, d):
    kept = vectors.upsert(*_updates(spark, d), mode="append")
    return kept.groupBy("collection", "id", "note").agg(F.count(F.lit(1)).alias("vectors"))


@query(
    "vector_delete",
    """SELECT lang AS collection, doc_id AS id FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def vector_delete(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1")
    base = inp.corpus(spark, d).select("collection", "id")
    gone = base.join(toxic.select(F.col("doc_id").alias("id")), "id", "left_semi").select("collection", "id")
    return vectors.delete(base, gone)


# ---- vector search -----------------------------------------------------------------------


@query("topk_cosine", f"WITH {BASE}, {inp.cosine_hits_sql('hits', 10)} SELECT query_id, id, score, rank FROM hits")
def topk_cosine(spark, d, k: int = 10):
    return hits(vectors.exact_topk(inp.questions(spark, d), flat(inp.corpus(spark, d)), k))


@query(
    "topk_grid",
    f"WITH {BASE}, {inp.cosine_hits_sql('hits', 10)} SELECT query_id, id, score, rank FROM hits",
)
def topk_grid(spark, d):
    """The plan of query sets that are too large to send to every task."""
    found = vectors.exact_topk(
        inp.questions(spark, d), flat(inp.corpus(spark, d)), 10, query_bound=16, vector_block=256
    )
    return hits(found)


@query(
    "topk_l2",
    f"""WITH {BASE}
        SELECT query_id, id, score, rank FROM (
          SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank
          FROM (SELECT query_id, c.id, round(pow(list_distance(
                  list_transform(q.embedding, lambda x: x / sqrt(list_dot_product(q.embedding, q.embedding))),
                  list_transform(c.embedding, lambda x: x / sqrt(list_dot_product(c.embedding, c.embedding)))), 2), 6) AS score
                FROM questions q, corpus c)) WHERE rank <= 10""",
)
def topk_l2(spark, d):
    return hits(vectors.exact_topk(inp.questions(spark, d), flat(inp.corpus(spark, d)), 10, metric="l2"))


_COLLECTION_SQL = "['en', 'de', 'fr', 'es', 'xx'][q.query_id % 5 + 1]"


@query(
    "topk_by_collection",
    f"""WITH {BASE}, {inp.cosine_hits_sql('hits', 5, f'c.collection = {_COLLECTION_SQL}')}
        SELECT query_id, id, score, rank FROM hits""",
)
def topk_by_collection(spark, d):
    names = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "xx")])
    q = inp.questions(spark, d).withColumn("collection", F.get(names, F.pmod("query_id", F.lit(5)).cast("int")))
    return hits(vectors.exact_topk(q, inp.corpus(spark, d), 5))


@query(
    "filtered_topk_pre",
    f"""WITH {BASE}, {inp.cosine_hits_sql('hits', 10, "c.source = 'src1' AND c.collection = 'en'")}
        SELECT query_id, id, score, rank FROM hits""",
)
def filtered_topk_pre(spark, d):
    v = inp.corpus(spark, d).withColumnRenamed("collection", "lang")
    return hits(vectors.exact_topk(inp.questions(spark, d), v, 10, filters={"source": "src1", "lang": "en"}))


@query(
    "filtered_topk_post",
    f"""WITH {BASE}, {inp.cosine_hits_sql('hits', 10)}
        SELECT h.query_id, h.id, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS rank
        FROM hits h JOIN corpus c ON c.id = h.id WHERE c.collection = 'en'""",
)
def filtered_topk_post(spark, d):
    v = inp.corpus(spark, d).withColumnRenamed("collection", "lang")
    return hits(
        vectors.exact_topk(inp.questions(spark, d), v, 10, filters={"lang": "en"}, filter_mode="post")
    )


_MIXED_SQL = """
shapes AS (
  SELECT query_id, CASE WHEN query_id % 3 = 0 THEN list_slice(embedding, 1, 8) WHEN query_id % 7 = 1 THEN list_slice(embedding, 1, 5)
         ELSE embedding END AS embedding FROM questions),
stored AS (SELECT id, CASE WHEN id % 2 = 0 THEN embedding ELSE list_slice(embedding, 1, 8) END AS embedding FROM corpus)"""


@query(
    "topk_mixed_dimensions",
    f"""WITH {BASE}, {_MIXED_SQL},
        found AS (SELECT q.query_id, v.id, round(CASE WHEN list_dot_product(v.embedding, v.embedding) = 0 THEN 0.0
                    ELSE list_cosine_similarity(q.embedding, v.embedding) END, 6) AS score
                  FROM shapes q JOIN stored v ON len(q.embedding) = len(v.embedding)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found)
        SELECT query_id, id, score, rank, NULL::BIGINT AS dimension, NULL::VARCHAR AS reason FROM ranked WHERE rank <= 5
        UNION ALL SELECT query_id, NULL, NULL, NULL, len(embedding), 'dimension' FROM shapes
        WHERE len(embedding) NOT IN (SELECT len(embedding) FROM stored)""",
)
def topk_mixed_dimensions(spark, d):
    """Queries and vectors of several dimensions: each meets its own, misfits are reported."""
    cut = lambda n: F.slice("embedding", 1, n)
    q = inp.questions(spark, d).withColumn(
        "embedding",
        F.when(F.col("query_id") % 3 == 0, cut(8)).when(F.col("query_id") % 7 == 1, cut(5)).otherwise(F.col("embedding")),
    )
    v = flat(inp.corpus(spark, d)).withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")).otherwise(cut(8)))
    return hits(vectors.exact_topk(q, v, 5)).unionByName(vectors.misfits(q, v), allowMissingColumns=True)


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Term vectors of all documents, made once for index, search and exact search."""
    path = work_path(spark, "term-vectors")
    inp.term_vectors(spark, d, "documents", "doc_id", "id").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "approximate_recall",
    """SELECT 10 * (SELECT count(*) FROM benchmark) AS expected, true AS reached FROM documents HAVING count(*) >= 10""",
)
def approximate_recall(spark, d):
    """Exact hits, and whether the approximate search finds at least nine tenths of them."""
    q, v = inp.term_vectors(spark, d, "benchmark", "item_id", "query_id"), stored_vectors(spark, d)
    hits, _ = approximate.approximate_topk(q, v, 10)
    found = vectors.recall(hits, vectors.exact_topk(q, v, 10))
    return found.select("expected", (F.col("recall") >= 0.9).alias("reached"))


@query("approximate_work")
def approximate_work(spark, d):
    """Pairs of question and document, those in probed lists, and those that were scored in full."""
    q, v = inp.term_vectors(spark, d, "benchmark", "item_id", "query_id"), stored_vectors(spark, d)
    _, counts = approximate.approximate_topk(q, v, 10)
    return counts.select(F.lit(q.count() * v.count()).alias("pairs"), "scanned", "scored")


@query(
    "neighbour_graph",
    """SELECT 5 * count(*) AS expected, true AS reached FROM documents WHERE doc_id % 20 = 0 HAVING (SELECT count(*) FROM documents) > 5""",
)
def neighbour_graph(spark, d):
    """The neighbour graph of all documents, against exact neighbours of those with an id divisible by 20."""
    v = stored_vectors(spark, d)
    links = approximate.neighbour_graph(v, 5, probes=16)
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    near = vectors.exact_topk(asked, v, 6).where(F.col("id") != F.col("query_id")).drop("rank")
    near = top_per_group(near, ["query_id"], [F.col("score").desc(), F.col("id").asc()], 5)
    found = vectors.recall(links.select(F.col("source").alias("query_id"), F.col("target").alias("id")), near)
    return found.select("expected", (F.col("recall") >= 0.95).alias("reached"))


@query(
    "hash_embed_stats",
    f"""SELECT count(*) AS texts, 64 AS min_dim, 64 AS max_dim, min(n) AS min_length, max(n) AS max_length
        FROM (SELECT CASE WHEN len(regexp_extract_all(lower(text), '{inp.WORDS}')) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS n FROM documents)""",
)
def hash_embed_stats(spark, d):
    embedded = vectors.hash_embed(docs(spark, d), "text")
    return embedded.agg(
        F.count(F.lit(1)).alias("texts"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.round(F.min(norm(F.col("embedding"))), 4).alias("min_length"),
        F.round(F.max(norm(F.col("embedding"))), 4).alias("max_length"),
    )


# ---- keyword search and fusion ---------------------------------------------------------------


def bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return keyword.search_documents(docs(spark, d), inp.questions(spark, d), k)


@query(
    "bm25_term_stats",
    f"""WITH {inp.bm25_stats_sql()}
        SELECT term, df, round(idf, 6) AS idf, n AS n_docs, round(avg_len, 6) AS avg_len FROM idfs, corpus_figures""",
)
def bm25_term_stats(spark, d):
    index = keyword.build_index(docs(spark, d))
    return index.terms.select(
        "term",
        "df",
        F.round("idf", 6).alias("idf"),
        index.corpus.select("n_docs").scalar().alias("n_docs"),
        F.round(index.corpus.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@query("bm25_topk", f"WITH {BASE}, {inp.bm25_hits_sql('hits', 10)} SELECT query_id, id, score, rank FROM hits")
def bm25_topk(spark, d):
    return hits(bm25(spark, d, 10))


def impact_index(spark: SparkSession, d: str) -> impacts.ImpactIndex:
    index = keyword.write_index(docs(spark, d), work_path(spark, "terms"))
    return impacts.write_impacts(index, work_path(spark, "impacts"))


@query("bm25_pruned", f"WITH {BASE}, {inp.bm25_hits_sql('hits', 10)} SELECT query_id, id, score, rank FROM hits")
def bm25_pruned(spark, d):
    return hits(impacts.search_impacts(impact_index(spark, d), inp.questions(spark, d), 10))


@query("bm25_pruned_work")
def bm25_pruned_work(spark, d):
    return impacts.search_work(impact_index(spark, d), inp.questions(spark, d), 10)


HYBRID_SQL = f"""{BASE}, {inp.cosine_hits_sql('semantic', 10)}, {inp.bm25_hits_sql('word_hits', 10)},
  {inp.rrf_sql('fused', 'semantic', 'word_hits', 5)}"""


def hybrid(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    q, v = inp.questions(spark, d), flat(inp.corpus(spark, d))
    return retrieval.retrieve(lambda n: vectors.exact_topk(q, v, n), lambda n: bm25(spark, d, n), k)


@query("hybrid_rrf", f"WITH {HYBRID_SQL} SELECT query_id, id, score, rank FROM fused")
def hybrid_rrf(spark, d):
    return hits(hybrid(spark, d))


@query(
    "semantic_fallback",
    f"WITH {BASE}, {inp.cosine_hits_sql('hits', 5)} SELECT query_id, id, score, rank FROM hits",
)
def semantic_fallback(spark, d):
    q, v = inp.questions(spark, d), flat(inp.corpus(spark, d))
    return hits(retrieval.retrieve(lambda n: vectors.exact_topk(q, v, n), None, 5))


def _with_texts(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Hits with text, source and file name of their documents."""
    texts = table(spark, d, "documents").select(
        "doc_id",
        F.col("text").alias("document"),
        "source",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filename"),
    )
    return retrieval.lookup(found, texts)


@query(
    "rerank_overlap",
    rf"""WITH {BASE}, {inp.cosine_hits_sql('hits', 50)},
        scored AS (
          SELECT h.query_id, h.id, h.rank AS first_rank, round(len(list_intersect(
                   list_distinct(regexp_extract_all(lower(q.text), '{inp.WORDS}')),
                   regexp_extract_all(lower(c.text), '{inp.WORDS}')))
                 / len(list_distinct(regexp_extract_all(lower(q.text), '{inp.WORDS}'))), 6) AS rerank_score
          FROM hits h JOIN questions q USING (query_id) JOIN corpus c ON c.id = h.id)
        SELECT query_id, id, rerank_score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS rank FROM scored)
        WHERE rank <= 5""",
)
def rerank_overlap(spark, d):
    found = topk_cosine(spark, d, retrieval.OVER_FETCH)
    asked = inp.questions(spark, d).select("query_id", F.col("text").alias("query"))
    ranked = retrieval.rerank(_with_texts(spark, d, found).join(asked, "query_id"), 5)
    return ranked.select("query_id", "id", "rerank_score", long_rank())


# ---- context and answers -----------------------------------------------------------------------

_FUSED_TEXTS_SQL = f"""{HYBRID_SQL},
texts AS (SELECT f.query_id, f.rank, f.score, d.text, d.source || '/' || d.doc_id::VARCHAR AS filename
          FROM fused f JOIN documents d ON d.doc_id = f.id)"""


def hybrid_texts(spark: SparkSession, d: str) -> DataFrame:
    return _with_texts(spark, d, hybrid(spark, d))


@query(
    "source_preview",
    f"""WITH {_FUSED_TEXTS_SQL}
        SELECT query_id, rank::INTEGER AS index, filename AS document, round(score, 3) AS relevance_score,
               CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text_preview FROM texts""",
)
def source_preview(spark, d):
    return context.source_rows(hybrid_texts(spark, d)).drop("page")


@query(
    "stream_sources",
    f"""WITH {_FUSED_TEXTS_SQL}
        SELECT query_id, rank::INTEGER AS index, filename AS document, score AS relevance_score,
               substr(text, 1, 200) || '...' AS text_preview FROM texts""",
)
def stream_sources(spark, d):
    return context.source_rows(hybrid_texts(spark, d), stream=True).drop("page")


@query(
    "context_pack",
    f"""WITH {_FUSED_TEXTS_SQL},
        totals AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM texts)
        SELECT query_id, count(*) FILTER (total <= 4000) AS sources_used,
               coalesce(max(total) FILTER (total <= 4000), 0) AS estimated_tokens,
               sha256(coalesce(string_agg('[Source ' || rank::VARCHAR || ': ' || filename || ']' || chr(10) || text || chr(10),
                 chr(10) || '---' || chr(10) ORDER BY rank) FILTER (total <= 4000), '')) AS context_hash
        FROM totals GROUP BY query_id""",
)
def context_pack(spark, d):
    packed = context.pack_context(hybrid_texts(spark, d))
    return packed.select("query_id", "sources_used", "estimated_tokens", digest(F.col("context")).alias("context_hash"))


@query(
    "context_rerank",
    f"""WITH {_FUSED_TEXTS_SQL},
        totals AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM texts)
        SELECT query_id, count(*) FILTER (total <= 4000) AS sources_used,
               coalesce(max(total) FILTER (total <= 4000), 0) AS estimated_tokens,
               sha256(coalesce(string_agg('[Source ' || rank::VARCHAR || ': ' || filename || ']' || chr(10) || text || chr(10),
                 chr(10) || '---' || chr(10) ORDER BY rank) FILTER (total <= 4000), '')) AS context_hash
        FROM totals GROUP BY query_id""",
)
def context_rerank(spark, d):
    packed = context.pack_context(hybrid_texts(spark, d), method="rerank")
    return packed.select("query_id", "sources_used", "estimated_tokens", digest(F.col("context")).alias("context_hash"))


@query(
    "stream_context",
    f"""WITH {_FUSED_TEXTS_SQL}
        SELECT query_id, sha256(string_agg('[Source ' || rank::VARCHAR || '] ' || text, chr(10) || chr(10) ORDER BY rank))
               AS context_hash FROM texts GROUP BY query_id""",
)
def stream_context(spark, d):
    built = context.stream_context(hybrid_texts(spark, d))
    return built.select("query_id", digest(F.col("context")).alias("context_hash"))


# answers: the first assistant turn of the conversation with the question's number
_ANSWERS_SQL = f"""{BASE}, {inp.cosine_hits_sql('hits', 5)},
answers AS (SELECT conv_id AS query_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1),
figures AS (SELECT query_id, arg_min(score, rank) AS top, avg((score > 0.7)::INT) AS high FROM hits GROUP BY 1),
responses AS (
  SELECT q.query_id, length(coalesce(a.answer, ''))::BIGINT AS answer_chars,
         round(CASE WHEN f.top IS NULL THEN 0 ELSE greatest(0, least(1, 0.5 * f.top + 0.3 * f.high
               + 0.2 * least(length(coalesce(a.answer, '')) / 200, 1))) END, 6) AS confidence
  FROM questions q LEFT JOIN answers a USING (query_id) LEFT JOIN figures f USING (query_id))"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    answers = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("answer"))
    asked = inp.questions(spark, d).select("query_id").join(answers, "query_id", "left")
    return context.confidence(asked, topk_cosine(spark, d, 5), decimals=6)


@query("confidence", f"WITH {_ANSWERS_SQL} SELECT query_id, confidence FROM responses")
def confidence(spark, d):
    return _responses(spark, d).select("query_id", "confidence")


@query(
    "batch_summary",
    f"""WITH {_ANSWERS_SQL}
        SELECT count(*) AS questions, round(avg(confidence), 6) AS mean_confidence,
               round(avg(answer_chars), 6) AS mean_latency_ms FROM responses""",
)
def batch_summary(spark, d):
    """Answer length stands for the latency, which the tables do not hold."""
    chars = F.length(F.coalesce("answer", F.lit(""))).cast("long")
    return retrieval.batch_summary(_responses(spark, d).withColumn("latency_ms", chars))


@query(
    "no_result",
    f"""WITH {BASE}, {inp.cosine_hits_sql('hits', 5, f'c.collection = {_COLLECTION_SQL}')},
        found AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1)
        SELECT query_id, coalesce(n, 0) AS results, CASE WHEN n IS NULL THEN {lit(NO_RESULT_TEXT)} ELSE 'answered' END AS answer
        FROM questions LEFT JOIN found USING (query_id)""",
)
def no_result(spark, d):
    counts = topk_by_collection(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = inp.questions(spark, d).select("query_id").join(counts, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("results"),
        context.answer_or_none(F.col("n").isNotNull(), F.lit("answered")).alias("answer"),
    )


# ---- feature ranking ------------------------------------------------------------------------------

_FEATURES_SQL = f"""{BASE}, {inp.cosine_hits_sql('hits', 10)}, {inp.bm25_hits_sql('word_hits', 10)},
views AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
raw AS (
  SELECT h.query_id, h.id, h.rank AS first_rank, h.score, max(h.score) OVER (PARTITION BY h.query_id) AS top,
         coalesce(w.score, 0) AS kw, length(c.text) AS len, o.o_orderdate AS made, coalesce(v.n, 0) AS views,
         len(list_filter(regexp_split_to_array(q.text, {lit(WS + '+')}), lambda x: x <> '')) AS words
  FROM hits h JOIN corpus c ON c.id = h.id JOIN questions q ON q.query_id = h.query_id
  LEFT JOIN word_hits w ON w.query_id = h.query_id AND w.id = h.id
  LEFT JOIN orders o ON o.o_orderkey = h.id LEFT JOIN views v ON v.user_id = h.id % 150),
days AS (
  SELECT *, floor((epoch_us(TIMESTAMP '{inp.AS_OF}') - epoch_us(made)) / 86400000000.0) AS age FROM raw),
features AS (
  SELECT query_id, id, first_rank,
    CASE WHEN top > 0 THEN score / top WHEN top = 0 THEN score ELSE 0 END AS semantic_score,
    greatest(0, least(1, kw)) AS keyword_score,
    CASE WHEN len > 0 THEN 1 / (1 + len / 1000.0) ELSE 0.5 END AS length_penalty,
    CASE WHEN made IS NULL THEN 0.5 WHEN age >= 0 THEN exp(-age / 90.0) ELSE 1 END AS freshness,
    greatest(0, least(1, views / 100.0)) AS popularity,
    CASE WHEN len > 0 THEN least(words / len, 1) ELSE 0 END AS ql_ratio
  FROM days)"""


def _ranking_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits with keyword score, text length, date of an order and views of a user."""
    views = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("view_count"))
    dates = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    )
    words = bm25(spark, d, 10).select("query_id", "id", F.col("score").alias("keyword_score"))
    asked = inp.questions(spark, d).select("query_id", F.col("text").alias("query"))
    return (
        _with_texts(spark, d, topk_cosine(spark, d, 10))
        .withColumn("doc_length", F.length("document"))
        .join(asked, "query_id")
        .join(words, ["query_id", "id"], "left")
        .join(dates, "id", "left")
        .withColumn("user_id", F.pmod("id", F.lit(150)))
        .join(views, "user_id", "left")
    )




@query(
    "rank_features",
    f"""WITH {_FEATURES_SQL}
        SELECT query_id, id, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in ranking.FEATURES)} FROM features""",
)
def rank_features(spark, d):
    f = ranking.features(_ranking_rows(spark, d), F.lit(inp.AS_OF))
    return f.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ranking.FEATURES])


@query(
    "rank_score",
    f"""WITH {_FEATURES_SQL}, scored AS (
          SELECT *, round(greatest(0, least(1, (0.4 * semantic_score + 0.3 * keyword_score + 0.1 * freshness
                 + 0.2 * popularity) * length_penalty)), 6) AS ranking_score FROM features)
        SELECT query_id, id, ranking_score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ranking_score DESC, first_rank) AS rank FROM scored)
        WHERE rank <= 5""",
)
def rank_score(spark, d):
    ranked = ranking.rank_results(_ranking_rows(spark, d), F.lit(inp.AS_OF), k=5)
    return ranked.select("query_id", "id", "ranking_score", long_rank())


@query(
    "rank_retrieved",
    f"""WITH {_FEATURES_SQL}, scored AS (
          SELECT *, round(greatest(0, least(1, (0.5 * semantic_score + 0.25 * keyword_score + 0.125 * freshness
                 + 0.125 * popularity) * length_penalty)), 6) AS s FROM features)
        SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first_rank) AS rank
        FROM scored""",
)
def rank_retrieved(spark, d):
    weights = ranking.Weights(4, 2, 1, 1).checked().normalized()
    return hits(ranking.rank_retrieved(_ranking_rows(spark, d), F.lit(inp.AS_OF), weights))


# ---- evaluation ---------------------------------------------------------------------------------------


@query(
    "retrieval_eval",
    """WITH pairs AS (
         SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS relevant,
                round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
         FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs),
       totals AS (SELECT query_id, count(*) FILTER (relevant) AS n FROM pairs GROUP BY 1),
       per AS (SELECT query_id, coalesce(max(1.0 / rank) FILTER (relevant AND rank <= 10), 0) AS rr,
                      coalesce(sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= 10), 0) AS dcg,
                      count(*) FILTER (relevant AND rank <= 20) AS found FROM ranked GROUP BY 1)
       SELECT count(*) AS queries, round(avg(rr), 6) AS mrr,
              round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg,
              round(avg(found / n), 6) AS recall
       FROM per JOIN totals USING (query_id) WHERE n > 0""",
)
def retrieval_eval(spark, d):
    v = inp.vector_table(spark, d)
    asked = v.select(F.col("id").alias("query_id"), "embedding")
    found = vectors.exact_topk(asked, v, 21).where("id != query_id").drop("rank")
    ranked = vectors.top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id").asc()], 20)
    labels = v.select("id", "label")
    marked = ranked.join(labels, "id").join(
        labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id"
    )
    sizes = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    totals = labels.join(sizes, "label").select(F.col("id").alias("query_id"), "n_relevant")
    return evaluation.evaluate(marked.withColumn("relevant", F.col("label") == F.col("wanted")), totals)


@query(
    "hash_embed_coverage",
    f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{inp.WORDS}')) > 0 AS has_vector FROM documents""",
)
def hash_embed_coverage(spark, d):
    """Texts without any token get the zero vector."""
    embedded = vectors.hash_embed(docs(spark, d), "text")
    return embedded.select("doc_id", (norm(F.col("embedding")) > 0).alias("has_vector"))
