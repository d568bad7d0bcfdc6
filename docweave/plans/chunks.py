"""Search over chunks: documents are split, embedded, merged into a stored collection, indexed and retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import chunking, context, keyword, retrieval, vectors
from docweave.plans import inputs as inp
from docweave.plans.documents import CHUNKS_SQL, digest, docs
from docweave.plans.registry import query
from docweave.plans.retrieval import hits
from docweave.session import work_path
from docweave.sources import store
from docweave.sources.tables import table

DIM = 32
_EMPTY = "collection string, id string, embedding array<float>, content string, source string"


def _embedded(rows: DataFrame, text: str) -> DataFrame:
    lowered = rows.withColumn("_lower", F.lower(text))
    return vectors.embed_with(lowered, "_lower", vectors.term_counts_model(DIM)).drop("_lower")


def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all documents with their vectors, merged by chunk id and stored as one collection."""
    rows = chunking.chunk_documents(docs(spark, d), "text")
    made = _embedded(rows, "content").select(
        F.lit("default").alias("collection"), F.col("chunk_id").alias("id"), "embedding", "content", "source", F.lit(0).alias("seq")
    )
    path = work_path(spark, "chunk-store")
    store.save_vectors(vectors.upsert(spark.createDataFrame([], _EMPTY), made), path)
    return store.load_vectors(spark, path)


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text as a question, embedded like the chunks."""
    return _embedded(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")


_CHUNK_TEXTS = "SELECT id, text FROM chunk_texts"
BASE = f"""{CHUNKS_SQL},
chunk_texts AS MATERIALIZED (
  SELECT source || '_' || substr(sha256(chunks[i]), 1, 16) AS id, any_value(chunks[i]) AS text, any_value(source) AS source
  FROM (SELECT source, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM chunked) GROUP BY 1),
questions AS (SELECT item_id AS query_id, text FROM benchmark),
{inp.term_vectors_sql('chunk_vectors', _CHUNK_TEXTS, DIM)},
{inp.term_vectors_sql('question_vectors', 'SELECT item_id AS id, text FROM benchmark', DIM)}"""


def _semantic_sql(k: int) -> str:
    return f"""
semantic AS MATERIALIZED (
  SELECT query_id, id, score, rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.id AS query_id, c.id, round(CASE WHEN list_sum(c.embedding) * list_sum(q.embedding) = 0 THEN 0.0
            ELSE list_cosine_similarity(q.embedding, c.embedding) END, 6) AS score
          FROM question_vectors q, chunk_vectors c)) WHERE rank <= {k})"""


@query("chunk_topk", f"WITH {BASE}, {_semantic_sql(10)} SELECT query_id, id, score, rank FROM semantic")
def chunk_topk(spark, d):
    return hits(vectors.exact_topk(all_questions(spark, d), chunk_store(spark, d), 10))


def _hybrid(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Rank fusion of the vector search and the stored term index of the same chunks."""
    asked = all_questions(spark, d)
    index = keyword.write_index(chunks, work_path(spark, "chunk-index"), "id", "content")
    return retrieval.retrieve(
        lambda n: vectors.exact_topk(asked, chunks, n), lambda n: keyword.search_index(index, asked, n), 5
    )


_HYBRID_SQL = f"""{BASE}, {_semantic_sql(10)},
  {inp.bm25_hits_sql('word_hits', 10, 'SELECT id AS doc_id, text FROM chunk_texts')},
  {inp.rrf_sql('fused', 'semantic', 'word_hits', 5)}"""


@query("chunk_hybrid", f"WITH {_HYBRID_SQL} SELECT query_id, id, score, rank FROM fused")
def chunk_hybrid(spark, d):
    return hits(_hybrid(spark, d, chunk_store(spark, d)))


@query(
    "chunk_context",
    f"""WITH {_HYBRID_SQL},
        texts AS (SELECT f.query_id, f.rank, c.text, c.source FROM fused f JOIN chunk_texts c ON c.id = f.id),
        totals AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM texts)
        SELECT query_id, count(*) FILTER (total <= 4000) AS sources_used,
               coalesce(max(total) FILTER (total <= 4000), 0) AS estimated_tokens,
               sha256(coalesce(string_agg('[Source ' || rank::VARCHAR || ': ' || source || ']' || chr(10) || text || chr(10),
                 chr(10) || '---' || chr(10) ORDER BY rank) FILTER (total <= 4000), '')) AS context_hash
        FROM totals GROUP BY query_id""",
)
def chunk_context(spark, d):
    chunks = chunk_store(spark, d)
    texts = chunks.select("id", F.col("content").alias("document"), F.col("source").alias("filename"))
    packed = context.pack_context(_hybrid(spark, d, chunks).join(texts, "id"))
    return packed.select("query_id", "sources_used", "estimated_tokens", digest(F.col("context")).alias("context_hash"))
