"""Inputs that the queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.ranks import bucketed_row_number
from docweave.functions.text import SPACE_CHARS
from docweave.operators.requests import window_start
from docweave.operators.vectors import embed_with, term_counts_model
from docweave.plans.registry import lit
from docweave.sources.tables import dealt, spread, table

AS_OF = "1999-06-01 00:00:00"
SPACES_SQL = lit(SPACE_CHARS)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {SPACES_SQL})"


# ---- documents and vectors ------------------------------------------------------------


VECTOR_DIM = 64  # of the supplied vectors


def _with_vectors(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Supplied vectors by number; texts without one are embedded by their terms."""
    joined = texts.join(vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias("_given")), key, "left")
    open_ = joined.withColumn("_open", F.when(F.col("_given").isNull(), F.lower(F.coalesce("text", F.lit("")))))
    made = embed_with(open_, "_open", term_counts_model(VECTOR_DIM))
    return made.withColumn("embedding", F.coalesce("_given", "embedding")).drop("_given", "_open")


def term_vectors(spark: SparkSession, d: str, name: str, key: str, as_: str) -> DataFrame:
    """Texts of a table with the vectors of their terms, no supplied ones among them."""
    texts = spread(table(spark, d, name).select(F.col(key).alias(as_), F.lower(F.coalesce("text", F.lit(""))).alias("_text")), as_)
    return embed_with(texts, "_text", term_counts_model(VECTOR_DIM)).select(as_, "embedding")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a vector; the collection is the language."""
    docs = spread(table(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "id")
    return _with_vectors(docs, table(spark, d, "embeddings"), "id").select(
        "id",
        "text",
        F.col("lang").alias("collection"),
        "source",
        F.concat("source", F.lit("/"), F.col("id").cast("string")).alias("filename"),
        "embedding",
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark texts as queries, with the vector of the same number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _with_vectors(items, table(spark, d, "embeddings"), "query_id").select("query_id", "text", "embedding")


WORDS = r"[\p{L}\p{N}_]+"


def term_vectors_sql(name: str, rows: str, dim: int) -> str:
    """CTEs with the term count vectors of ``rows(id, text)``."""
    return f"""
{name}_counts AS MATERIALIZED (
  SELECT id, b, count(*) AS n FROM (
    SELECT id, ('0x' || substr(md5(term), 1, 7))::BIGINT % {dim} AS b
    FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM ({rows}))) GROUP BY 1, 2),
{name} AS MATERIALIZED (
  SELECT r.id, list(coalesce(n, 0)::DOUBLE ORDER BY s.b) AS embedding
  FROM (SELECT id FROM ({rows})) r CROSS JOIN (SELECT unnest(range({dim})) AS b) s
  LEFT JOIN {name}_counts c ON c.id = r.id AND c.b = s.b GROUP BY r.id)"""


def _open_sql(table_: str, key: str) -> str:
    return f"SELECT {key} AS id, text FROM {table_} WHERE {key} NOT IN (SELECT vec_id FROM embeddings)"


CORPUS_SQL = f"""
{term_vectors_sql("open_documents", _open_sql("documents", "doc_id"), VECTOR_DIM)},
{term_vectors_sql("open_questions", _open_sql("benchmark", "item_id"), VECTOR_DIM)},
corpus AS (
  SELECT d.doc_id AS id, d.text, d.lang AS collection, d.source,
         d.source || '/' || d.doc_id::VARCHAR AS filename, coalesce(e.embedding::DOUBLE[], o.embedding) AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN open_documents o ON o.id = d.doc_id),
questions AS (
  SELECT b.item_id AS query_id, b.text, coalesce(e.embedding::DOUBLE[], o.embedding) AS embedding
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id LEFT JOIN open_questions o ON o.id = b.item_id)"""


def cosine_hits_sql(name: str, k: int, cond: str = "true") -> str:
    """CTE with the best ``k`` documents per question."""
    return f"""
{name} AS (
  SELECT query_id, id, score, rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.query_id, c.id, round(list_cosine_similarity(q.embedding, c.embedding), 6) AS score
          FROM questions q, corpus c WHERE {cond}))
  WHERE rank <= {k})"""


def bm25_stats_sql(texts: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs with the statistics of all terms of ``texts(doc_id, text)``; each is computed once."""
    return f"""
toks AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS t FROM ({texts})),
corpus_figures AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM toks),
postings AS MATERIALIZED (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf
             FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw_idf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM dfs, corpus_figures),
mean_idf AS MATERIALIZED (SELECT avg(w) AS m FROM raw_idf),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN w < 0 THEN 0.25 * m ELSE w END AS idf FROM raw_idf, mean_idf)"""


def bm25_hits_sql(name: str, k: int, texts: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs of a BM25 search of all questions over all documents."""
    return f"""{bm25_stats_sql(texts)},
asked AS (SELECT query_id, term, count(*) AS qtf
          FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM questions) GROUP BY 1, 2),
keyword_scores AS (
  SELECT query_id, doc_id AS id,
         round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_len))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN idfs USING (term), corpus_figures GROUP BY 1, 2),
{name} AS (
  SELECT query_id, id, score, rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM keyword_scores WHERE score > 0) WHERE rank <= {k})"""


def rrf_sql(name: str, semantic: str, keyword: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, score, rank FROM (
    SELECT query_id, id, score, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, sr ASC NULLS LAST, kr ASC NULLS LAST) AS rank
    FROM (SELECT coalesce(s.query_id, w.query_id) AS query_id, coalesce(s.id, w.id) AS id, s.rank AS sr, w.rank AS kr,
                 round(coalesce(0.5 / (s.rank + 59), 0) + coalesce(0.5 / (w.rank + 59), 0), 9) AS score
          FROM {semantic} s FULL OUTER JOIN {keyword} w ON s.query_id = w.query_id AND s.id = w.id))
  WHERE rank <= {k})"""


# ---- Markdown rendered from line items ---------------------------------------------------


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown text per line item; rendered inside the row."""
    li = spread(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")

    def s(c: str) -> str:
        return f"cast({c} as string)"

    text = f"""concat(
      '# Order ', {s('l_orderkey')}, ' line ', {s('l_linenumber')}, '\\n',
      case when l_returnflag = 'A' then concat('As shown in Figure ', {s('l_linenumber')}, ' the bar grows.\\n')
           when l_returnflag = 'N' then concat('A pie chart of part ', {s('l_partkey')}, '\\n')
           else 'Nothing drawn here.\\n' end,
      '## Amounts\\n| measure | value | unit |\\n| --- | --- | --- |\\n',
      '| quantity | ', {s('cast(l_quantity as bigint)')}, ' | pieces |\\n',
      '| discount | ', {s('cast(round(l_discount * 100) as bigint)')}, ' | percent |\\n',
      case when l_returnflag = 'R' then '| returned |  | flag |\\n' else '' end,
      '\\n- [order ', {s('l_orderkey')}, '](http://shop.example/o/', {s('l_orderkey')}, ') and [part](http://shop.example/p/',
      {s('l_partkey')}, ')\\n  1. supplier ', {s('l_suppkey')}, '\\n```sql\\nselect ', {s('l_linenumber')}, '\\n```\\n## Notes',
      case when l_linestatus = 'F' then '\\nfinished\\n' else '' end)"""
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.expr(text).alias("text")
    )


# line numbers inside the text above
ITEMS_SQL = """
items AS (
  SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_orderkey::VARCHAR AS ok, l_linenumber::VARCHAR AS ln,
         l_partkey::VARCHAR AS pk, l_suppkey::VARCHAR AS sk, l_returnflag AS rf, l_linestatus AS ls,
         l_quantity::BIGINT::VARCHAR AS qty, round(l_discount * 100)::BIGINT::VARCHAR AS disc,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS extra
  FROM lineitem)"""


# ---- versions, tenants, requests ----------------------------------------------------------


def version_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of the document of their user."""
    ev = table(spark, d, "events")
    log = bucketed_row_number(ev, ["user_id"], window_start("ts", 3600), ["ts", "event_id"], "version_number")
    return log.select(
        F.col("user_id").alias("document_id"),
        "version_number",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"),
        F.col("event_type").alias("created_by"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("change_summary"),
        F.concat("event_type", F.lit(":"), F.round(F.col("value") * 100).cast("long").cast("string")).alias("content"),
        F.create_map(F.lit("type"), "event_type", F.lit("props"), "props").alias("metadata"),
    )


VERSIONS_SQL = """
versions AS (
  SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number,
         floor(epoch(ts))::BIGINT AS created_at, event_type AS created_by, 'event ' || event_id::VARCHAR AS change_summary,
         event_type || ':' || round(value * 100)::BIGINT::VARCHAR AS content, event_type AS m_type, props AS m_props
  FROM events),
current AS (SELECT document_id, max(version_number) AS current_version FROM versions GROUP BY 1)"""


def tenants(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tenants."""
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("active", "suspended", "pending", "archived")]),
        F.pmod("n_nationkey", F.lit(4)) + 1,
    )
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"), status.alias("status"),
        F.col("n_regionkey").alias("created_at"),
    )


TENANTS_SQL = """
tenants AS (SELECT n_nationkey AS tenant_id, n_name AS name,
                   ['active', 'suspended', 'pending', 'archived'][n_nationkey % 4 + 1] AS status FROM nation)"""


def answered(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that directly follows them, if one does."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answers, ["conv_id", "turn"], "left")


ANSWERED_SQL = """
answered AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM (SELECT * FROM conversations WHERE role = 'user') u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')"""


# ---- graphs ----------------------------------------------------------------------------------


def trade_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts refer to suppliers; suppliers, nations and regions form a hierarchy."""
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    na, pa, re = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "region")

    def key(prefix: str, c: str):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    def link(df: DataFrame, a, b, kind: str, weight) -> DataFrame:
        return df.select(
            a.alias("source_doc"), b.alias("target_doc"), F.lit(kind).alias("relationship_type"), weight.alias("weight")
        )

    sold = dealt(li, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    edges = (
        link(sold, key("P", "l_partkey"), key("S", "l_suppkey"), "reference", F.col("w"))
        .union(link(su, key("S", "s_suppkey"), key("N", "s_nationkey"), "hierarchy", F.lit(1.0)))
        .union(link(na, key("N", "n_nationkey"), key("R", "n_regionkey"), "hierarchy", F.lit(1.0)))
    )
    nodes = (
        pa.select(key("P", "p_partkey").alias("doc_id"))
        .union(su.select(key("S", "s_suppkey")))
        .union(na.select(key("N", "n_nationkey")))
        .union(re.select(key("R", "r_regionkey")))
    )
    return nodes, edges


TRADE_SQL = """
edges AS (
  SELECT 'P' || l_partkey::VARCHAR AS source_doc, 'S' || l_suppkey::VARCHAR AS target_doc,
         'reference' AS relationship_type, count(*)::DOUBLE AS weight FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'S' || s_suppkey::VARCHAR, 'N' || s_nationkey::VARCHAR, 'hierarchy', 1.0 FROM supplier
  UNION ALL SELECT 'N' || n_nationkey::VARCHAR, 'R' || n_regionkey::VARCHAR, 'hierarchy', 1.0 FROM nation),
nodes AS (
  SELECT 'P' || p_partkey::VARCHAR AS doc_id FROM part UNION ALL SELECT 'S' || s_suppkey::VARCHAR FROM supplier
  UNION ALL SELECT 'N' || n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'R' || r_regionkey::VARCHAR FROM region)"""


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


SIMILAR_SQL = """
similar_pairs AS (
  SELECT a.vec_id AS source_doc, b.vec_id AS target_doc,
         round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS weight
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
similar_edges AS (
  SELECT source_doc, target_doc, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY weight DESC, target_doc) AS r
    FROM similar_pairs WHERE weight >= 0.3) WHERE r <= 5)"""
SIMILAR_K, SIMILAR_MIN = 5, 0.3
