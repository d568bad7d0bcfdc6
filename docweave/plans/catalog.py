"""Queries on collections, tenants, versions and graphs (A, G, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import chunking, graph, ingest, tenants, vectors, versions
from docweave.plans import inputs as inp
from docweave.plans.documents import CHUNKS_SQL, docs
from docweave.plans.registry import query
from docweave.session import work_path
from docweave.sources import store
from docweave.sources.tables import table

# ---- collections -------------------------------------------------------------------------


@query(
    "collection_stats",
    f"""WITH {inp.CORPUS_SQL}
        SELECT coalesce(collection, '(all)') AS collection, count(*) AS total_vectors, count(DISTINCT id) AS documents,
               max(len(embedding))::BIGINT AS dimension FROM corpus GROUP BY ROLLUP (collection)""",
)
def collection_stats(spark, d):
    return vectors.collection_stats(inp.corpus(spark, d))


@query(
    "index_size",
    f"""WITH {inp.CORPUS_SQL}
        SELECT collection, count(*) AS vectors, max(len(embedding))::BIGINT AS dimension,
               floor(count(*) * max(len(embedding)) * 4 * 1.1::DOUBLE)::BIGINT AS estimated_bytes FROM corpus GROUP BY 1""",
)
def index_size(spark, d):
    return vectors.index_size(inp.corpus(spark, d))


@query(
    "corpus_stats",
    f"""WITH {CHUNKS_SQL}
        SELECT count(*) AS total_documents, sum(len(chunks))::BIGINT AS total_chunks,
               (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS collections FROM chunked""",
)
def corpus_stats(spark, d):
    rows = docs(spark, d).withColumn("collection", F.col("lang"))
    return ingest.corpus_stats(rows, F.size(chunking.split_text(F.col("text"))))


# a batch with rows that fail: texts in an unlisted language have no content
def _batch(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") != "es", F.col("text")).alias("content")
    )
    return ingest.ingest_errors(rows)


@query(
    "ingest_report",
    f"""WITH {CHUNKS_SQL}
        SELECT count(*) AS total, count(*) FILTER (lang <> 'es') AS success, count(*) FILTER (lang = 'es') AS failed,
               sum(CASE WHEN lang <> 'es' THEN len(chunks) ELSE 0 END)::BIGINT AS chunks_created
        FROM chunked JOIN documents USING (doc_id)""",
)
def ingest_report(spark, d):
    totals, _errors = ingest.ingest_report(_batch(spark, d), F.size(chunking.split_text(F.col("content"))))
    return totals


@query(
    "ingest_errors",
    "SELECT doc_id::VARCHAR AS doc_id, 'missing content' AS error FROM documents WHERE lang = 'es'",
)
def ingest_errors(spark, d):
    _totals, errors = ingest.ingest_report(_batch(spark, d), F.lit(0))
    return errors


# ---- tenants -------------------------------------------------------------------------------


@query(
    "tenant_counts",
    f"WITH {inp.TENANTS_SQL} SELECT coalesce(status, '(all)') AS status, count(*) AS tenants FROM tenants GROUP BY ROLLUP (status)",
)
def tenant_counts(spark, d):
    return tenants.tenant_counts(inp.tenants(spark, d))


@query(
    "tenant_list",
    f"""WITH {inp.TENANTS_SQL}
        SELECT t.tenant_id, t.name FROM tenants t JOIN nation ON n_nationkey = t.tenant_id WHERE t.status = 'active'
        ORDER BY n_regionkey, t.tenant_id LIMIT 5""",
)
def tenant_list(spark, d):
    return tenants.list_tenants(inp.tenants(spark, d), "active", 5).select("tenant_id", "name")


@query(
    "tenant_scope",
    f"""WITH {inp.TENANTS_SQL}
        SELECT tenant_id, count(*) AS rows, round(sum(c_acctbal), 2) AS balance
        FROM customer JOIN tenants ON tenant_id = c_nationkey WHERE status = 'active' GROUP BY 1""",
)
def tenant_scope(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_nationkey", "tenant_id")
    seen = tenants.visible_rows(rows, inp.tenants(spark, d))
    return seen.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "tenant_violations",
    """SELECT c_nationkey AS context_tenant, s_nationkey AS target_tenant, count(*) AS accesses
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
)
def tenant_violations(spark, d):
    """Customers' tenants that touch goods of suppliers of other tenants."""
    li, od = table(spark, d, "lineitem"), table(spark, d, "orders")
    cu, su = table(spark, d, "customer"), table(spark, d, "supplier")
    accesses = (
        li.select("l_orderkey", "l_suppkey")
        .join(od.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cu.select("c_custkey", F.col("c_nationkey").alias("context_tenant")), F.col("o_custkey") == F.col("c_custkey"))
        .join(su.select("s_suppkey", F.col("s_nationkey").alias("target_tenant")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return tenants.violations(accesses).groupBy("context_tenant", "target_tenant").agg(F.count(F.lit(1)).alias("accesses"))


# ---- versions ------------------------------------------------------------------------------


@query(
    "version_create",
    f"""WITH {inp.VERSIONS_SQL},
        asked AS (SELECT c_custkey AS document_id, c_name AS content, 1 AS seq FROM customer
                  UNION ALL SELECT c_custkey, c_mktsegment, 2 FROM customer WHERE c_custkey % 4 = 0),
        judged AS (SELECT a.*, e.document_id IS NULL AND seq = 1 AS ok FROM asked a
                   LEFT JOIN (SELECT DISTINCT document_id FROM versions) e USING (document_id))
        SELECT document_id, CASE WHEN ok THEN 'created' ELSE 'conflict' END AS status, CASE WHEN ok THEN 1::BIGINT END AS version_number,
               CASE WHEN ok THEN sha256(content) END AS content_hash,
               CASE WHEN ok THEN octet_length(encode(content))::BIGINT END AS file_size_bytes FROM judged""",
)
def version_create(spark, d):
    """Every fourth document is asked for twice in one batch."""
    cu = table(spark, d, "customer").withColumn("document_id", F.col("c_custkey"))
    requests = cu.select("document_id", F.col("c_name").alias("content"), F.lit(1).alias("seq")).union(
        cu.where("c_custkey % 4 = 0").select("document_id", "c_mktsegment", F.lit(2))
    )
    made, conflicts = versions.create(inp.version_log(spark, d), requests, sequence="seq")
    out = ["document_id", "status", "version_number", "content_hash", "file_size_bytes"]
    return made.withColumn("status", F.lit("created")).select(out).unionByName(
        conflicts.select("document_id", F.lit("conflict").alias("status")), allowMissingColumns=True
    )


@query(
    "version_update",
    f"""WITH {inp.VERSIONS_SQL},
        newest AS (SELECT v.* FROM versions v JOIN current c ON v.document_id = c.document_id
                   AND v.version_number = c.current_version),
        asked AS (SELECT c_custkey AS document_id, c_name AS content1, c_phone AS content2, c_mktsegment AS seg,
                         CASE WHEN c_acctbal > 0 THEN 60 END AS e1, CASE WHEN c_custkey % 3 > 0 THEN 60 END AS e2
                  FROM (SELECT *, 'again ' || c_name AS c_phone FROM customer)),
        one AS (SELECT a.*, n.version_number AS cur, n.m_type, n.m_props,
                       n.document_id IS NOT NULL AND coalesce(a.e1 = n.version_number, true) AS ok1
                FROM asked a LEFT JOIN newest n USING (document_id)),
        two AS (SELECT *, CASE WHEN ok1 THEN cur + 1 ELSE cur END AS cur2 FROM one),
        three AS (SELECT *, cur2 IS NOT NULL AND coalesce(e2 = cur2, true) AS ok2 FROM two)
        SELECT document_id, 1 AS seq, CASE WHEN cur IS NULL THEN 'not_found' WHEN ok1 THEN 'updated' ELSE 'conflict' END AS status,
               CASE WHEN ok1 THEN cur + 1 END AS version_number, CASE WHEN ok1 THEN sha256(content1) END AS content_hash,
               CASE WHEN ok1 THEN 'props=' || m_props || ';segment=' || seg || ';type=reviewed' END AS metadata FROM three
        UNION ALL
        SELECT document_id, 2, CASE WHEN cur IS NULL THEN 'not_found' WHEN ok2 THEN 'updated' ELSE 'conflict' END,
               CASE WHEN ok2 THEN cur2 + 1 END, CASE WHEN ok2 THEN sha256(content2) END,
               CASE WHEN ok2 THEN 'props=again' || CASE WHEN ok1 THEN ';segment=' || seg || ';type=reviewed' ELSE ';type=' || m_type END END
        FROM three""",
)
def version_update(spark, d):
    """Two requests per document, of which the second sees what the first one left."""
    cu = table(spark, d, "customer").withColumn("document_id", F.col("c_custkey"))
    first = cu.select(
        "document_id",
        F.lit(1).alias("seq"),
        F.col("c_name").alias("content"),
        F.create_map(F.lit("type"), F.lit("reviewed"), F.lit("segment"), F.col("c_mktsegment")).alias("metadata"),
        F.when(F.col("c_acctbal") > 0, F.lit(60)).alias("expected_version"),
    )
    second = cu.select(
        "document_id",
        F.lit(2),
        F.concat(F.lit("again "), "c_name"),
        F.create_map(F.lit("props"), F.lit("again")),
        F.when(F.col("c_custkey") % 3 > 0, F.lit(60)),
    )
    out = versions.update(inp.version_log(spark, d), first.union(second), sequence="seq")
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )
    return out.select("document_id", "seq", "status", "version_number", "content_hash", shown.alias("metadata"))


@query(
    "version_rollback",
    f"""WITH {inp.VERSIONS_SQL},
        asked AS (SELECT c_custkey AS document_id, (c_nationkey - 1)::BIGINT AS target, 1 AS seq FROM customer
                  UNION ALL SELECT c_custkey, 1, 2 FROM customer),
        joined AS (SELECT a.*, t.content, t.document_id IS NOT NULL AS ok, c.current_version FROM asked a LEFT JOIN current c USING (document_id)
                   LEFT JOIN versions t ON t.document_id = a.document_id AND t.version_number = a.target)
        SELECT document_id, seq, target AS target_version, CASE WHEN ok THEN 'rolled_back' ELSE 'not_found' END AS status,
               CASE WHEN ok THEN current_version + sum(ok::INT) OVER (PARTITION BY document_id ORDER BY seq)::BIGINT END AS version_number,
               CASE WHEN ok THEN 'Rolled back to version ' || target::VARCHAR END AS change_summary, sha256(content) AS content_hash
        FROM joined""",
)
def version_rollback(spark, d):
    """Two requests per document; accepted ones get numbers of their own."""
    cu = table(spark, d, "customer").withColumn("document_id", F.col("c_custkey"))
    requests = cu.select(
        "document_id", (F.col("c_nationkey") - 1).cast("long").alias("target_version"), F.lit(1).alias("seq")
    ).union(cu.select("document_id", F.lit(1).cast("long"), F.lit(2)))
    requests = requests.withColumn("change_summary", F.lit(None).cast("string"))
    out = versions.rollback(inp.version_log(spark, d), requests, sequence="seq")
    return out.select("document_id", "seq", "target_version", "status", "version_number", "change_summary", "content_hash")


@query(
    "version_history",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT v.document_id, c.current_version, (SELECT count(*) FROM versions x WHERE x.document_id = v.document_id)
               AS total_versions, v.version_number, v.created_at, v.created_by, v.change_summary,
               sha256(v.content) AS content_hash, octet_length(encode(v.content))::BIGINT AS file_size_bytes
        FROM versions v JOIN current c ON c.document_id = v.document_id""",
)
def version_history(spark, d):
    return versions.history(inp.version_log(spark, d)).drop("metadata")


@query(
    "version_get",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT document_id, version_number, content, sha256(content) AS content_hash FROM versions v
        WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = v.document_id AND c_nationkey = v.version_number)""",
)
def version_get(spark, d):
    wanted = table(spark, d, "customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("version_number")
    )
    found = versions.get_version(inp.version_log(spark, d), wanted)
    return found.select("document_id", "version_number", "content", "content_hash")


@query(
    "version_compare",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT a.document_id, a.version_number AS version1, b.version_number AS version2,
               sha256(a.content) = sha256(b.content) AS content_same,
               (octet_length(encode(b.content)) - octet_length(encode(a.content)))::BIGINT AS size_difference_bytes,
               a.created_by AS created_by1, b.created_by AS created_by2
        FROM versions a JOIN versions b ON a.document_id = b.document_id AND b.version_number = a.version_number + 1""",
)
def version_compare(spark, d):
    """Every version against the next one."""
    log = inp.version_log(spark, d)
    pairs = log.select(
        "document_id", F.col("version_number").alias("version1"), (F.col("version_number") + 1).alias("version2")
    )
    return versions.compare(log, pairs)


@query(
    "version_delete",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT document_id, count(*) AS versions FROM versions
        WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1""",
)
def version_delete(spark, d):
    gone = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    left = versions.delete_documents(inp.version_log(spark, d), gone)
    return left.groupBy("document_id").agg(F.count(F.lit(1)).alias("versions"))


@query(
    "version_latest",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT v.document_id, v.version_number, v.content, v.created_by FROM versions v
        JOIN current c ON c.document_id = v.document_id AND c.current_version = v.version_number""",
)
def version_latest(spark, d):
    return versions.latest(inp.version_log(spark, d)).select("document_id", "version_number", "content", "created_by")


@query(
    "version_stats",
    f"""WITH {inp.VERSIONS_SQL}
        SELECT count(DISTINCT document_id) AS total_documents, count(*) AS total_versions,
               sum(octet_length(encode(content)))::BIGINT AS total_storage_bytes,
               round(sum(octet_length(encode(content))) / 1048576.0::DOUBLE, 6) AS total_storage_mb,
               count(DISTINCT created_by) AS unique_contributors,
               round(count(*)::DOUBLE / count(DISTINCT document_id), 6) AS average_versions_per_document FROM versions""",
)
def version_stats(spark, d):
    return versions.stats(inp.version_log(spark, d))


# ---- graphs ----------------------------------------------------------------------------------


@query("edge_check", f"WITH {inp.TRADE_SQL} SELECT relationship_type, count(*) AS edges FROM edges GROUP BY 1")
def edge_check(spark, d):
    _nodes, edges = inp.trade_graph(spark, d)
    known, _other = graph.checked_edges(edges)
    return known.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("edges"))


def similar(spark: SparkSession, d: str) -> DataFrame:
    return graph.similarity_edges(inp.vector_table(spark, d), inp.SIMILAR_K, inp.SIMILAR_MIN)


@query(
    "similarity_edges",
    f"WITH {inp.SIMILAR_SQL} SELECT source_doc, target_doc, 'similarity' AS relationship_type, weight FROM similar_edges",
)
def similarity_edges(spark, d):
    return similar(spark, d)


@query(
    "related_docs",
    f"""WITH {inp.TRADE_SQL}, sides AS (
          SELECT source_doc AS doc_id, target_doc AS related_doc, relationship_type, weight FROM edges
          UNION ALL SELECT target_doc, source_doc, relationship_type, weight FROM edges),
        best AS (SELECT doc_id, related_doc, relationship_type, max(weight) AS weight FROM sides
                 WHERE weight >= 1 AND doc_id IN (SELECT 'S' || s_suppkey::VARCHAR FROM supplier) GROUP BY 1, 2, 3)
        SELECT doc_id, related_doc, relationship_type, weight, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, related_doc, relationship_type) AS rank
          FROM best) WHERE rank <= 10""",
)
def related_docs(spark, d):
    _nodes, edges = inp.trade_graph(spark, d)
    asked = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("doc_id"))
    return graph.related(edges, asked, min_weight=1.0).withColumn("rank", F.col("rank").cast("long"))


_HOPS = 16  # levels written out in the SQL; the search itself has no limit


def _paths_sql() -> str:
    """Breadth-first levels written out; a node keeps the smallest shortest path."""
    ctes = [
        inp.SIMILAR_SQL.strip(),
        "links AS (SELECT source_doc AS s, target_doc AS t FROM similar_edges UNION SELECT target_doc, source_doc FROM similar_edges)",
        "pairs AS (SELECT item_id AS pair_id, item_id AS source_doc, item_id * 7 + 100 AS target_doc FROM benchmark)",
        "v0 AS MATERIALIZED (SELECT pair_id, source_doc AS node, [source_doc] AS path FROM pairs)",
    ]
    for n in range(1, _HOPS + 1):
        ctes.append(
            f"""v{n} AS MATERIALIZED (
              SELECT * FROM v{n - 1} UNION ALL
              SELECT f.pair_id, t, min(list_append(f.path, t)) FROM v{n - 1} f JOIN links ON s = f.node
              WHERE len(f.path) = {n} AND NOT EXISTS (
                SELECT 1 FROM v{n - 1} o WHERE o.pair_id = f.pair_id AND o.node = t)
              GROUP BY f.pair_id, t)"""
        )
    return f"""WITH {', '.join(ctes)}
      SELECT p.pair_id, p.source_doc, p.target_doc, (len(v.path) - 1)::BIGINT AS hops,
             array_to_string(v.path, '>') AS path
      FROM pairs p LEFT JOIN v{_HOPS} v ON v.pair_id = p.pair_id AND v.node = p.target_doc"""


@query("shortest_path", _paths_sql())
def shortest_path(spark, d):
    pairs = table(spark, d, "benchmark").select(
        F.col("item_id").alias("pair_id"),
        F.col("item_id").alias("source_doc"),
        (F.col("item_id") * 7 + 100).alias("target_doc"),
    )
    found = graph.shortest_paths(similar(spark, d), pairs)
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "shortest_path_chain",
    """SELECT f.c_custkey AS pair_id, f.c_custkey AS source_doc, f.c_custkey + 19 AS target_doc,
              CASE WHEN l.c_custkey IS NOT NULL THEN 19::BIGINT END AS hops,
              CASE WHEN l.c_custkey IS NOT NULL THEN array_to_string(range(f.c_custkey, f.c_custkey + 20), '>') END AS path
       FROM customer f LEFT JOIN customer l ON l.c_custkey = f.c_custkey + 19 WHERE f.c_custkey % 20 = 0""",
)
def shortest_path_chain(spark, d):
    """Customers in chains of twenty: paths longer than any fixed number of rounds would find."""
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    ends = cu.select(F.col("k").alias("source_doc"), (F.col("k") + 1).alias("target_doc")).where("source_doc % 20 != 19")
    edges = ends.join(cu, F.col("target_doc") == F.col("k"), "left_semi")
    pairs = cu.where("k % 20 = 0").select(
        F.col("k").alias("pair_id"), F.col("k").alias("source_doc"), (F.col("k") + 19).alias("target_doc")
    )
    found = graph.shortest_paths(edges, pairs)
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "graph_export",
    f"""WITH {inp.TRADE_SQL}
        SELECT 'node' AS kind, doc_id AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS relationship_type, NULL::DOUBLE AS weight FROM nodes
        UNION ALL SELECT 'edge', source_doc, target_doc, relationship_type, weight FROM edges""",
)
def graph_export(spark, d):
    """Nodes and edges written to the shared folder and read back."""
    path = work_path(spark, "graph")
    store.export_graph(*inp.trade_graph(spark, d), path)
    nodes = spark.read.json(f"{path}/nodes", schema="doc_id string").select(F.lit("node").alias("kind"), F.col("doc_id").alias("a"))
    edges = spark.read.json(f"{path}/edges", schema="source_doc string, target_doc string, relationship_type string, weight double")
    edges = edges.select(F.lit("edge").alias("kind"), F.col("source_doc").alias("a"), F.col("target_doc").alias("b"), "relationship_type", "weight")
    return edges.unionByName(nodes, allowMissingColumns=True)


@query(
    "graph_clusters",
    f"""WITH RECURSIVE {inp.SIMILAR_SQL.strip()},
        links AS (SELECT source_doc AS s, target_doc AS t FROM similar_edges UNION SELECT target_doc, source_doc FROM similar_edges),
        reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT t, root FROM reach JOIN links ON s = node),
        labels AS (SELECT node AS doc_id, min(root) AS cluster FROM reach GROUP BY node)
        SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM labels QUALIFY size >= 3""",
)
def graph_clusters(spark, d):
    nodes = inp.vector_table(spark, d).select(F.col("id").alias("doc_id"))
    return graph.clusters(nodes, similar(spark, d))


def _communities_sql(rounds: int) -> str:
    ctes = [
        inp.SIMILAR_SQL.strip(),
        "links AS (SELECT source_doc AS s, target_doc AS t FROM similar_edges UNION SELECT target_doc, source_doc FROM similar_edges)",
        "l0 AS MATERIALIZED (SELECT vec_id AS node, vec_id AS label FROM embeddings)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(
            f"""l{i} AS MATERIALIZED (
              SELECT l.node, coalesce(v.label, l.label) AS label FROM l{i - 1} l LEFT JOIN (
                SELECT t, label FROM links JOIN l{i - 1} ON s = node GROUP BY t, label
                QUALIFY row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, label) = 1) v ON v.t = l.node)"""
        )
    return f"WITH {', '.join(ctes)} SELECT node AS doc_id, label AS cluster FROM l{rounds}"


@query("graph_communities", _communities_sql(4))
def graph_communities(spark, d):
    nodes = inp.vector_table(spark, d).select(F.col("id").alias("doc_id"))
    return graph.label_propagation(nodes, similar(spark, d), rounds=4)


@query(
    "degree_centrality",
    f"""WITH {inp.TRADE_SQL}, pairs AS (SELECT DISTINCT source_doc, target_doc FROM edges),
        o AS (SELECT source_doc AS doc_id, count(*) AS n FROM pairs GROUP BY 1),
        i AS (SELECT target_doc AS doc_id, count(*) AS n FROM pairs GROUP BY 1)
        SELECT doc_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree,
               round((coalesce(o.n, 0) + coalesce(i.n, 0)) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality
        FROM nodes LEFT JOIN o USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def degree_centrality(spark, d):
    return graph.degree_centrality(*inp.trade_graph(spark, d))


_ROUNDS = 10


def _pagerank_sql() -> str:
    ctes = [
        inp.TRADE_SQL.strip(),
        "pairs AS (SELECT source_doc AS s, target_doc AS t, sum(weight) AS w FROM edges GROUP BY 1, 2)",
        "shares AS MATERIALIZED (SELECT s, t, w / sum(w) OVER (PARTITION BY s) AS share FROM pairs)",
        "size AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "r0 AS MATERIALIZED (SELECT doc_id, 1 / n AS rank FROM nodes, size)",
    ]
    for i in range(1, _ROUNDS + 1):
        ctes.append(
            f"""r{i} AS MATERIALIZED (
              SELECT r.doc_id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + lost.v / n) AS rank
              FROM r{i - 1} r CROSS JOIN size
              CROSS JOIN (SELECT coalesce(sum(rank), 0) AS v FROM r{i - 1} WHERE doc_id NOT IN (SELECT s FROM shares)) lost
              LEFT JOIN (SELECT t, sum(rank * share) AS got FROM r{i - 1} JOIN shares ON s = doc_id GROUP BY t) g
                ON g.t = r.doc_id)"""
        )
    return f"WITH {', '.join(ctes)} SELECT doc_id, round(rank, 9) AS rank FROM r{_ROUNDS}"


@query("pagerank", _pagerank_sql())
def pagerank(spark, d):
    ranks = graph.pagerank(*inp.trade_graph(spark, d), iterations=_ROUNDS)
    return ranks.withColumn("rank", F.round("rank", 9))


@query(
    "graph_stats",
    f"""WITH {inp.TRADE_SQL}
        SELECT coalesce(relationship_type, '(all)') AS relationship_type, (SELECT count(*) FROM nodes) AS nodes,
               count(*) AS edges, round(count(*)::DOUBLE / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 9)
               AS density
        FROM edges GROUP BY ROLLUP (relationship_type)""",
)
def graph_stats(spark, d):
    return graph.graph_stats(*inp.trade_graph(spark, d))
