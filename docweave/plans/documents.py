"""Queries on texts: identity, keys, chunks, structure, validation (S, P, C, T, V)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunking, ingest, structure, validation
from docweave.operators.context import stream_context
from docweave.plans import inputs as inp
from docweave.plans.registry import lit, query
from docweave.sources.tables import spread, table

WS = tx.WS


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


# ---- identity and batches ---------------------------------------------------------------

KEY_SQL = "source || '_' || substr(sha256(text), 1, 16)"


@query("doc_identity", f"SELECT doc_id, {KEY_SQL} AS content_key FROM documents")
def doc_identity(spark, d):
    return docs(spark, d).select("doc_id", tx.content_id(F.col("source"), F.col("text")).alias("content_key"))


@query(
    "dedup_exact",
    f"SELECT {KEY_SQL} AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
def dedup_exact(spark, d):
    return ingest.collapse_exact(docs(spark, d), "doc_id", content="text")


@query(
    "batch_duplicate_ids",
    "SELECT substr(sha256(text), 1, 16) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def batch_duplicate_ids(spark, d):
    return ingest.duplicate_ids(docs(spark, d).select(F.substring(digest(F.col("text")), 1, 16).alias("id")))


@query(
    "batch_check",
    """SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicated_ids,
              sum(n) <= 1000 AND count(*) FILTER (n > 1) = 0 AS accepted
       FROM (SELECT count(*) AS n FROM documents GROUP BY substr(sha256(text), 1, 16))""",
)
def batch_check(spark, d):
    return ingest.check_batch(docs(spark, d).select(F.substring(digest(F.col("text")), 1, 16).alias("id")))


# ---- tokens, keys, escapes ---------------------------------------------------------------


@query(
    "token_counts",
    f"""SELECT doc_id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS distinct_tokens
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{inp.WORDS}') AS t FROM documents)""",
)
def token_counts(spark, d):
    t = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id",
        F.size("t").cast("long").alias("tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
    )


def normalized_sql(expr: str) -> str:
    squeezed = f"regexp_replace(lower({expr}), {lit(WS + '+')}, ' ', 'g')"
    pattern = rf"[^\p{{L}}\p{{N}}{tx.SPACE}]"
    return inp.strip_sql(f"regexp_replace({squeezed}, {lit(pattern)}, '', 'g')")


@query("query_normalize", f"SELECT conv_id, turn, {normalized_sql('text')} AS normalized FROM conversations")
def query_normalize(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.normalize_query(F.col("text")).alias("normalized")
    )


@query(
    "query_key",
    rf"""SELECT conv_id, turn, 'rag:' || sha256(concat_ws(':', 'v2', {normalized_sql('text')}, 'default',
             (turn % 20 + 1)::VARCHAR, CASE WHEN turn % 2 = 0 THEN 'True' ELSE 'False' END,
             CASE WHEN role = 'user' THEN 'True' ELSE 'False' END,
             CASE WHEN role = 'system' THEN '' ELSE
               '{{"role": "' || role || '", "word": "' ||
               coalesce(list_aggregate(list_transform(string_split(word, ''), lambda c:
                 CASE WHEN unicode(c) > 126 THEN format('\u{{:04x}}', unicode(c)) ELSE c END), 'string_agg', ''), '')
               || '"}}' END)) AS cache_key
         FROM (SELECT *, regexp_extract(text, '{inp.WORDS}') AS word FROM conversations)""",
)
def query_key(spark, d):
    word = F.regexp_extract("text", f"{tx.W}+", 0)
    filters = F.when(F.col("role") != "system", F.create_map(F.lit("word"), word, F.lit("role"), F.col("role")))
    key = tx.query_key(
        F.col("text"),
        F.lit("default"),
        F.col("turn") % 20 + 1,
        F.col("turn") % 2 == 0,
        F.col("role") == "user",
        filters,
    )
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("cache_key"))


def _escaped_sql(expr: str) -> str:
    out = expr
    for code, shown in [(10, "\\n"), (13, "\\r"), (9, "\\t")]:
        out = f"replace({out}, chr({code}), {lit(shown)})"
    for code in [*range(1, 32), 127]:
        if code not in (9, 10, 13):
            out = f"replace({out}, chr({code}), {lit(f'\\x{code:02x}')})"
    return out


@query(
    "sanitize_text",
    f"""SELECT kind, id, length(safe) AS chars, sha256(safe) AS safe_hash FROM (
          SELECT 'document' AS kind, doc_id AS id, {_escaped_sql('text')} AS safe FROM documents
          UNION ALL SELECT 'page', page_id, {_escaped_sql('html')} FROM pages)""",
)
def sanitize_text(spark, d):
    rows = texts_and_pages(spark, d).withColumn("safe", tx.escape_controls(F.col("text")))
    return rows.select("kind", "id", F.length("safe").cast("long").alias("chars"), digest(F.col("safe")).alias("safe_hash"))


def texts_and_pages(spark: SparkSession, d: str) -> DataFrame:
    return (
        docs(spark, d)
        .select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
        .union(spread(table(spark, d, "pages"), "page_id").select(F.lit("page"), "page_id", "html"))
    )


@query(
    "guarded_input",
    f"""SELECT doc_id, CASE WHEN length(text) <= 10000 THEN length({inp.strip_sql('text')}) END AS chars,
               CASE WHEN length(text) > 10000
                    THEN 'Input too long (max 10000 chars, got ' || length(text)::VARCHAR || ')' END AS reason
        FROM documents""",
)
def guarded_input(spark, d):
    value, reason = tx.guarded_input(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(value).cast("long").alias("chars"), reason.alias("reason"))


@query(
    "email_valid",
    rf"""SELECT kind, id, word, regexp_matches(word, {lit(tx.EMAIL_ADDRESS)}) AS valid, count(*) AS uses FROM (
           SELECT kind, id, unnest(regexp_split_to_array(text, {lit(WS + '+')})) AS word FROM (
             SELECT 'document' AS kind, doc_id AS id, text FROM documents
             UNION ALL SELECT 'page', page_id, html FROM pages))
         WHERE contains(word, '@') GROUP BY 1, 2, 3, 4""",
)
def email_valid(spark, d):
    words = texts_and_pages(spark, d).where(F.contains("text", F.lit("@"))).select(
        "kind", "id", F.explode(F.filter(F.split("text", f"{WS}+"), lambda w: F.contains(w, F.lit("@")))).alias("word")
    )
    return words.groupBy("kind", "id", "word", tx.is_email(F.col("word")).alias("valid")).agg(
        F.count(F.lit(1)).alias("uses")
    )


def _prompt_sql(question: str, context: str) -> str:
    head, rest = tx.PROMPT_TEMPLATE.split("<CONTEXT>")
    middle, tail = rest.split("<QUESTION>")
    return f"{lit(head)} || {context} || {lit(middle)} || {question} || {lit(tail)}"


@query(
    "prompt_table",
    f"""WITH {inp.ANSWERED_SQL}
        SELECT conv_id, turn, sha256(p) AS prompt_hash, length(p) AS chars
        FROM (SELECT conv_id, turn, {_prompt_sql('question', "coalesce('[Source 1] ' || answer, '')")} AS p FROM answered)""",
)
def prompt_table(spark, d):
    pairs = inp.answered(spark, d).withColumn("query_id", F.struct("conv_id", "turn"))
    one = pairs.select("query_id", F.lit(1).alias("rank"), F.col("answer").alias("document"), "question")
    built = stream_context(one).join(one.select("query_id", "question"), "query_id")
    p = tx.prompt(F.col("question"), F.col("context"))
    return built.select("query_id.*", digest(p).alias("prompt_hash"), F.length(p).cast("long").alias("chars"))


@query(
    "encrypt_roundtrip",
    "SELECT doc_id, sha256(text) AS plain_hash, true AS wrong_key_rejected FROM documents",
)
def encrypt_roundtrip(spark, d):
    key, other = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2)), F.unhex(F.lit("0f" * 32))
    sealed = docs(spark, d).select("doc_id", tx.encrypt(F.col("text"), key).alias("sealed"))
    return sealed.select(
        "doc_id",
        digest(tx.decrypt(F.col("sealed"), key)).alias("plain_hash"),
        tx.decrypt(F.col("sealed"), other).isNull().alias("wrong_key_rejected"),
    )


# ---- chunks ---------------------------------------------------------------------------------


def _fold_sql(size: int, overlap: int) -> str:
    """The packing of parts as a list fold; all elements carry the type of the state."""
    return f"""
    list_reduce(
      list_transform(string_split(text, sep), lambda p: {{'out': []::VARCHAR[], 'cur': p}}),
      lambda acc, e: CASE
        WHEN acc.cur = '' THEN {{'out': acc.out, 'cur': e.cur}}
        WHEN length(acc.cur) + length(e.cur) > {size}
          THEN {{'out': list_append(acc.out, {inp.strip_sql('acc.cur')}), 'cur': right(acc.cur, {overlap}) || sep || e.cur}}
        ELSE {{'out': acc.out, 'cur': acc.cur || sep || e.cur}} END,
      {{'out': []::VARCHAR[], 'cur': ''}})"""


FIXED_SQL = f"""
fixed AS (
  SELECT doc_id, source, list_filter(list_transform(range(0, length(text), 800),
           lambda i: {inp.strip_sql('substr(text, i + 1, 1000)')}), lambda c: c <> '') AS chunks
  FROM documents)"""
def _chunks_sql(separators: str) -> str:
    """CTEs up to ``chunked``; ``separators`` are the branches that pick one."""
    return f"""
separated AS (SELECT doc_id, source, text, CASE {separators} END AS sep FROM documents),
folded AS (SELECT doc_id, source, {_fold_sql(1000, 200)} AS f FROM separated WHERE sep IS NOT NULL),
split AS (
  SELECT doc_id, source, CASE WHEN f.cur <> '' THEN list_append(f.out, {inp.strip_sql('f.cur')}) ELSE f.out END AS chunks
  FROM folded),
{FIXED_SQL},
chunked AS (
  SELECT f.doc_id, f.source, CASE WHEN len(s.chunks) > 0 THEN s.chunks ELSE f.chunks END AS chunks
  FROM fixed f LEFT JOIN split s ON s.doc_id = f.doc_id)"""


CHUNKS_SQL = _chunks_sql(
    """WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10)
       WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, '. ') THEN '. '
       WHEN contains(text, ' ') THEN ' '"""
)


def _chunk_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("original_doc_id").alias("doc_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("total_chunks").cast("long").alias("total_chunks"),
        F.length("content").cast("long").alias("chars"),
        "chunk_id",
    )


def _chunk_rows_sql(ctes: str, frm: str) -> str:
    return f"""WITH {ctes}
      SELECT doc_id, i - 1 AS chunk_index, len(chunks)::BIGINT AS total_chunks, length(chunks[i]) AS chars,
             source || '_' || substr(sha256(chunks[i]), 1, 16) AS chunk_id
      FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM {frm})"""


@query("chunk_documents", _chunk_rows_sql(CHUNKS_SQL, "chunked"))
def chunk_documents(spark, d):
    return _chunk_rows(chunking.chunk_documents(docs(spark, d), "text"))


@query(
    "chunk_separators",
    _chunk_rows_sql(_chunks_sql("WHEN contains(text, ' | ') THEN ' | ' WHEN contains(text, ', ') THEN ', '"), "chunked"),
)
def chunk_separators(spark, d):
    """Separators of the caller: table cells, then clauses."""
    return _chunk_rows(chunking.chunk_documents(docs(spark, d), "text", separators=[" | ", ", "]))


@query("chunk_fixed", _chunk_rows_sql(FIXED_SQL, "fixed"))
def chunk_fixed(spark, d):
    return _chunk_rows(chunking.explode_chunks(docs(spark, d), chunking.fixed_chunks(F.col("text"))))


@query(
    "chunk_expand",
    f"""WITH {FIXED_SQL}
        SELECT source || '_' || substr(sha256(chunks[i]), 1, 16) AS chunk_id, lang, n_chars, i - 1 AS chunk_index
        FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM fixed) JOIN (
          SELECT doc_id, lang, n_chars FROM documents) USING (doc_id)""",
)
def chunk_expand(spark, d):
    rows = chunking.explode_chunks(docs(spark, d), chunking.fixed_chunks(F.col("text")))
    return rows.select("chunk_id", "lang", "n_chars", F.col("chunk_index").cast("long").alias("chunk_index"))


# ---- structure of Markdown texts --------------------------------------------------------------


def _parsed(spark, d, items: Column) -> DataFrame:
    return structure.unnest(inp.markdown(spark, d), items, "doc_id")


@query(
    "extract_tables",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 3::BIGINT AS line, 'measure|value|unit' AS headers, row_no, cells FROM (
          SELECT doc_id, 1::BIGINT AS row_no, 'quantity|' || qty || '|pieces' AS cells FROM items
          UNION ALL SELECT doc_id, 2, 'discount|' || disc || '|percent' FROM items
          UNION ALL SELECT doc_id, 3, 'returned||flag' FROM items WHERE rf = 'R')""",
)
def extract_tables(spark, d):
    t = _parsed(spark, d, structure.tables_of(F.col("text")))
    return t.select(
        "doc_id",
        F.col("line").cast("long").alias("line"),
        F.array_join("headers", "|").alias("headers"),
        F.posexplode("rows").alias("row_no", "cells"),
    ).select(
        "doc_id", "line", "headers", (F.col("row_no") + 1).cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells")
    )


@query(
    "table_records",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 'quantity' AS measure, qty AS value, 'pieces' AS unit FROM items
        UNION ALL SELECT doc_id, 'discount', disc, 'percent' FROM items
        UNION ALL SELECT doc_id, 'returned', '', 'flag' FROM items WHERE rf = 'R'""",
)
def table_records(spark, d):
    t = _parsed(spark, d, structure.tables_of(F.col("text")))
    r = t.select("doc_id", F.explode(structure.table_records(F.col("headers"), F.col("rows"))).alias("r"))
    return r.select("doc_id", *[F.col("r")[c].alias(c) for c in ("measure", "value", "unit")])


_NL, _CRLF = "chr(10)", "chr(13) || chr(10)"
_TABLE_MD = f"""'| measure | value | unit |' || {_NL} || '| --- | --- | --- |' || {_NL} || '| quantity | ' || qty
  || ' | pieces |' || {_NL} || '| discount | ' || disc || ' | percent |'
  || CASE WHEN rf = 'R' THEN {_NL} || '| returned |  | flag |' ELSE '' END"""


@query(
    "table_exports",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, '**Table: Line ' || doc_id::VARCHAR || '**' || {_NL} || {_NL} || {_TABLE_MD} AS markdown,
               'measure,value,unit' || {_CRLF} || 'quantity,' || qty || ',pieces' || {_CRLF} || 'discount,' || disc
               || ',percent' || {_CRLF} || CASE WHEN rf = 'R' THEN 'returned,,flag' || {_CRLF} ELSE '' END AS csv
        FROM items""",
)
def table_exports(spark, d):
    t = _parsed(spark, d, structure.tables_of(F.col("text")))
    h, r = F.col("headers"), F.col("rows")
    caption = F.concat(F.lit("Line "), F.col("doc_id").cast("string"))
    return t.select(
        "doc_id", structure.table_markdown(h, r, caption).alias("markdown"), structure.table_csv(h, r).alias("csv")
    )


_CHART_LINE = "CASE rf WHEN 'A' THEN 'As shown in Figure ' || ln || ' the bar grows.' ELSE 'A pie chart of part ' || pk END"


@query(
    "chart_refs",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 1::BIGINT AS line, {_CHART_LINE} AS description,
               CASE rf WHEN 'A' THEN 'bar' ELSE 'pie' END AS chart_type FROM items WHERE rf IN ('A', 'N')""",
)
def chart_refs(spark, d):
    return _parsed(spark, d, structure.charts_of(F.col("text"))).withColumn("line", F.col("line").cast("long"))


_TEXT_SQL = f"""'# Order ' || ok || ' line ' || ln || {_NL}
  || CASE WHEN rf IN ('A', 'N') THEN {_CHART_LINE} ELSE 'Nothing drawn here.' END || {_NL} || '## Amounts' || {_NL}
  || {_TABLE_MD} || {_NL} || {_NL} || '- [order ' || ok || '](http://shop.example/o/' || ok
  || ') and [part](http://shop.example/p/' || pk || ')' || {_NL} || '  1. supplier ' || sk || {_NL} || '```sql' || {_NL}
  || 'select ' || ln || {_NL} || '```' || {_NL} || '## Notes'
  || CASE WHEN ls = 'F' THEN {_NL} || 'finished' || {_NL} ELSE '' END"""


@query(
    "full_text",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, sha256(body) AS text_hash, length(body) AS chars FROM (
          SELECT doc_id, {_TEXT_SQL} || repeat({_NL}, 3) || 'Table 1:' || {_NL} || {_TABLE_MD} || {_NL}
            || CASE WHEN rf IN ('A', 'N') THEN repeat({_NL}, 3) || 'Charts and Figures:' || repeat({_NL}, 2) || '- '
                    || {_CHART_LINE} ELSE '' END AS body
          FROM items)""",
)
def full_text(spark, d):
    t = inp.markdown(spark, d).select(
        "doc_id", "text", structure.tables_of(F.col("text")).alias("t"), structure.charts_of(F.col("text")).alias("c")
    )
    body = t.select("doc_id", structure.full_text(F.col("text"), F.col("t"), F.col("c")).alias("body"))
    return body.select("doc_id", digest(F.col("body")).alias("text_hash"), F.length("body").cast("long").alias("chars"))


@query(
    "parse_summary",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 1::BIGINT AS total_tables, CASE WHEN rf = 'R' THEN 0 ELSE 1 END::BIGINT AS total_charts,
               1::BIGINT AS tables_extracted FROM items""",
)
def parse_summary(spark, d):
    s = structure.parse_summary(inp.markdown(spark, d)).drop("text")
    return s.select("doc_id", *[F.col(c).cast("long").alias(c) for c in s.columns if c != "doc_id"])


@query(
    "md_headers",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 0::BIGINT AS line, 1::BIGINT AS level, 'Order ' || ok || ' line ' || ln AS title FROM items
        UNION ALL SELECT doc_id, 2, 2, 'Amounts' FROM items
        UNION ALL SELECT doc_id, 13 + extra, 2, 'Notes' FROM items""",
)
def md_headers(spark, d):
    h = _parsed(spark, d, structure.headers_of(F.col("text")))
    return h.withColumn("line", F.col("line").cast("long")).withColumn("level", F.col("level").cast("long"))


@query(
    "md_code_blocks",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, (10 + extra)::BIGINT AS start_line, (12 + extra)::BIGINT AS end_line, 'sql' AS language FROM items""",
)
def md_code_blocks(spark, d):
    b = _parsed(spark, d, structure.code_blocks_of(F.col("text")))
    return b.select(
        "doc_id", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"), "language"
    )


@query(
    "md_lists",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, (8 + extra)::BIGINT AS line, '- [order ' || ok || '](http://shop.example/o/' || ok
               || ') and [part](http://shop.example/p/' || pk || ')' AS content FROM items
        UNION ALL SELECT doc_id, 9 + extra, '1. supplier ' || sk FROM items""",
)
def md_lists(spark, d):
    return _parsed(spark, d, structure.list_items_of(F.col("text"))).withColumn("line", F.col("line").cast("long"))


@query(
    "md_links",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, (8 + extra)::BIGINT AS line, 'order ' || ok AS text, 'http://shop.example/o/' || ok AS url FROM items
        UNION ALL SELECT doc_id, 8 + extra, 'part', 'http://shop.example/p/' || pk FROM items""",
)
def md_links(spark, d):
    return _parsed(spark, d, structure.links_of(F.col("text"))).withColumn("line", F.col("line").cast("long"))


@query(
    "md_sections",
    f"""WITH {inp.ITEMS_SQL}
        SELECT doc_id, 'Order ' || ok || ' line ' || ln AS title, 1::BIGINT AS level,
               CASE WHEN rf IN ('A', 'N') THEN {_CHART_LINE} ELSE 'Nothing drawn here.' END AS content FROM items
        UNION ALL SELECT doc_id, 'Amounts', 2, {_TABLE_MD} || {_NL} || {_NL} || '- [order ' || ok
               || '](http://shop.example/o/' || ok || ') and [part](http://shop.example/p/' || pk || ')' || {_NL}
               || '  1. supplier ' || sk || {_NL} || '```sql' || {_NL} || 'select ' || ln || {_NL} || '```' FROM items
        UNION ALL SELECT doc_id, 'Notes', 2, 'finished' FROM items WHERE ls = 'F'""",
)
def md_sections(spark, d):
    return _parsed(spark, d, structure.sections_of(F.col("text"))).withColumn("level", F.col("level").cast("long"))


# ---- validation ----------------------------------------------------------------------------------

LENGTH_SQL = f"length({inp.strip_sql('text')})"


@query(
    "validate_content",
    f"""SELECT doc_id, CASE WHEN text IS NULL OR {LENGTH_SQL} = 0 THEN 'EMPTY_CONTENT' WHEN {LENGTH_SQL} < 50 THEN 'CONTENT_TOO_SHORT'
               WHEN {LENGTH_SQL} > 10485760 THEN 'CONTENT_TOO_LONG' ELSE '' END AS codes FROM documents""",
)
def validate_content(spark, d):
    errors = validation.content_errors(F.col("text"))
    return docs(spark, d).select("doc_id", F.array_join(F.transform(errors, lambda e: e["code"]), ",").alias("codes"))


def match_sql(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def any_sql(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(match_sql(expr, p) for p in patterns) + ")"


_DOC_FLAGS_SQL = ", ".join(
    f"{any_sql('text', p)} AS {code.lower()}" for code, p in validation.DOCUMENT_RULES.items()
)
_BOTH_SQL = """(SELECT 'document' AS kind, doc_id AS id, text FROM documents
                UNION ALL SELECT 'page', page_id, html FROM pages)"""


@query("validate_security", f"SELECT kind, id, {_DOC_FLAGS_SQL} FROM {_BOTH_SQL}")
def validate_security(spark, d):
    flags = validation.security_flags(F.col("text"))
    return texts_and_pages(spark, d).select("kind", "id", *[f.alias(c.lower()) for c, f in flags.items()])


_PII_SQL = ", ".join(
    f"len(regexp_extract_all(text, {lit(p)}))::BIGINT AS {kind}_count" for kind, p in validation.PII_RULES.items()
)


@query("pii_counts", f"SELECT kind, id, {_PII_SQL} FROM {_BOTH_SQL}")
def pii_counts(spark, d):
    counts = [
        validation.pii_count(F.col("text"), kind).cast("long").alias(f"{kind}_count") for kind in validation.PII_RULES
    ]
    return texts_and_pages(spark, d).select("kind", "id", *counts)


# metadata of the documents: type by language, page by length, no file name for some sources
_TYPE = {"en": "TXT", "de": "md", "fr": "pdf", "es": "docx"}


def _described(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in _TYPE.items() for x in pair])[F.col("lang")]
    pairs = F.map_filter(
        F.create_map(
            F.lit("file_type"), F.when(F.col("source") != "src1", kind),
            F.lit("source"), F.when(F.col("source") != "src2", F.col("source")),
            F.lit("filename"), F.when(F.col("source") != "src3", F.lit("f")),
            F.lit("page"), F.when(F.col("n_chars") > 300, (F.col("n_chars") % 3).cast("string")),
        ),
        lambda _k, v: v.isNotNull(),
    )
    metadata = F.when(F.col("source") != "src4", pairs)
    return docs(spark, d).select("doc_id", "lang", F.col("text").alias("content"), metadata.alias("metadata"))


def _described_sql(minimum: int, strict: bool, rules: bool = True, maximum: int = validation.DEFAULT.max_length) -> str:
    has = "source <> 'src4'"
    kind = f"CASE WHEN {has} AND source <> 'src1' THEN CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'pdf' ELSE 'docx' END END"
    errors = [
        f"CASE WHEN {LENGTH_SQL} = 0 THEN 'EMPTY_CONTENT' WHEN {LENGTH_SQL} < {minimum} THEN 'CONTENT_TOO_SHORT' END",
        f"CASE WHEN {LENGTH_SQL} > {maximum} THEN 'CONTENT_TOO_LONG' END",
        *[f"CASE WHEN {any_sql('text', p)} THEN '{code}' END" for code, p in validation.DOCUMENT_RULES.items() if rules],
    ]
    pii = {k: match_sql("text", p) for k, p in validation.PII_RULES.items()}
    if strict:
        codes = {"email": "PII_EMAIL", "phone": "PII_PHONE", "ssn": "PII_SSN", "card": "PII_CREDIT_CARD"}
        errors += [f"CASE WHEN {pii[k]} THEN '{codes[k]}' END" for k in pii]
    errors += [
        "CASE WHEN kind = 'docx' THEN 'UNSUPPORTED_FORMAT' END",
        f"CASE WHEN kind = 'md' AND {match_sql('text', validation.DANGEROUS_LINK)} THEN 'MARKDOWN_DANGEROUS_LINK' END",
        "CASE WHEN kind = 'pdf' AND n_chars > 300 AND n_chars % 3 < 1 THEN 'INVALID_METADATA' END",
        f"CASE WHEN source = 'src4' OR source = 'src2' THEN 'MISSING_METADATA' END",
    ]

    def count(k: str) -> str:
        return f"len(regexp_extract_all(text, {lit(validation.PII_RULES[k])}))::VARCHAR"

    warnings = [
        f"CASE WHEN {pii['email']} THEN 'PII_DETECTION: Found ' || {count('email')} || ' email address(es)' END",
        f"CASE WHEN {pii['phone']} THEN 'PII_DETECTION: Found ' || {count('phone')} || ' phone number(s)' END",
        f"CASE WHEN {pii['ssn']} THEN 'PII_DETECTION: Found SSN pattern(s)' END",
        f"CASE WHEN {pii['card']} THEN 'PII_DETECTION: Found credit card pattern(s)' END",
        "CASE WHEN kind = 'pdf' AND NOT n_chars > 300 THEN 'PDF metadata missing page number' END",
        "CASE WHEN source = 'src1' THEN 'Metadata missing recommended field: ''file_type''' END",
        "CASE WHEN source = 'src3' THEN 'Metadata missing recommended field: ''filename''' END",
    ]

    if not rules:
        warnings = warnings[4:]

    def present(items: list[str]) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    promoted = "list_concat(e, list_transform(w, lambda x: 'STRICT_MODE_WARNING'))" if strict else "e"
    return f"""
    described AS (SELECT doc_id, lang, source, text, n_chars, {kind} AS kind FROM documents),
    listed AS (SELECT doc_id, lang, {present(errors)} AS e, {present(warnings)} AS w FROM described),
    checked AS (SELECT doc_id, lang, {promoted} AS errors, w AS warnings FROM listed)"""


def _checked_sql(minimum: int, strict: bool, rules: bool = True, maximum: int = validation.DEFAULT.max_length) -> str:
    return f"""WITH {_described_sql(minimum, strict, rules, maximum)}
        SELECT doc_id, len(errors) = 0 AS is_valid, array_to_string(errors, ',') AS errors,
               array_to_string(warnings, ';') AS warnings FROM checked"""


def _checked(validated: DataFrame) -> DataFrame:
    return validated.select(
        "doc_id",
        "is_valid",
        F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("errors"),
        F.array_join("warnings", ";").alias("warnings"),
    )


@query("validate_documents", _checked_sql(50, False))
def validate_documents(spark, d):
    return _checked(validation.validate(_described(spark, d)))


@query("validate_strict", _checked_sql(100, True))
def validate_strict(spark, d):
    return _checked(validation.validate(_described(spark, d), opt=validation.STRICT))


@query("validate_permissive", _checked_sql(10, False, False, 5000))
def validate_permissive(spark, d):
    """Few checks, and a limit that many texts exceed."""
    return _checked(validation.validate(_described(spark, d), opt=replace(validation.PERMISSIVE, max_length=5000)))


@query(
    "validation_summary",
    f"""WITH {_described_sql(50, False)}
        SELECT lang, count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid,
               count(*) FILTER (len(errors) > 0) AS invalid, sum(len(errors))::BIGINT AS error_count,
               sum(len(warnings))::BIGINT AS warning_count FROM checked GROUP BY lang""",
)
def validation_summary(spark, d):
    return validation.summary(validation.validate(_described(spark, d)), "lang")


@query(
    "rejected_documents",
    f"""WITH {_described_sql(50, False)}
        SELECT doc_id, unnest(errors) AS code FROM checked""",
)
def rejected_documents(spark, d):
    _valid, report = validation.split_valid(validation.validate(_described(spark, d)), "doc_id")
    code = F.regexp_extract(F.col("e"), r"^\[([A-Z_]+)\]", 1)
    return report.select("doc_id", F.explode("errors").alias("e")).select("doc_id", code.alias("code"))


def _first_rule_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {any_sql(expr, p)} THEN '{f}'" for f, p in validation.REQUEST_RULES.items())
    return f"CASE {whens} END"


_REQUEST_SQL = ", ".join(f"{any_sql('text', p)} AS {f}_hit" for f, p in validation.REQUEST_RULES.items())


@query("request_rules", f"SELECT kind, id, {_REQUEST_SQL}, {_first_rule_sql('text')} AS first_rule FROM {_BOTH_SQL}")
def request_rules(spark, d):
    return validation.with_request_rules(texts_and_pages(spark, d), "text").drop("text")


@query(
    "json_rule_scan",
    f"""SELECT id, path, rule FROM (
          SELECT id, path, {_first_rule_sql('v')} AS rule FROM (
            SELECT 'e' || event_id::VARCHAR AS id, 'k#key' AS path, 'k' AS v FROM events
            UNION ALL SELECT 'e' || event_id::VARCHAR, '', props || 'x' FROM events WHERE event_id % 10 = 0
            UNION ALL SELECT 'p' || page_id::VARCHAR, 'url', url FROM pages
            UNION ALL SELECT 'p' || page_id::VARCHAR, 'links[0]', url FROM pages
            UNION ALL SELECT 'p' || page_id::VARCHAR, 'links[0]', html FROM pages
            UNION ALL SELECT 'p' || page_id::VARCHAR, 'a.b.c.d.e.f.g.body', html FROM pages)) WHERE rule IS NOT NULL
        UNION SELECT 'e' || event_id::VARCHAR, '', 'unparsed' FROM events WHERE event_id % 10 = 0""",
)
def json_rule_scan(spark, d):
    """Values eight levels deep, a key that stands twice, and text that is not JSON."""
    broken = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    events = table(spark, d, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), broken.alias("payload")
    )
    deep = F.struct(F.col("html").alias("body"), F.col("page_id").alias("number"))
    for name in "gfedcba":
        deep = F.struct(deep.alias(name))
    pages = spread(table(spark, d, "pages"), "page_id").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.concat(
            F.regexp_replace(F.to_json(F.struct("url", F.array("url").alias("links"))), "\\}$", ',"links":'),
            F.to_json(F.array("html")),
            F.regexp_replace(F.to_json(deep), "^\\{", ","),
        ).alias("payload"),
    )
    return validation.scan_json(events.union(pages), "id", "payload")


@query(
    "vector_quality",
    """SELECT count(*) AS inputs, count(*) FILTER (embedding IS NULL) AS missing,
              count(*) FILTER (len(embedding) = 0) AS empty, min(len(embedding))::BIGINT AS min_dim,
              max(len(embedding))::BIGINT AS max_dim
       FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
)
def vector_quality(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return validation.vector_quality(docs(spark, d), vectors, "doc_id")


@query(
    "request_guards",
    f"""SELECT conv_id, turn, CASE WHEN {LENGTH_SQL} = 0 THEN 'Query cannot be empty'
          WHEN length(text) > 1000 THEN 'Query too long (max 1000 characters)'
          WHEN NOT turn * 4 BETWEEN 1 AND 20 THEN 'top_k must be between 1 and 20'
          WHEN NOT length(text) * 10 BETWEEN 100 AND 4096 THEN 'max_tokens must be between 100 and 4096' END AS reason
        FROM conversations""",
)
def request_guards(spark, d):
    reason = validation.query_reject_reason(F.col("text"), F.col("turn") * 4, F.length("text") * 10)
    return table(spark, d, "conversations").select("conv_id", "turn", reason.alias("reason"))
