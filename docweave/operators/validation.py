"""Document, request and vector checks (V1-V16) as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import SPACE, W, WS, strip

# --- fixed values: rule patterns that results must reproduce exactly -------------
# Document rules, one family per error code.
DOCUMENT_RULES = {
    "SECURITY_XSS": [
        r"(?is)<script[^>]*>.*?</script>",
        r"(?i)javascript:",
        r"(?i)on" + W + r"+" + WS + r"*=",
        r"(?i)<iframe[^>]*>",
    ],
    "SECURITY_SQL_INJECTION": [
        r"(?is)';.*--",
        r"(?i)\bor\b" + WS + r"+\p{Nd}+" + WS + r"*=" + WS + r"*\p{Nd}+",
        r"(?is)\bunion\b.*\bselect\b",
        r"(?is);.*\bdrop\b",
        r"(?i);\bdelete\b",
        r"(?i);\btruncate\b",
        r"(?i)\bexec\b",
        r"(?i)execute" + WS + r"*\(",
    ],
    "SECURITY_PATH_TRAVERSAL": [
        r"\.\./",
        r"\.\.\\",
        r"(?i)%2e%2e",
    ],
    "SECURITY_COMMAND_INJECTION": [
        r";" + WS + r"*" + W + r"+" + WS + r"+",
        r"\|" + WS + r"*" + W + r"+",
        r"`[^\n]*`",
        r"\$\([^\n]*\)",
    ],
}
PII_RULES = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\p{Nd}{3}[-." + SPACE + r"]?\p{Nd}{3}[-." + SPACE + r"]?\p{Nd}{4}\b",
    "ssn": r"\b\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}\b",
    "card": r"\b\p{Nd}{4}[-" + SPACE + r"]?\p{Nd}{4}[-" + SPACE + r"]?\p{Nd}{4}[-" + SPACE + r"]?\p{Nd}{4}\b",
}
DANGEROUS_LINK = r"(?i)\[[^\n]*?\]\((javascript:|data:|vbscript:)"
SUPPORTED_TYPES = ["txt", "md", "markdown", "pdf", "html"]

# Request rules; the sequence of the families is the order of the checks.
REQUEST_RULES = {
    "xss": [
        r"(?is)<script[^>]*>.*?</script>",
        r"(?i)javascript:",
        r"(?i)vbscript:",
        r"(?i)onerror" + WS + r"*=",
        r"(?i)onload" + WS + r"*=",
        r"(?i)onclick" + WS + r"*=",
        r"(?i)<iframe",
        r"(?i)<object",
        r"(?i)<embed",
        r"(?i)onmouseover" + WS + r"*=",
        r"(?i)onfocus" + WS + r"*=",
        r"(?i)onblur" + WS + r"*=",
    ],
    "sql": [
        r"(?is)\bunion\b.*\bselect\b",
        r"(?is)\bor\b.*1" + WS + r"*=" + WS + r"*1",
        r"(?is)\band\b.*1" + WS + r"*=" + WS + r"*1",
        r"(?i)'" + WS + r"+or" + WS + r"+'",
        r"(?i)'" + WS + r"+and" + WS + r"+'",
        r"(?is)\bdrop\b.*\btable\b",
        r"(?is);.*\bexec\b",
        r"(?is)\binsert\b.*\binto\b",
        r"(?is)\bdelete\b.*\bfrom\b",
        r"(?is)\bupdate\b.*\bset\b",
        r"--",
        r"(?s)/\*.*\*/",
        r"(?i)\bor\b" + WS + r"+\p{Nd}+" + WS + r"*=" + WS + r"*\p{Nd}+",
        r"(?i)\band\b" + WS + r"+\p{Nd}+" + WS + r"*=" + WS + r"*\p{Nd}+",
    ],
    "path": [
        r"\.\./",
        r"\.\.\\",
        r"(?i)%2e%2e",
        r"(?i)[^\n][^\n]%2f",
        r"(?i)[^\n][^\n]%5c",
        r"(?i)%252e",
    ],
    "command": [
        r";" + WS + r"*" + W + r"+",
        r"\|",
        r"`",
        r"\$\(",
        r">" + WS + r"*/",
        r"<" + WS + r"*/",
    ],
}
# Report texts; %d and {} stand for figures and found text.
MESSAGES = {
    "none": "Document content is None",
    "empty": "Document content is empty",
    "short": "Content length (%d) is below minimum ({})",
    "long": "Content length (%d) exceeds maximum ({})",
    "encoding": "Content contains invalid characters",
    "xss": "Potential XSS attack pattern detected: ",
    "SECURITY_SQL_INJECTION": "SQL injection pattern detected",
    "SECURITY_PATH_TRAVERSAL": "Path traversal pattern detected",
    "SECURITY_COMMAND_INJECTION": "Command injection pattern detected",
    "emails": "PII_DETECTION: Found %d email address(es)",
    "phones": "PII_DETECTION: Found %d phone number(s)",
    "ssn": "PII_DETECTION: Found SSN pattern(s)",
    "card": "PII_DETECTION: Found credit card pattern(s)",
    "email_error": "Email addresses detected: ",
    "phone_error": "Phone numbers detected: ",
    "ssn_error": "SSN patterns detected",
    "card_error": "Credit card patterns detected",
    "format": "Unsupported file format: ",
    "link": "Markdown contains dangerous link: ",
    "page": "Invalid page number: ",
    "no_page": "PDF metadata missing page number",
    "no_metadata": "Document has no metadata",
    "no_source": "Metadata missing required field: 'source'",
    "recommended": "Metadata missing recommended field: '{}'",
}
# ------------------------------------------------------------------------------------


def _linear(pattern: str) -> str:
    """The same test in one pass for patterns of the shape ``head.*tail``.

    Such a pattern holds when a tail follows the first head. Searching it as it
    stands tries every head against the whole rest of the text, which is far
    too slow for long texts with many heads.
    """
    flags, body = re.fullmatch(r"(\(\?\w+\))?(.*)", pattern, re.S).groups()
    if flags is None or "s" not in flags or body.count(".*") != 1:
        return pattern
    head, tail = body.split(".*")
    tail = tail.removeprefix("?")
    return rf"{flags}\A(?>.*?{head}).*?{tail}"


def any_rule(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs; null counts as no."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | value.rlike(_linear(p))
    return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class ValidationOptions:
    """Limits and switches of the document checks."""

    min_length: int = 50
    max_length: int = 10 * 1024 * 1024
    security: bool = True
    pii: bool = True
    strict: bool = False


DEFAULT = ValidationOptions()
STRICT = replace(DEFAULT, min_length=100, strict=True)
PERMISSIVE = replace(DEFAULT, min_length=10, security=False, pii=False)


def _error(code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), text.alias("message"))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def content_errors(content: Column, opt: ValidationOptions = DEFAULT) -> Column:
    """Empty, too short, too long, badly encoded (V1, V2)."""
    length = F.length(strip(content))
    empty = content.isNull() | (length == 0)
    return _present(
        [
            F.when(content.isNull(), _error("EMPTY_CONTENT", MESSAGES["none"])).when(
                empty, _error("EMPTY_CONTENT", MESSAGES["empty"])
            ),
            F.when(
                ~empty & (length < opt.min_length),
                _error(
                    "CONTENT_TOO_SHORT",
                    F.format_string(MESSAGES["short"].format(opt.min_length), length),
                ),
            ),
            F.when(
                ~empty & (length > opt.max_length),
                _error(
                    "CONTENT_TOO_LONG", F.format_string(MESSAGES["long"].format(opt.max_length), length)
                ),
            ),
            F.when(~empty & ~F.is_valid_utf8(content), _error("ENCODING_ERROR", MESSAGES["encoding"])),
        ]
    )


def security_flags(content: Column) -> dict[str, Column]:
    """One boolean per rule family on the raw content (V3)."""
    return {code: any_rule(content, patterns) for code, patterns in DOCUMENT_RULES.items()}


def security_errors(content: Column, opt: ValidationOptions = DEFAULT) -> Column:
    if not opt.security:
        return F.array().cast("array<struct<code:string,message:string>>")
    # the earliest match of any pattern of the family, as one pattern would find it
    first = F.regexp_extract(content, "|".join(f"(?:{p})" for p in DOCUMENT_RULES["SECURITY_XSS"]), 0)
    found = F.concat(F.lit(MESSAGES["xss"]), F.substring(first, 1, 50), F.lit("..."))
    text = {code: found if code == "SECURITY_XSS" else MESSAGES[code] for code in DOCUMENT_RULES}
    return _present([F.when(flag, _error(code, text[code])) for code, flag in security_flags(content).items()])


def pii_count(content: Column, kind: str) -> Column:
    found = F.regexp_count(content, F.lit(PII_RULES[kind]))
    if kind == "email":  # most texts hold no address and need no pattern search
        found = F.when(F.contains(content, F.lit("@")), found)
    return F.coalesce(found, F.lit(0))


def pii_warnings(content: Column, opt: ValidationOptions = DEFAULT) -> Column:
    """Warnings with counts for addresses and phones (V4)."""
    if not opt.pii:
        return F.array().cast("array<string>")
    emails, phones = pii_count(content, "email"), pii_count(content, "phone")
    return _present(
        [
            F.when(emails > 0, F.format_string(MESSAGES["emails"], emails)),
            F.when(phones > 0, F.format_string(MESSAGES["phones"], phones)),
            F.when(content.rlike(PII_RULES["ssn"]), F.lit(MESSAGES["ssn"])),
            F.when(content.rlike(PII_RULES["card"]), F.lit(MESSAGES["card"])),
        ]
    )


def pii_errors(content: Column, opt: ValidationOptions = DEFAULT) -> Column:
    """Errors of the strict mode only (V4)."""
    if not (opt.pii and opt.strict):
        return F.array().cast("array<struct<code:string,message:string>>")

    def first(kind: str) -> Column:
        return F.regexp_extract(content, PII_RULES[kind], 0)

    return _present(
        [
            F.when(first("email") != "", _error("PII_EMAIL", F.concat(F.lit(MESSAGES["email_error"]), first("email")))),
            F.when(first("phone") != "", _error("PII_PHONE", F.concat(F.lit(MESSAGES["phone_error"]), first("phone")))),
            F.when(content.rlike(PII_RULES["ssn"]), _error("PII_SSN", MESSAGES["ssn_error"])),
            F.when(content.rlike(PII_RULES["card"]), _error("PII_CREDIT_CARD", MESSAGES["card_error"])),
        ]
    )


def format_errors(content: Column, metadata: Column) -> Column:
    """File type, dangerous Markdown links, PDF page number (V5-V7)."""
    kind = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("file_type")), F.lit("")))
    page = F.try_element_at(metadata, F.lit("page"))
    bad_page = F.coalesce(page.try_cast("int"), F.lit(0)) < 1
    link = F.regexp_extract(content, DANGEROUS_LINK, 1)
    return _present(
        [
            F.when(
                (kind != "") & ~kind.isin(SUPPORTED_TYPES),
                _error("UNSUPPORTED_FORMAT", F.concat(F.lit(MESSAGES["format"]), kind)),
            ),
            F.when(
                kind.isin("markdown", "md") & (link != ""),
                _error("MARKDOWN_DANGEROUS_LINK", F.concat(F.lit(MESSAGES["link"]), link)),
            ),
            F.when(
                (kind == "pdf") & page.isNotNull() & bad_page,
                _error("INVALID_METADATA", F.concat(F.lit(MESSAGES["page"]), page)),
            ),
        ]
    )


def format_warnings(metadata: Column) -> Column:
    kind = F.lower(F.try_element_at(metadata, F.lit("file_type")))
    no_page = F.try_element_at(metadata, F.lit("page")).isNull()
    return _present([F.when((kind == "pdf") & no_page, F.lit(MESSAGES["no_page"]))])


def metadata_errors(metadata: Column) -> Column:
    """Metadata must exist and name a source (V8)."""
    none = metadata.isNull() | (F.size(metadata) == 0)
    return _present(
        [
            F.when(none, _error("MISSING_METADATA", MESSAGES["no_metadata"])).when(
                ~F.map_contains_key(metadata, "source"),
                _error("MISSING_METADATA", MESSAGES["no_source"]),
            )
        ]
    )


def metadata_warnings(metadata: Column) -> Column:
    some = metadata.isNotNull() & (F.size(metadata) > 0)
    return _present(
        [
            F.when(some & ~F.map_contains_key(metadata, key), F.lit(MESSAGES["recommended"].format(key)))
            for key in ("file_type", "filename")
        ]
    )


def validate(
    docs: DataFrame, content: str = "content", metadata: str = "metadata", opt: ValidationOptions = DEFAULT
) -> DataFrame:
    """Add ``errors``, ``warnings`` and ``is_valid``; one narrow projection (V9)."""
    c, m = F.col(content), F.col(metadata)
    errors = F.concat(
        content_errors(c, opt), security_errors(c, opt), pii_errors(c, opt), format_errors(c, m), metadata_errors(m)
    )
    warnings = F.concat(pii_warnings(c, opt), format_warnings(m), metadata_warnings(m))
    out = docs.withColumn("warnings", warnings).withColumn("errors", errors)
    if opt.strict:
        promoted = F.transform(F.col("warnings"), lambda w: _error("STRICT_MODE_WARNING", w))
        out = out.withColumn("errors", F.concat("errors", promoted))
    return out.withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Valid documents, and one report row per rejected document."""
    report = validated.where(~F.col("is_valid")).select(
        source,
        F.transform("errors", lambda e: F.concat(F.lit("["), e["code"], F.lit("] "), e["message"])).alias("errors"),
    )
    return validated.where("is_valid"), report


def summary(validated: DataFrame, *by: str) -> DataFrame:
    """Counts of documents, valid ones, errors and warnings."""
    return validated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.sum(F.size("errors")).cast("long").alias("error_count"),
        F.sum(F.size("warnings")).cast("long").alias("warning_count"),
    )


# ---- requests ----------------------------------------------------------------------


def request_flags(value: Column) -> dict[str, Column]:
    """One boolean per family of request rules; null is harmless."""
    return {family: any_rule(value, patterns) for family, patterns in REQUEST_RULES.items()}


def first_request_rule(value: Column) -> Column:
    """Name of the first family that matches, else null; later families are then not tried."""
    rule = F.lit(None).cast("string")
    for family, flag in reversed(request_flags(value).items()):
        rule = F.when(flag, family).otherwise(rule)
    return rule


def with_request_rules(rows: DataFrame, value: str) -> DataFrame:
    """Add a ``<family>_hit`` flag per family and the ``first_rule`` among them."""
    flagged = rows.select("*", *[f.alias(f"{name}_hit") for name, f in request_flags(F.col(value)).items()])
    rule = F.lit(None).cast("string")
    for family in reversed(REQUEST_RULES):
        rule = F.when(F.col(f"{family}_hit"), family).otherwise(rule)
    return flagged.withColumn("first_rule", rule)


def _json_strings(value: object) -> Iterator[tuple[str, str]]:
    """``(path, text)`` of every key and string value; objects are lists of pairs, so that repeated keys all count."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, str):
            yield path, v
        elif isinstance(v, tuple):
            for key, child in v:
                inner = f"{path}.{key}" if path else key
                yield f"{inner}#key", key
                stack.append((inner, child))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", child) for i, child in enumerate(v))


def _json_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            at, paths, texts, parsed = [], [], [], []
            for i, raw in enumerate(part.column(1).to_pylist()):
                if raw is None:
                    continue
                try:
                    found = list(_json_strings(json.loads(raw, object_pairs_hook=tuple)))
                except (ValueError, RecursionError):
                    found = None
                rows = [("", raw)] if found is None else found
                at += [i] * len(rows)
                paths += [p for p, _ in rows]
                texts += [t.encode("utf-8", "replace").decode() for _, t in rows]
                parsed += [found is not None] * len(rows)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(parsed)],
                    names=["_key", "path", "_text", "_parsed"],
                )


def scan_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rule hits in keys and string values of JSON, with their path.

    Goes to any depth; all values of a repeated key are scanned, and NaN is a number.
    Text that is not JSON, or nested too deeply to be read, has a row ``unparsed``
    and is scanned as it stands, with an empty path. A null has no row.
    """
    kind = rows.schema[key].dataType.simpleString()
    strings = rows.select(key, F.col(text).cast("string")).mapInArrow(
        _json_rows, f"_key {kind}, path string, _text string, _parsed boolean"
    )
    hits = strings.withColumn("rule", first_request_rule(F.col("_text"))).where("rule IS NOT NULL").select("_key", "path", "rule")
    unparsed = strings.where("NOT _parsed").select("_key", "path", F.lit("unparsed").alias("rule"))
    return hits.unionAll(unparsed).distinct().withColumnRenamed("_key", key)


def query_reject_reason(query: Column, top_k: Column, max_tokens: Column | None = None) -> Column:
    """First broken limit of a question, else null."""
    reason = (
        F.when(query.isNull() | (strip(query) == ""), "Query cannot be empty")
        .when(F.length(query) > 1000, "Query too long (max 1000 characters)")
        .when(~top_k.between(1, 20), "top_k must be between 1 and 20")
    )
    if max_tokens is not None:
        reason = reason.when(~max_tokens.between(100, 4096), "max_tokens must be between 100 and 4096")
    return reason


def vector_quality(texts: DataFrame, vectors: DataFrame, on: str, embedding: str = "embedding") -> DataFrame:
    """Inputs without a vector, empty vectors and the range of dimensions."""
    joined = texts.select(on).join(vectors.select(on, F.size(embedding).alias("_dim")), on, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("inputs"),
        F.count_if(F.col("_dim").isNull()).alias("missing"),
        F.count_if(F.col("_dim") == 0).alias("empty"),
        F.min("_dim").cast("long").alias("min_dim"),
        F.max("_dim").cast("long").alias("max_dim"),
    )


def metadata_filter(filters: dict[str, object]) -> Column:
    """Every ``key = value`` must hold (V16); plain equalities, so that scans can use them."""
    cond = F.lit(True)
    for name, value in filters.items():
        cond = cond & (F.col(name) == F.lit(value))
    return cond
