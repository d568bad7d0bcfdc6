"""Column expressions on text: stripping, tokens, keys, escapes.

Character classes are spelled out because ``\\w`` and ``\\s`` are ASCII in Java
and RE2, while the semantics to match are Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word and white-space characters, as regex class bodies.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
W = f"[{WORD}]"
WS = f"[{SPACE}]"

# All white-space characters that strip() removes; every one lies below U+3001.
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# --- fixed values: formats that results must reproduce exactly ---------------
EMAIL_ADDRESS = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
QUERY_KEY_PREFIX = "rag:"
QUERY_KEY_VERSION = "v2"
PREVIEW_CHARS = 200
PROMPT_TEMPLATE = """\
You are a helpful AI assistant that answers questions based on the provided context.

Context information is below:
---
<CONTEXT>
---

Instructions:
- Answer the question using ONLY the information provided in the context above
- If the context doesn't contain enough information to answer the question, say so clearly
- Cite your sources by mentioning the source number [Source X]
- Be concise but comprehensive
- If you're uncertain, acknowledge it

Question: <QUESTION>

Answer:"""
NO_RESULT_TEXT = "I couldn't find any relevant information to answer your question."
# ------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def tokens(c: Column) -> Column:
    """Lower-cased word tokens in order (P5)."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({W}+)"), F.lit(1))


def content_id(source: Column, content: Column) -> Column:
    """Content-addressed id: source and the first 16 hash digits."""
    return F.concat(
        F.coalesce(source, F.lit("unknown")),
        F.lit("_"),
        F.substring(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256), 1, 16),
    )


def normalize_query(c: Column) -> Column:
    """Lower, squeeze white space, drop symbols and ``_``, strip - in this order."""
    squeezed = F.regexp_replace(F.lower(c), f"{WS}+", " ")
    return strip(F.regexp_replace(squeezed, rf"[^\p{{L}}\p{{N}}{SPACE}]", ""))


def _unicode_escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_string(c: Column) -> Column:
    """JSON string literal with every non-ASCII character escaped."""

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        astral = code - 0x10000
        return (
            F.when(ch == '"', F.lit('\\"'))
            .when(ch == "\\", F.lit("\\\\"))
            .when(ch == "\n", F.lit("\\n"))
            .when(ch == "\r", F.lit("\\r"))
            .when(ch == "\t", F.lit("\\t"))
            .when(ch == "\b", F.lit("\\b"))
            .when(ch == "\f", F.lit("\\f"))
            .when(
                code > 0xFFFF,
                F.concat(
                    _unicode_escape(F.shiftright(astral, 10) + 0xD800),
                    _unicode_escape(astral.bitwiseAND(F.lit(0x3FF)) + 0xDC00),
                ),
            )
            .when((code < 32) | (code > 126), _unicode_escape(code))
            .otherwise(ch)
        )

    plain = c.rlike(r'^[ !#-\[\]-~]*$')
    escaped = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(.)"), F.lit(1)), one), "")
    # chr(127) is printed as it is by JSON writers
    escaped = F.replace(escaped, F.lit("\\u007f"), F.lit("\x7f"))
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(escaped), F.lit('"'))


def filters_json(filters: Column) -> Column:
    """``map<string,string>`` as JSON with sorted keys; empty or null becomes ''."""
    pairs = F.transform(
        F.array_sort(F.map_entries(filters)),
        lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])),
    )
    body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.when(filters.isNull() | (F.size(filters) == 0), "").otherwise(body)


def query_key(
    query: Column, collection: Column, top_k: Column, rerank: Column, use_hybrid: Column, filters: Column
) -> Column:
    """Key of a question and all parameters that change its answer."""

    def flag(c: Column) -> Column:
        return F.when(c, "True").otherwise("False")

    params = F.concat_ws(
        ":",
        F.lit(QUERY_KEY_VERSION),
        normalize_query(query),
        collection,
        top_k.cast("string"),
        flag(rerank),
        flag(use_hybrid),
        filters_json(filters),
    )
    return F.concat(F.lit(QUERY_KEY_PREFIX), F.sha2(params.cast("binary"), 256))


def escape_controls(c: Column) -> Column:
    """Show control characters as visible escapes so a log line stays one line."""
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = c
    for code in [*range(32), 127]:
        ch = chr(code)
        out = F.replace(out, F.lit(ch), F.lit(named.get(ch, f"\\x{code:02x}")))
    # most values hold no control character: test once, then skip the 33 passes
    return F.when(c.rlike(r"[\x00-\x1f\x7f]"), out).otherwise(c)


def guarded_input(c: Column, max_length: int = 10_000) -> tuple[Column, Column]:
    """Stripped value, or null with a reason when longer than ``max_length``."""
    too_long = F.length(c) > max_length
    reason = F.when(too_long, F.format_string(f"Input too long (max {max_length} chars, got %d)", F.length(c)))
    return F.when(~too_long, strip(c)), reason


def is_email(c: Column) -> Column:
    """Anchored e-mail shape; null is not an address (P10)."""
    return F.coalesce(c.rlike(EMAIL_ADDRESS), F.lit(False))


def preview(c: Column, always_dots: bool = False) -> Column:
    """First 200 characters; dots only when cut, or always."""
    cut = F.concat(F.substring(c, 1, PREVIEW_CHARS), F.lit("..."))
    return cut if always_dots else F.when(F.length(c) > PREVIEW_CHARS, cut).otherwise(c)


def prompt(question: Column, context: Column) -> Column:
    """Fixed prompt text around context and question."""
    head, rest = PROMPT_TEMPLATE.split("<CONTEXT>")
    middle, tail = rest.split("<QUESTION>")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def encrypt(c: Column, key: Column) -> Column:
    """AES-256-GCM with a random nonce, base64 text."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    """Plain text, or null when key or ciphertext is wrong."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
