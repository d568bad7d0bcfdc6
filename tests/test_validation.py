import re

import pytest
from pyspark.sql import functions as F

from docweave.operators import validation as va


def check(spark, content, metadata, opt=va.DEFAULT):
    df = spark.createDataFrame([(content, metadata)], "content string, metadata map<string,string>")
    r = va.validate(df, opt=opt).first()
    return r.is_valid, [e["code"] for e in r.errors], list(r.warnings)


META = {"source": "s", "file_type": "txt", "filename": "f"}
GOOD = "A perfectly ordinary sentence that is long enough to be accepted here. " * 2


def test_valid_document(spark):
    assert check(spark, GOOD, META) == (True, [], [])


@pytest.mark.parametrize(
    "content,codes",
    [
        (None, ["EMPTY_CONTENT"]),
        (" \n ", ["EMPTY_CONTENT"]),
        ("hi", ["CONTENT_TOO_SHORT"]),
        (GOOD + "<script>\nalert(1)\n</script>", ["SECURITY_XSS"]),
        (GOOD + " onclick = x", ["SECURITY_XSS"]),
        (GOOD + " union\nall SELECT", ["SECURITY_SQL_INJECTION"]),
        (GOOD + " a OR 1 = 1", ["SECURITY_SQL_INJECTION"]),
        (GOOD + " ../x", ["SECURITY_PATH_TRAVERSAL"]),
        (GOOD + " a | b", ["SECURITY_COMMAND_INJECTION"]),
        (GOOD + " `a\nb`", []),
        (GOOD + " ; drop ", ["SECURITY_SQL_INJECTION", "SECURITY_COMMAND_INJECTION"]),
    ],
)
def test_content_and_security(spark, content, codes):
    assert check(spark, content, META)[1] == codes


def test_too_long(spark):
    opt = va.ValidationOptions(max_length=60)
    assert check(spark, GOOD, META, opt)[1] == ["CONTENT_TOO_LONG"]


def test_pii_warnings_and_strict_errors(spark):
    text = GOOD + "Write to a@b.co or c@d.org, call 555-123-4567, ssn 123-45-6789, card 1234-5678-9012-3456."
    valid, codes, warnings = check(spark, text, META)
    assert valid and not codes
    assert warnings == [
        "PII_DETECTION: Found 2 email address(es)",
        "PII_DETECTION: Found 1 phone number(s)",
        "PII_DETECTION: Found SSN pattern(s)",
        "PII_DETECTION: Found credit card pattern(s)",
    ]
    _valid, codes, _w = check(spark, text, META, va.STRICT)
    assert codes == ["PII_EMAIL", "PII_PHONE", "PII_SSN", "PII_CREDIT_CARD"] + ["STRICT_MODE_WARNING"] * 4
    assert check(spark, text + "<script></script>", META, va.PERMISSIVE) == (True, [], [])


@pytest.mark.parametrize(
    "metadata,codes,warnings",
    [
        (None, ["MISSING_METADATA"], []),
        ({}, ["MISSING_METADATA"], []),
        ({"file_type": "txt", "filename": "f"}, ["MISSING_METADATA"], []),
        ({"source": "s"}, [], ["Metadata missing recommended field: 'file_type'", "Metadata missing recommended field: 'filename'"]),
        (META | {"file_type": "EXE"}, ["UNSUPPORTED_FORMAT"], []),
        (META | {"file_type": "PDF"}, [], ["PDF metadata missing page number"]),
        (META | {"file_type": "pdf", "page": "0"}, ["INVALID_METADATA"], []),
        (META | {"file_type": "pdf", "page": "two"}, ["INVALID_METADATA"], []),
        (META | {"file_type": "pdf", "page": "3"}, [], []),
    ],
)
def test_metadata_and_format(spark, metadata, codes, warnings):
    assert check(spark, GOOD, metadata)[1:] == (codes, warnings)


def test_markdown_link_only_counts_in_markdown(spark):
    text = GOOD + "[x](VBScript:run)"
    assert check(spark, text, META)[1] == []
    assert check(spark, text, META | {"file_type": "md"})[1] == ["MARKDOWN_DANGEROUS_LINK"]


REQUESTS = {
    "what is the leave policy": None,
    "1' UNION\nSELECT x": "sql",
    "drop the old TABLE": "sql",
    "a -- b": "sql",
    "/* x\n y */": "sql",
    "or maybe 1 = 1": "sql",
    "<SCRIPT src=x>\n</script>": "xss",
    "javascript:alert(1)": "xss",
    "onload =1": "xss",
    "..\\windows": "path",
    "ab%2f": "path",
    "%2f": None,
    "a; ls": "command",
    "echo > /tmp": "command",
    "union of workers": None,
    "select after union": None,
}


def test_request_rules(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*REQUESTS, None])], "i int, v string")
    got = [r.first_rule for r in va.with_request_rules(df, "v").orderBy("i").collect()]
    assert got == [*REQUESTS.values(), None]


def test_linear_patterns_mean_the_same(spark):
    """The one-pass form of ``head.*tail`` agrees with the plain search."""
    import itertools
    import random

    rng = random.Random(1)
    words = ["or", "1=1", "union", "select", ";", "drop", "'", "--", "<script", ">", "</script>", "/*", "*/", "\n", "x", "nor"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts += ["".join(p) for p in itertools.permutations(["/*", "*/", "';", "--"], 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rules = [*va.REQUEST_RULES["sql"], *va.REQUEST_RULES["xss"], *va.DOCUMENT_RULES["SECURITY_SQL_INJECTION"]]
    changed = [p for p in rules if va._linear(p) != p]
    assert len(changed) >= 10
    for p in changed:
        rows = df.select(F.col("t").rlike(p).alias("a"), F.col("t").rlike(va._linear(p)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], p
    assert re.search("or", "nor")


def test_json_scan_walks_keys_values_and_depth(spark):
    payloads = [
        '{"a": {"b": ["ok", "<script></script>"]}, "n": 5}',
        '{"x <iframe": "fine"}',
        '"drop table t"',
        "[[[[[1]]]]]",
        "not json",
        "{}",
        '{"k <embed": {"p": 1, "q": 2}}',
        '{"a":{"b":{"c":{"d":{"e":{"f":{"g":["<script>x</script>"]}}}}}}}',
        '{"a":"ok","b":"<iframe","a":"<iframe"}',
        '{"b": NaN, "c":"<iframe"}',
        "broken <iframe {",
        "[" * 100_000,
        None,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, j string")
    got = sorted(tuple(r) for r in va.scan_json(df, "id", "j").collect())
    assert got == [
        (0, "a.b[1]", "xss"),
        (1, "x <iframe#key", "xss"),
        (2, "", "sql"),
        (4, "", "unparsed"),
        (6, "k <embed#key", "xss"),
        (7, "a.b.c.d.e.f.g[0]", "xss"),
        (8, "a", "xss"),
        (8, "b", "xss"),
        (9, "c", "xss"),
        (10, "", "unparsed"),
        (10, "", "xss"),
        (11, "", "unparsed"),
    ]


def test_query_guards(spark):
    rows = [("q", 5, 200), (" ", 5, 200), ("x" * 1001, 5, 200), ("q", 0, 200), ("q", 21, 200), ("q", 5, 99), (None, 5, 200)]
    df = spark.createDataFrame(rows, "q string, k int, m int")
    got = [r[0] for r in df.select(va.query_reject_reason(F.col("q"), F.col("k"), F.col("m"))).collect()]
    assert [g and g.split(" ")[0] for g in got] == [None, "Query", "Query", "top_k", "top_k", "max_tokens", "Query"]


def test_split_and_summary(spark):
    df = spark.createDataFrame([("a", GOOD, META), ("b", "", META)], "source string, content string, metadata map<string,string>")
    checked = va.validate(df)
    good, report = va.split_valid(checked)
    assert [r.source for r in good.collect()] == ["a"]
    assert report.collect()[0].errors == ["[EMPTY_CONTENT] Document content is empty"]
    s = va.summary(checked).first()
    assert (s.total, s.valid, s.invalid, s.error_count) == (2, 1, 1, 1)


def test_vector_quality(spark):
    texts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "id int, embedding array<float>")
    r = va.vector_quality(texts, vectors, "id").first()
    assert (r.inputs, r.missing, r.empty, r.min_dim, r.max_dim) == (3, 1, 1, 0, 2)
