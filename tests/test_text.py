import hashlib
import json
import re

from pyspark.sql import functions as F

from docweave.functions import text as tx


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[1] for r in rows.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


SAMPLES = ["  Hello,  World!! ", " Straße_x ", "東京 タワー 2024", "", "a\u001fb\u0085c", "ÀÉÎ\tõ\n\nü", "x" * 5]


def test_strip_and_tokens_follow_unicode(spark):
    assert column(spark, SAMPLES, tx.strip) == [s.strip() for s in SAMPLES]
    assert column(spark, SAMPLES, tx.tokens) == [re.findall(r"\w+", s.lower()) for s in SAMPLES]


def test_content_id(spark):
    rows = spark.createDataFrame([("s", "abc"), (None, "abc")], "source string, content string")
    got = [r[0] for r in rows.select(tx.content_id(F.col("source"), F.col("content"))).collect()]
    digest = hashlib.sha256(b"abc").hexdigest()[:16]
    assert got == [f"s_{digest}", f"unknown_{digest}"]


def test_normalize_query_keeps_double_spaces_and_scripts(spark):
    values = ["What IS  this?", "a - b", "snake_case", "東京タワー", "大阪城", " ! "]
    assert column(spark, values, tx.normalize_query) == ["what is this", "a  b", "snakecase", "東京タワー", "大阪城", ""]


def key_of(spark, query, filters=None, **kw):
    p = {"collection": "default", "top_k": 5, "rerank": True, "use_hybrid": True} | kw
    df = spark.createDataFrame([(query, filters)], "q string, f map<string,string>")
    key = tx.query_key(
        F.col("q"), F.lit(p["collection"]), F.lit(p["top_k"]), F.lit(p["rerank"]), F.lit(p["use_hybrid"]), F.col("f")
    )
    return df.select(key).first()[0]


def test_query_key_matches_its_definition(spark):
    filters = {"b": 'é"\\\n', "a": "\U0001f600x"}
    text = f"v2:what is this:docs:7:False:True:{json.dumps(filters, sort_keys=True)}"
    got = key_of(spark, "What is  this?", filters, collection="docs", top_k=7, rerank=False)
    assert got == "rag:" + hashlib.sha256(text.encode()).hexdigest()


def test_query_key_separates_parameters(spark):
    base = key_of(spark, "q one")
    assert key_of(spark, " Q  ONE? ") == base == key_of(spark, "q one", {})
    others = [
        key_of(spark, "q two"),
        key_of(spark, "q one", {"a": "b"}),
        key_of(spark, "q one", top_k=6),
        key_of(spark, "q one", rerank=False),
        key_of(spark, "q one", use_hybrid=False),
        key_of(spark, "q one", collection="x"),
    ]
    assert len({base, *others}) == 7


def test_escape_controls(spark):
    values = ["q\n2000-01-01 INFO admin", "a\rb\tc", "\x00\x1b\x7f", "plain"]
    assert column(spark, values, tx.escape_controls) == [
        "q\\n2000-01-01 INFO admin",
        "a\\rb\\tc",
        "\\x00\\x1b\\x7f",
        "plain",
    ]


def test_guarded_input(spark):
    rows = spark.createDataFrame([(" ok ",), ("x" * 11,), (None,)], "c string")
    value, reason = tx.guarded_input(F.col("c"), 10)
    got = [tuple(r) for r in rows.select(value, reason).collect()]
    assert got == [("ok", None), (None, "Input too long (max 10 chars, got 11)"), (None, None)]


def test_is_email(spark):
    values = ["a.b+c@x-y.org", "a@b", "a@b.c", "x a@b.co", None, "a@b.co"]
    assert column(spark, values, tx.is_email) == [True, False, False, False, False, True]


def test_preview(spark):
    values = ["x" * 200, "y" * 201]
    assert column(spark, values, tx.preview) == ["x" * 200, "y" * 200 + "..."]
    assert column(spark, values, lambda c: tx.preview(c, always_dots=True)) == ["x" * 200 + "...", "y" * 200 + "..."]


def test_prompt_places_context_and_question(spark):
    got = spark.range(1).select(tx.prompt(F.lit("why?"), F.lit("CTX"))).first()[0]
    assert got.startswith("You are a helpful AI assistant")
    assert "below:\n---\nCTX\n---\n" in got and got.endswith("Question: why?\n\nAnswer:")


def test_encryption_round_trip_and_tampering(spark):
    key = F.unhex(F.lit("ab" * 32))
    rows = spark.createDataFrame([("héllo",), ("",)], "c string")
    sealed = rows.select("c", tx.encrypt(F.col("c"), key).alias("e"))
    assert all(r.c == r.p for r in sealed.select("c", tx.decrypt(F.col("e"), key).alias("p")).collect())
    broken = F.concat(F.lit("AAAA"), F.substring("e", 5, 10_000))
    assert [r[0] for r in sealed.select(tx.decrypt(broken, key)).collect()] == [None, None]
