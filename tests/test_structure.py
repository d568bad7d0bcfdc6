import random
import re

from pyspark.sql import functions as F

from docweave.operators import structure as st


def one(spark, text, items):
    return spark.createDataFrame([(text,)], "t string").select(items(F.col("t"))).first()[0]


def row_like(line):
    return "|" in line or "\t" in line or ("  " in line and len(line.split()) >= 3)


def scan_tables(text):
    """Sequential statement of the table rule: (header line, first and last data line)."""
    lines, found, i = [x.strip() for x in text.split("\n")], [], 0
    while i < len(lines):
        if i > 0 and re.match(r"^[\s\-\+|]+\s*$", lines[i]) and row_like(lines[i - 1]):
            j = i + 1
            while j < len(lines) and row_like(lines[j]):
                j += 1
            if j > i + 1:
                found.append((i - 1, j - i - 1))
                i = j - 1
        i += 1
    return found


def test_tables_equal_sequential_scan(spark):
    rng = random.Random(3)
    kinds = ["| a | b |", "---", "|---|---|", "", "text", "a\tb", "x  y z", "- - |", "--  --  --", "+---+"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(t["line"], len(t["rows"])) for t in r.x] for r in df.select("i", st.tables_of(F.col("t")).alias("x")).collect()}
    assert got == {i: scan_tables(t) for i, t in enumerate(texts)}


def test_row_cells(spark):
    cases = {
        "| a | | b |": ["a", "", "b"],
        "|||": [],
        "a | b": ["a", "b"],
        "\tx\t\ty\t": ["x", "", "y"],
        "one  two   three": ["one", "two", "three"],
        "": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r[1] for r in df.select("i", st.parse_row(F.col("t"))).orderBy("i").collect()]
    assert got == list(cases.values())


TABLE = "h1 | h2 | h3\n---|---|---\na | b\nc | d | e | f\n"


def test_table_exports(spark):
    df = spark.createDataFrame([(TABLE,)], "t string").select(F.explode(st.tables_of(F.col("t"))).alias("t")).select("t.*")
    h, r = F.col("headers"), F.col("rows")
    out = df.select(
        st.table_markdown(h, r).alias("md"),
        st.table_markdown(h, r, F.lit("Cap")).alias("cap"),
        st.table_csv(h, r).alias("csv"),
        st.table_records(h, r).alias("rec"),
        st.table_records(F.array().cast("array<string>"), r).alias("bare"),
        st.table_markdown(h, F.array().cast("array<array<string>>")).alias("empty"),
    ).first()
    assert out.md == "| h1 | h2 | h3 |\n| --- | --- | --- |\n| a | b |  |\n| c | d | e | f |"
    assert out.cap == "**Table: Cap**\n\n" + out.md
    assert out.csv == "h1,h2,h3\r\na,b\r\nc,d,e,f\r\n"
    assert out.rec == [{"h1": "a", "h2": "b", "h3": ""}, {"h1": "c", "h2": "d", "h3": "e"}]
    assert out.bare == [{"col_0": "a", "col_1": "b"}, {"col_0": "c", "col_1": "d", "col_2": "e", "col_3": "f"}]
    assert out.empty == ""


def test_repeated_header_keeps_last_cell(spark):
    df = spark.createDataFrame([(["x", "x"], [["1", "2"]])], "h array<string>, r array<array<string>>")
    assert df.select(st.table_records(F.col("h"), F.col("r"))).first()[0] == [{"x": "2"}]


def test_csv_quotes(spark):
    df = spark.createDataFrame([(["a,b", 'q"'], [["", "x\ny"], [""]])], "h array<string>, r array<array<string>>")
    assert df.select(st.table_csv(F.col("h"), F.col("r"))).first()[0] == '"a,b","q"""\r\n,"x\ny"\r\n""\r\n'


def test_charts(spark):
    text = "Figure 1 shows\nthe barometer graph 7\nsee line chart\npie plot here\nchart without number\nas shown in figure\nplot ٣"
    got = [(c["line"], c["chart_type"]) for c in one(spark, text, st.charts_of)]
    assert got == [(0, None), (1, "bar"), (2, "line"), (3, "pie"), (5, None), (6, None)]


def test_markdown_structure(spark):
    text = (
        "intro\n# One\n\n```py\n# in code\n```\n* a\n + b\n1. c\n[x](u) and [y](v)\n##Two\n### \nend\n```open"
    )
    assert [(h["line"], h["level"], h["title"]) for h in one(spark, text, st.headers_of)] == [
        (1, 1, "One"), (4, 1, "in code"), (10, 2, "Two"), (11, 3, ""),
    ]
    assert [tuple(b) for b in one(spark, text, st.code_blocks_of)] == [(3, 5, "py")]
    assert [(x["line"], x["content"]) for x in one(spark, text, st.list_items_of)] == [(6, "* a"), (7, "+ b"), (8, "1. c")]
    assert [tuple(x) for x in one(spark, text, st.links_of)] == [(9, "x", "u"), (9, "y", "v")]
    sections = [(s["title"], s["level"], s["content"]) for s in one(spark, text, st.sections_of)]
    assert sections == [
        ("Introduction", 0, "intro"),
        ("One", 1, "```py"),
        ("in code", 1, "```\n* a\n + b\n1. c\n[x](u) and [y](v)"),
        ("", 3, "end\n```open"),
    ]


def test_section_with_one_blank_line_stays(spark):
    got = [(s["title"], s["content"]) for s in one(spark, "# A\n\n# B", st.sections_of)]
    assert got == [("A", "")]


def test_summary_and_full_text(spark):
    docs = spark.createDataFrame([(1, TABLE + "Figure 2"), (2, "nothing")], "id int, text string")
    got = {r.id: (r.total_tables, r.total_charts, r.tables_extracted) for r in st.parse_summary(docs).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, None)}
    full = docs.select("id", st.full_text(F.col("text"), st.tables_of(F.col("text")), st.charts_of(F.col("text"))).alias("f"))
    texts = {r.id: r.f for r in full.collect()}
    assert texts[2] == "nothing"
    assert texts[1].startswith(TABLE) and texts[1].endswith("\n\nCharts and Figures:\n\n- Figure 2")


def test_structure_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, TABLE)], "doc_id int, text string")
    for items in (st.tables_of, st.charts_of, st.headers_of, st.code_blocks_of, st.links_of, st.sections_of):
        plan = st.unnest(docs, items(F.col("text")), "doc_id")._jdf.queryExecution().toString()
        assert "Exchange" not in plan
