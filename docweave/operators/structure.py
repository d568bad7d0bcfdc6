"""Tables, charts, headers, code, lists, links and sections of text.

Each document is one row, so its line array is worked on inside the row:
nothing here shuffles, however many lines a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.binding import let
from docweave.functions.text import SPACE, WS, strip

# --- fixed values -------------------------------------------------------------
CHART_PATTERNS = [
    rf"(?:figure|chart|graph|plot){WS}+(\p{{Nd}}+)",
    rf"(?:bar|line|pie|scatter){WS}+(?:chart|graph|plot)",
    rf"as{WS}+(?:shown|displayed|depicted){WS}+in{WS}+(?:figure|chart)",
]
CHART_TYPES = ["bar", "line", "pie"]
LIST_ITEM = rf"^{WS}*[-*+]{WS}+|^{WS}*\p{{Nd}}+\.{WS}+"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
SEPARATOR_LINE = rf"^[{SPACE}\-\+|]+$"
PRELUDE_TITLE = "Introduction"
# ------------------------------------------------------------------------------
# every chart pattern needs one of these words; looking for them first is cheap
CHART_WORDS = ["figure", "chart", "graph", "plot"]
# a text without such a line holds no table and is not taken apart
ANY_SEPARATOR = rf"(?m)^[{SPACE}\-\+|]*[\-\+|][{SPACE}\-\+|]*$"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


# ---- tables --------------------------------------------------------------------


def is_row_like(line: Column) -> Column:
    """A stripped line with a pipe, a tab, or two spaces and three words."""
    words = F.size(F.filter(F.split(line, f"{WS}+"), lambda w: w != ""))
    return F.contains(line, F.lit("|")) | F.contains(line, F.lit("\t")) | (F.contains(line, F.lit("  ")) & (words >= 3))


def parse_row(line: Column) -> Column:
    """Cells of a row; empty cells are dropped at both ends and kept inside."""
    raw = (
        F.when(F.contains(line, F.lit("|")), F.split(line, r"\|", -1))
        .when(F.contains(line, F.lit("\t")), F.split(line, "\t", -1))
        .otherwise(F.split(line, f"{WS}{{2,}}", -1))
    )

    def trimmed(cells: Column) -> Column:
        # positions of filled cells; min and max skip the nulls of empty ones
        filled = F.transform(cells, lambda c, i: F.when(c != "", i))
        return let(
            F.struct(F.array_min(filled).alias("first"), F.array_max(filled).alias("last")),
            lambda at: F.when(
                at["first"].isNotNull(), F.slice(cells, at["first"] + 1, at["last"] - at["first"] + 1)
            ).otherwise(F.array().cast("array<string>")),
        )

    return let(F.transform(raw, strip), trimmed)


def tables_of(text: Column) -> Column:
    """``array<struct<line,headers,rows>>`` of the tables in a text.

    Every line becomes one letter: s separator, b separator that also looks
    like a row, r other row, dot otherwise. A table is then a separator behind
    a row and before a run of rows; matches and the gaps between them give the
    line numbers.
    """
    pattern = "(?<=[rb])[sb][rb]+"

    def letter(line: Column) -> Column:
        separator, row = line.rlike(SEPARATOR_LINE), is_row_like(line)
        return F.when(separator & row, "b").when(separator, "s").when(row, "r").otherwise(".")

    def spans(letters: Column) -> Column:
        # separator positions: all gaps so far plus all earlier matches
        matches = F.regexp_extract_all(letters, F.lit(f"({pattern})"), F.lit(1))
        # one more gap than matches: the text behind the last match belongs to none
        pairs = F.filter(
            F.arrays_zip(F.split(letters, pattern, -1).alias("gap"), matches.alias("match")),
            lambda m: m["match"].isNotNull(),
        )
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<sep:int,len:int>>").alias("out")),
            lambda acc, m: F.struct(
                (acc["pos"] + F.length(m["gap"]) + F.length(m["match"])).alias("pos"),
                F.array_append(
                    acc["out"],
                    F.struct((acc["pos"] + F.length(m["gap"])).alias("sep"), F.length(m["match"]).alias("len")),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def tables(lines: Column) -> Column:
        return F.transform(
            let(F.array_join(F.transform(lines, letter), ""), spans),
            lambda s: F.struct(
                (s["sep"] - 1).alias("line"),
                parse_row(F.get(lines, s["sep"] - 1)).alias("headers"),
                F.transform(F.slice(lines, s["sep"] + 2, s["len"] - 1), parse_row).alias("rows"),
            ),
        )

    none = F.array().cast("array<struct<line:int,headers:array<string>,rows:array<array<string>>>>")
    return F.when(text.rlike(ANY_SEPARATOR), let(F.transform(lines_of(text), strip), tables)).otherwise(none)


def _padded(row: Column, headers: Column) -> Column:
    missing = F.greatest(F.size(headers) - F.size(row), F.lit(0))
    return F.concat(row, F.array_repeat(F.lit(""), missing))


def _pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """Markdown text; '' when headers or rows are missing."""
    body = F.array_join(
        F.concat(
            F.array(_pipe_row(headers), _pipe_row(F.array_repeat(F.lit("---"), F.size(headers)))),
            F.transform(rows, lambda r: _pipe_row(_padded(r, headers))),
        ),
        "\n",
    )
    if caption is not None:
        title = F.concat(F.lit("**Table: "), caption, F.lit("**\n\n"))
        body = F.concat(F.when(F.coalesce(caption, F.lit("")) != "", title).otherwise(""), body)
    return F.when((F.size(headers) > 0) & (F.size(rows) > 0), body).otherwise("")


def table_csv(headers: Column, rows: Column) -> Column:
    """CSV text: CRLF line ends, quotes only where needed (T4)."""

    def cell(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[",\r\n]'), quoted).otherwise(c)

    def line(cells: Column) -> Column:
        # a lone empty cell is quoted so that its line is not blank
        lone = (F.size(cells) == 1) & (F.get(cells, F.lit(0)) == "")
        return F.concat(F.when(lone, '""').otherwise(F.array_join(F.transform(cells, cell), ",")), F.lit("\r\n"))

    head = F.when(F.size(headers) > 0, line(headers)).otherwise("")
    return F.concat(head, F.array_join(F.transform(rows, line), ""))


def table_records(headers: Column, rows: Column) -> Column:
    """Rows as maps keyed by header; ``col_i`` when there is no header (T5).

    Of equal headers the last cell wins.
    """

    def as_map(pairs: Column) -> Column:
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(last)

    def keyed(row: Column) -> Column:
        cells = F.slice(_padded(row, headers), F.lit(1), F.size(headers))
        return let(F.zip_with(headers, cells, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), as_map)

    def numbered(row: Column) -> Column:
        return F.map_from_arrays(F.transform(row, lambda c, i: F.concat(F.lit("col_"), i.cast("string"))), row)

    return F.transform(rows, lambda r: F.when(F.size(headers) > 0, keyed(r)).otherwise(numbered(r)))


# ---- charts and full text --------------------------------------------------------


def charts_of(text: Column) -> Column:
    """``array<struct<line,description,chart_type>>``, one hit per line at most."""

    def one(line: Column, i: Column) -> Column:
        low = F.lower(line)
        worded, hit = F.lit(False), F.lit(False)
        for word in CHART_WORDS:
            worded = worded | F.contains(low, F.lit(word))
        for pattern in CHART_PATTERNS:
            hit = hit | low.rlike(pattern)
        kind = F.lit(None).cast("string")
        for name in reversed(CHART_TYPES):
            kind = F.when(F.contains(low, F.lit(name)), name).otherwise(kind)
        return F.when(worded & hit, F.struct(i.alias("line"), strip(line).alias("description"), kind.alias("chart_type")))

    return F.filter(F.transform(lines_of(text), one), lambda c: c.isNotNull())


def full_text(text: Column, tables: Column, charts: Column) -> Column:
    """Text, its tables as Markdown, and its list of charts."""
    blocks = F.transform(
        tables,
        lambda t, i: F.concat(
            F.lit("\n\nTable "),
            (i + 1).cast("string"),
            F.lit(":\n"),
            table_markdown(t["headers"], t["rows"]),
            F.lit("\n"),
        ),
    )
    listed = F.concat(
        F.array(F.lit("\n\nCharts and Figures:\n")),
        F.transform(charts, lambda c: F.concat(F.lit("- "), c["description"])),
    )
    tail = F.when(F.size(charts) > 0, listed).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(text), blocks, tail), "\n")


def parse_summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of tables and charts; ``tables_extracted`` only when there are any."""
    parsed = docs.withColumn("total_tables", F.size(tables_of(F.col(text)))).withColumn(
        "total_charts", F.size(charts_of(F.col(text)))
    )
    return parsed.withColumn("tables_extracted", F.when(F.col("total_tables") > 0, F.col("total_tables")))


# ---- Markdown structure -------------------------------------------------------------


def _header_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#+)", 1))


def _header_title(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^#+", ""))


def headers_of(text: Column) -> Column:
    """``array<struct<line,level,title>>``; lines in code fences count too."""
    return F.filter(
        F.transform(
            lines_of(text),
            lambda line, i: F.when(
                F.startswith(line, F.lit("#")),
                F.struct(i.alias("line"), _header_level(line).alias("level"), _header_title(line).alias("title")),
            ),
        ),
        lambda h: h.isNotNull(),
    )


def code_blocks_of(text: Column) -> Column:
    """``array<struct<start,end,language>>``: odd fences open, even ones close."""
    fences = F.filter(
        F.transform(
            F.transform(lines_of(text), strip),
            lambda line, i: F.when(
                F.startswith(line, F.lit("```")),
                F.struct(i.alias("line"), strip(F.substr(line, F.lit(4))).alias("language")),
            ),
        ),
        lambda f: f.isNotNull(),
    )

    def pairs(marks: Column) -> Column:
        opening = F.filter(marks, lambda _f, i: (i % 2 == 0) & (i + 1 < F.size(marks)))
        return F.transform(
            opening,
            lambda f, i: F.struct(
                f["line"].alias("start"), F.get(marks, i * 2 + 1)["line"].alias("end"), f["language"].alias("language")
            ),
        )

    return let(fences, pairs)


def list_items_of(text: Column) -> Column:
    """``array<struct<line,content>>`` of bullet and numbered items."""
    return F.filter(
        F.transform(
            lines_of(text),
            lambda line, i: F.when(line.rlike(LIST_ITEM), F.struct(i.alias("line"), strip(line).alias("content"))),
        ),
        lambda x: x.isNotNull(),
    )


def links_of(text: Column) -> Column:
    """``array<struct<line,text,url>>``, all links of a line in order."""
    return F.flatten(
        F.transform(
            lines_of(text),
            lambda line, i: F.zip_with(
                F.regexp_extract_all(line, F.lit(LINK), F.lit(1)),
                F.regexp_extract_all(line, F.lit(LINK), F.lit(2)),
                lambda t, u: F.struct(i.alias("line"), t.alias("text"), u.alias("url")),
            ),
        )
    )


def sections_of(text: Column) -> Column:
    """``array<struct<title,level,content>>``; a section without any line is dropped."""
    prelude = F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("level"), F.lit(PRELUDE_TITLE).alias("title")))

    def cut(lines: Column, marks: Column) -> Column:
        spans = F.transform(
            marks,
            lambda m, i: F.struct(
                m["title"].alias("title"),
                m["level"].alias("level"),
                (m["line"] + 1).alias("first"),
                (F.coalesce(F.get(marks, i + 1)["line"], F.size(lines)) - m["line"] - 1).alias("count"),
            ),
        )
        return F.transform(
            F.filter(spans, lambda s: s["count"] > 0),
            lambda s: F.struct(
                s["title"].alias("title"),
                s["level"].alias("level"),
                strip(F.array_join(F.slice(lines, s["first"] + 1, s["count"]), "\n")).alias("content"),
            ),
        )

    return let(lines_of(text), lambda lines: let(F.concat(prelude, headers_of(text)), lambda marks: cut(lines, marks)))


def unnest(docs: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per array element, its fields as columns, behind the kept columns."""
    # an outer explode: the plain one adds a filter that parses every text a second time
    rows = docs.select(*keep, F.posexplode_outer(items).alias("_pos", "_item")).where("_pos IS NOT NULL")
    return rows.select(*keep, "_item.*")
