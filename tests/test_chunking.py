import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import chunking


def brute(text, size, overlap, seps, compat=False):
    """Plain statement of the rule, kept here only to compare with."""
    sep = next((s for s in seps if s in text), None)
    out = []
    if sep:
        cur = ""
        for part in text.split(sep):
            if cur and len(cur) + len(part) > size:
                out.append(cur.strip())
                tail = cur[-overlap:] if overlap or compat else ""
                cur = tail + sep + part
            else:
                cur = cur + sep + part if cur else part
        out += [cur.strip()] if cur else []
    if not out:
        windows = [text[i : i + size].strip() for i in range(0, len(text), size - overlap)]
        out = [w for w in windows if w]
    return out


def test_many_chunks_keep_their_order(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    got = spark.createDataFrame([(text,)], "t string").select(chunking.split_text(F.col("t"), 20, 3)).first()[0]
    assert len(got) > 2 * chunking.BLOCK_CHUNKS and got == brute(text, 20, 3, chunking.DEFAULT_SEPARATORS)


def texts():
    rng = random.Random(5)
    pieces = ["ab", "c", "", "long" * 9, "é", "東京", " ", "\n", "\n\n", ". ", "x. y", "\t"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["", "\n\n", "a" * 95]


@pytest.mark.parametrize(
    "size,overlap,seps,compat",
    [(30, 7, None, False), (10, 9, None, False), (25, 0, None, False), (25, 0, None, True), (20, 5, ["x", ". "], False)],
)
def test_split_text(spark, size, overlap, seps, compat):
    data = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    chunks = chunking.split_text(F.col("t"), size, overlap, seps, reference_compat=compat)
    got = [r[1] for r in df.select("i", chunks).orderBy("i").collect()]
    assert got == [brute(t, size, overlap, seps or chunking.DEFAULT_SEPARATORS, compat) for t in data]


def test_fixed_chunks_cover_text_without_separator(spark):
    text = "字" * 2500
    got = spark.createDataFrame([(text,)], "t string").select(chunking.split_text(F.col("t"))).first()[0]
    assert [len(c) for c in got] == [1000, 1000, 900, 100]


@pytest.mark.parametrize("size,overlap", [(100, 100), (100, 150), (10, -1)])
def test_sizes_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_sizes(size, overlap)


def test_request_limits():
    chunking.check_sizes(100, 0, request=True)
    for size, overlap in [(99, 0), (4001, 0), (1000, 501)]:
        with pytest.raises(ValueError):
            chunking.check_sizes(size, overlap, request=True)


def test_chunk_rows_inherit_columns(spark):
    docs = spark.createDataFrame([("d1", "s", "one two three", "f.txt")], "doc_id string, source string, content string, filename string")
    rows = chunking.chunk_documents(docs, size=7, overlap=2).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {(r.original_doc_id, r.source, r.filename, r.total_chunks) for r in rows} == {("d1", "s", "f.txt", len(rows))}
    assert len({r.chunk_id for r in rows}) == len(rows)
