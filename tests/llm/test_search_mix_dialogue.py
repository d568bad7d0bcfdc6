"""Ranked search, source mixing and conversation repair against plain versions."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import dialogue, lexical, mixing, warc
from tests.conftest import SMALL
from tests.llm import brute

EXTRA = ["query", "_item", "length", "terms", "_row", "_ix", "block", "size", "_hash", "target", "open", "part", "seq", "fault", "_kind"]


def docs_frame(spark, rows):
    """``rows`` of (doc_id, text, source) with clashing columns."""
    ddl = "doc_id long, text string, source string, `a.b` string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, "x", *["x"] * len(EXTRA)) for r in rows], ddl)


# ---- ranked search


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" if i % 7 else f"Ö{i}" for i in range(300)]
    text = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.6)))].upper() if rng.random() < 0.2 else words[min(299, int(rng.paretovariate(0.6)))] for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60)), "s") for i in range(150)]
    rows += [(200 + i, rows[7][1], "s") for i in range(30)]  # ties beyond the limit
    rows += [(300, None, "s"), (301, "", "s"), (302, ".,;", "s"), (303, "w1 " * 60_000 + "w5", "s")]
    items = [("a", text(20)), ("b", rows[7][1]), ("c", "w1 w1 w2"), ("d", None), ("e", ""), ("f", "nowhere"), ("b", rows[9][1])]
    return rows, items


def test_search_equals_brute_force(spark, corpus):
    rows, items = corpus
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id string, text string, query string")
    want = sorted(brute.ranked([(i, t) for i, t in items if t], [r[:2] for r in rows]))
    for bucket_rows in (16, 4096):
        got = lexical.ranked_search(docs_frame(spark, rows), asked, bucket_rows=bucket_rows)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want


def test_search_in_blocks_and_on_empty_tables(spark, corpus, monkeypatch):
    rows, items = corpus
    asked = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_frame(spark, rows)
    whole = sorted(map(tuple, lexical.ranked_search(docs, asked).collect()))
    monkeypatch.setattr(lexical, "QUERY_BYTES", 60)
    assert sorted(map(tuple, lexical.ranked_search(docs, asked).collect())) == whole
    monkeypatch.undo()
    assert lexical.ranked_search(docs.limit(0), asked).collect() == []
    assert lexical.ranked_search(docs, asked.limit(0)).collect() == []
    assert lexical.ranked_search(docs, asked.where("item_id = 'd'")).collect() == []


def test_bounds_skip_most_pairs(spark):
    """Prose of four languages: a question's terms hardly reach beyond its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    index = lexical.Index(docs, items, bucket_rows=32)
    index.search().collect()
    assert 0 < index.scored() < 0.1 * docs.count() * len(items)


def test_slices_of_a_long_text_cut_between_terms(monkeypatch):
    raw = ("Ab cd-é9 " * 50).encode()
    whole = [t for some in lexical.terms(raw) for t in some]
    monkeypatch.setattr(lexical, "SLICE_BYTES", 7)
    assert [t for some in lexical.terms(raw) for t in some] == whole and whole[:3] == [b"ab", b"cd", "é9".encode()]


# ---- mixing


def test_targets_equal_the_plain_procedure():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, rng.randrange(1, 50), rng.randrange(1, 10_000)]) for _ in range(rng.randrange(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        got, want = mixing.shares(sizes, weights), brute.mix_targets(sizes, weights)
        assert np.allclose([float(g) for g in got], want)
        assert sum(got) == sum(sizes) and all(g <= 3 * s for g, s in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    image = mixing.permuted(np.arange(n), n, 42)
    assert sorted(image.tolist()) == list(range(n))
    assert n < 64 or image.tolist() != mixing.permuted(np.arange(n), n, 43).tolist() != list(range(n))


def test_tree_keeps_quotas_and_ranks_are_disjoint():
    quotas, shards = np.array([1000, 0, 17, 303]), 13
    total = int(quotas.sum())
    leaves = list(mixing.split((0, shards, quotas, np.zeros(4, np.int64)), total, shards, seed=3))
    assert [leaf[0] for leaf in leaves] == list(range(shards))
    assert sum(leaf[2] for leaf in leaves).tolist() == quotas.tolist()
    assert max(leaf[2].sum() for leaf in leaves) - min(leaf[2].sum() for leaf in leaves) <= 1
    for s in range(4):
        ranks = list(itertools.chain.from_iterable(range(leaf[3][s], leaf[3][s] + leaf[2][s]) for leaf in leaves))
        assert ranks == list(range(quotas[s]))
    inner = list(mixing.split((0, shards, quotas, np.zeros(4, np.int64)), total, shards, 3, width=4))
    again = [leaf for node in inner for leaf in mixing.split(node, total, shards, 3)]
    assert all((a[2] == b[2]).all() and (a[3] == b[3]).all() for a, b in zip(leaves, again, strict=True))


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 40)), "big") for i in range(120)]
    rows += [(200 + i, text(rng.randrange(1, 20)), "Small") for i in range(9)]
    rows += [(300 + i, text(30), None) for i in range(20)] + [(400, text(20_000), "long"), (401, text(3), "long")]
    rows += [(500, None, "big"), (501, "", "void"), (502, " \t\n", "void"), (503, "x y", ""), (None, "a b c", "big")]
    rows += [rows[0], rows[0]]  # repeated rows
    return rows


def test_mix_meets_the_contract(spark, sources):
    got = [r.asDict() for r in mixing.mix(docs_frame(spark, sources)).taken().collect()]
    size = lambda t: len((t or "").split())
    assert sorted((str(g["doc_id"]), g["size"]) for g in got) == sorted((str(i), size(t)) for i, t, _ in sources)
    totals = {}
    for _, t, s in sources:
        totals[s] = totals.get(s, 0) + size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, brute.mix_targets([totals[n] for n in names], [1 + i % 3 for i in range(len(names))])))
    for name in names:
        mine = [g for g in got if g["source"] == name]
        assert all(g["source_size"] == totals[name] for g in mine)
        assert all(abs(g["target"] - targets[name]) < 1e-6 for g in mine)
        assert abs(sum(g["taken"] for g in mine) - targets[name]) <= 0.002 * targets[name] + 1
        assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)


def test_mixed_texts_are_the_drawn_words(spark, sources):
    docs = docs_frame(spark, sources)
    taken = {}
    for r in mixing.mix(docs, shard_blocks=64).taken().collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    texts = {i: (t or "").split() for i, t, _ in sources}
    mixed = mixing.mixed_texts(docs, shard_blocks=64).collect()
    for r in mixed:
        words = r["text"].split()
        assert words == texts[r["doc_id"]][r["first_word"] : r["first_word"] + len(words)]
    counts = {}
    for r in mixed:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + len(r["text"].split())
    assert counts == {k: v for k, v in taken.items() if v}
    places = {}
    for r in mixed:
        places.setdefault((r["shard"], r["position"]), set()).add(r["epoch"])
    assert all(len(v) == 1 for v in places.values()) and len({s for s, _ in places}) > 10
    for shard in {s for s, _ in places}:
        positions = sorted(p for s, p in places if s == shard)
        assert positions == list(range(len(positions)))


def test_mix_again_and_empty(spark, sources):
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    first = sorted(map(key, mixing.mix(docs_frame(spark, sources)).taken().collect()))
    assert first == sorted(map(key, mixing.mix(docs_frame(spark, sources[::-1]).repartition(5)).taken().collect()))
    assert mixing.mix(docs_frame(spark, sources).limit(0)).taken().collect() == []
    blank = mixing.mix(docs_frame(spark, [(1, None, "a"), (2, " ", None)])).taken().collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0), (0.0, 0)]


# ---- conversations


def talk(rng: random.Random, conv, n: int):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", " ", ""]
    texts = ["Yes.", "No.", "Why?", "", " \n", "cut off", "ends here. \t", None]
    turns = [None if rng.random() < 0.05 else t for t in range(n)]
    return [(conv, t, rng.choice(roles if rng.random() < 0.4 else ["user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}.") for t in turns]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randrange(1, 14))]
    rows += [(None, t, role, "Hi.") for t, role in enumerate(["user", "assistant", None])]
    rows += [(100, None, "user", "Same."), (100, None, "user", "Same."), (100, 5, "assistant", "Ok.")]
    rows += [(101, t, "user" if t % 2 == 0 else "assistant", f"Long {t}.") for t in range(3000)]
    rows += [(102, 1, "assistant", "very long " * 50_000 + ".")]
    dropped = next(c for c in range(1000, 2000) if brute.zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")]


CONVERSATIONS = "conv_id long, turn long, role string, text string, open string, part string, `a.b` string"


@pytest.mark.parametrize(("chunk_rows", "chunk_bytes"), [(3, 1 << 20), (64, 200), (1024, 4 << 20)])
def test_repair_equals_brute_force(spark, talks, chunk_rows, chunk_bytes):
    shuffled = random.Random(0).sample(talks, len(talks))
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in shuffled], CONVERSATIONS).repartition(3)
    got = dialogue.repair(dialogue.damage(frame), chunk_rows, chunk_bytes).collect()
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got}
    want = brute.conversations(talks)
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_repair_of_an_empty_table(spark):
    assert dialogue.repair(dialogue.damage(spark.createDataFrame([], CONVERSATIONS))).collect() == []


def test_query_equals_brute_force(spark):
    from docweave.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in QUERIES["op13_conversation_repair"](spark, SMALL).collect()}
    assert got == brute.conversations(rows)


def test_chunks_converge_by_rank():
    """A rerun from another end vector stops early, and gives what a full run gives."""
    rng, steps = random.Random(2), dialogue.Steps()
    symbols = bytes(rng.choice([4, 8, 4, 8, 0, 12, 5, 7, 16]) for _ in range(400))
    old = dialogue.SPECULATIVE
    _, start, total = dialogue.run_back(steps, symbols, old)
    for new in [(0, 4, 2, 0), (2, 2, 0, 1), (3, 2, 1, 0)]:
        _, want, sums = dialogue.run_back(steps, symbols, new)
        assert dialogue.rerun_back(steps, symbols, old, new, start, total) == (want, sums)
        walked = 0
        a, b = old, new
        while a != b:
            walked += 1
            a, b = steps.back(a, symbols[-walked])[0], steps.back(b, symbols[-walked])[0]
        assert walked < 20


def test_few_chunks_run_again(spark):
    """After the first fix-up pass almost every chunk of one long conversation is settled."""
    rng = random.Random(6)
    rows = [(i, 7, bytes(rng.choice([4, 8, 4, 8, 0, 12, 5, 7]) for _ in range(50)), 50) for i in range(200)]
    passes = []
    coded = spark.createDataFrame(rows, "ix long, conv_id long, symbols binary, rows long")
    vectors = dialogue.backward_costs(coded, passes.append).orderBy("ix").collect()
    steps = dialogue.Steps()
    whole, start, total = dialogue.run_back(steps, b"".join(r[2] for r in rows), dialogue.FINAL)
    assert tuple(vectors[0]["start"]) == start and sum(v["total"] for v in vectors) == total
    assert [tuple(v["end"]) for v in vectors[:-1]] == [whole[50 * i + 49] for i in range(199)]
    assert len(passes) <= 3 and all(p < 200 for p in passes[1:])


# ---- archives and the pipeline on odd columns and addresses


def test_a_page_with_the_address_of_a_file_head_is_a_page(spark):
    rows = [(1, "filedesc://x", "<p>one</p>"), (2, "http://a", "<p>two</p>"), (3, "filedesc:y z", "<p>" + "long " * 50), (4, "http://b", "<p>" + "long " * 50)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()
    assert sorted((r["key"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_files_of_a_lost_attempt_are_not_read(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "y")], "page_id long, url string, html string").repartition(1)
    folder, manifest = warc.write_arc(pages)
    name = manifest.collect()[0]["path"]
    path = folder.removeprefix("file://")
    (Path(path) / name.replace("-00000.", "-00001.")).write_bytes((Path(path) / name).read_bytes())
    made, converted = warc.convert(spark, folder, arc_manifest=manifest)
    assert sorted(r["key"] for r in warc.read_warc(spark, made, converted).collect()) == [1, 2]


def test_every_stage_keeps_columns_with_odd_names(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c d` string, _row string, row string"
    rows = [(i, f"The house number {i} stands in street {i * 7} of the old town.", "en", "s", 60, f"x{i}", "y", "z", "w") for i in range(40)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", "s", 0, "x", "y", "z", "w")]
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        found = {r["doc_id"]: r["a.b"] for r in kept.collect()}
        assert all(v in (f"x{k}", "x", None) for k, v in found.items()), name
        assert stage(spark, docs.limit(0), SMALL).collect() == [], name
