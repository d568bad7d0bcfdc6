"""The bucketed table: merges against a dictionary, and what they touch on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docweave.sources import buckets
from docweave.sources.buckets import BucketTable

DDL = "collection string, id long, embedding array<float>, note string, seq long"


def rows_of(table):
    return {(r.collection, r.id): (r.note, len(r.embedding)) for r in table.read().collect()}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merges_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "DELTAS", 3)
    rng, table, want = random.Random(1), BucketTable(spark, str(tmp_path / "t"), ["collection", "id"], 8), {}
    for step in range(7):
        ids = rng.sample(range(60), rng.randrange(1, 12))
        rows = [("ab"[i % 2], i, [float(step)] * (s + 1), f"{step}.{s}", s) for i in ids for s in rng.sample(range(4), 2)]
        table.merge(spark.createDataFrame(rows, DDL), "seq")
        for c, i, e, note, _s in sorted(rows, key=lambda r: r[4]):
            want[c, i] = (note, len(e))
        assert rows_of(table) == want
        assert table.read().count() == len(want)


def test_a_merge_reads_and_writes_its_buckets_only(spark, tmp_path):
    path = tmp_path / "t"
    table = BucketTable(spark, str(path), ["id"], 64)
    base = spark.range(1000).withColumn("note", F.lit("base"))
    table.merge(base)
    before = files(path / "rows")
    ids = [7, 77, 777]
    done = table.merge(spark.createDataFrame([(i, "new") for i in ids], "id long, note string"))
    mine = {r.b for r in base.where(F.col("id").isin(ids)).select(F.pmod(F.xxhash64("id"), F.lit(64)).alias("b")).collect()}
    assert set(done.rewritten) == mine and not done.appended and len(mine) <= 3
    after = files(path / "rows")
    assert all(after[f] == t for f, t in before.items())  # nothing old is written over
    new = {f for f in after if f not in before}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == mine
    live = table._live([(b, 0) for b in mine])
    plan = live._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "version" in pruned and "bucket" in pruned
    read = {r.f for r in live.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} == mine
    assert table.read().where("note = 'new'").count() == 3 and table.read().count() == 1000


def test_new_keys_are_appended_and_many_files_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "DELTAS", 3)
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], 1)
    seen = [table.merge(spark.createDataFrame([(i,)], "id long")) for i in range(5)]
    assert [(m.appended, m.rewritten) for m in seen] == [([0], []), ([0], []), ([0], []), ([], [0]), ([0], [])]
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_a_batch_counts_once_and_a_lost_merge_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    table = BucketTable(spark, str(path), ["id"], 4)
    first = spark.createDataFrame([(1, "a"), (2, "a")], "id long, note string")
    table.merge(first, run="r", batch=0)
    held = files(path)
    assert table.merge(spark.createDataFrame([(1, "x"), (9, "x")], "id long, note string"), run="r", batch=0).rewritten == []
    assert files(path) == held

    def lost(*_a, **_k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table.spark, "createDataFrame", lost, raising=False)
        with pytest.raises(RuntimeError, match="lost"):
            table.merge(first.withColumn("note", F.lit("b")), run="r", batch=1)
    assert {r.id: r.note for r in table.read().collect()} == {1: "a", 2: "a"}
    table.merge(first.withColumn("note", F.lit("b")), run="r", batch=1)
    assert {r.id: r.note for r in table.read().collect()} == {1: "b", 2: "b"}
    table.merge(first.where("false"), run="r", batch=2)
    assert table.read().count() == 2
    with pytest.raises(ValueError, match="4 buckets"):
        BucketTable(spark, str(path), ["id"], 5).read()
    with pytest.raises(FileNotFoundError):
        BucketTable(spark, str(tmp_path / "none"), ["id"]).read()
