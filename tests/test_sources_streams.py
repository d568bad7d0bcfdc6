import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docweave import session
from docweave.operators import requests as rq
from docweave.operators import vectors
from docweave.operators.validation import ValidationOptions
from docweave.sources import files, store
from docweave.sources.slices import feed
from docweave.sources.tables import spread
from docweave.streaming import ingest, live, repeats


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    base = tmp_path / "in"
    (base / "sample.txt").write_text("plain text\nsecond line", encoding="utf-8")
    (base / "README.MD").write_bytes("# Títle\r\nbody".encode())
    (base / "sub" / "nested.txt").write_text("nested", encoding="utf-8")
    (base / "data.csv").write_text("a,b", encoding="utf-8")
    (base / "broken.txt").write_bytes(b"\xff\xfe\x00bad")
    return base


def test_a_micro_batch_in_one_split_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BATCH_ROWS", 10)
    rows = spark.range(400).selectExpr("cast(id as string) AS doc_id", "concat('text ', id) AS content").coalesce(1)
    for _ in range(spark.sparkContext.defaultParallelism):  # empty splits
        rows = rows.union(spark.createDataFrame([], rows.schema))
    sizes = [len(part) for part in ingest._even(rows).rdd.glom().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 40


def test_load_directory(spark, folder):
    rows = {r.filename: r for r in files.load_directory(spark, str(folder)).collect()}
    assert set(rows) == {"sample.txt", "README.MD", "nested.txt"}
    assert rows["README.MD"].content == "# Títle\nbody" and rows["README.MD"].file_type == "markdown"
    assert rows["sample.txt"].size_bytes == 22 and rows["sample.txt"].source == str(folder / "sample.txt")
    flat = files.load_directory(spark, str(folder), recursive=False)
    assert {r.filename for r in flat.collect()} == {"sample.txt", "README.MD"}
    assert {r.filename for r in files.load_markdown_files(spark, str(folder)).collect()} == {"README.MD"}
    assert files.load_text_files(spark, str(folder)).count() == 2
    with pytest.raises(AnalysisException):
        files.load_directory(spark, str(folder / "missing")).count()


def test_files_that_are_not_text_are_reported(spark, folder):
    rows = files.rejected_files(spark, str(folder)).collect()
    assert [(r.source, r.size_bytes, r.error) for r in rows] == [(str(folder / "broken.txt"), 6, "not valid UTF-8")]


def test_questions_of_several_files(spark, tmp_path):
    (tmp_path / "q").mkdir()
    for name, lines in {"b.txt": "three\r\n\nfour", "a.txt": "one\ntwo\n", "c.txt": "\n"}.items():
        (tmp_path / "q" / name).write_bytes(lines.encode())
    got = files.load_questions(spark, str(tmp_path / "q")).orderBy("query_id").collect()
    assert [(r["query_id"], r["query"]) for r in got] == [(0, "one"), (1, "two"), (2, "three"), (3, "four")]


def test_empty_directory(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.load_directory(spark, str(tmp_path / "none")).count() == 0


def test_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" first? \n\n\t\nsecond\n", encoding="utf-8")
    got = files.load_questions(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()
    assert [r["query"] for r in got] == ["first?", "second"]


def test_store_keeps_other_collections(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("default", 1, [1.0]), ("hr", 2, [2.0])]
    df = spark.createDataFrame(rows, "collection string, id int, embedding array<float>")
    store.save_vectors(df, path)
    changed = df.where("collection = 'hr'").withColumn("id", F.lit(9))
    store.save_vectors(changed, path, collection="hr")
    assert sorted((r.collection, r.id) for r in store.load_vectors(spark, path).collect()) == [("default", 1), ("hr", 9)]
    one = store.load_vectors(spark, path, "hr")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(collection" in one._jdf.queryExecution().toString()


def test_export_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("a",)], "doc_id string")
    edges = spark.createDataFrame([("a", "b", "citation", 1.0)], "source_doc string, target_doc string, relationship_type string, weight double")
    store.export_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).first().weight == 1.0
    with pytest.raises(ValueError):
        store.export_graph(nodes, edges, str(tmp_path / "g"), "gexf")


def test_spread_leaves_large_inputs_alone(spark):
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism)
    assert spread(many, "id") is many
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_checkpoint_folder_comes_from_the_session(spark):
    class Cluster:
        """Only what the helper reads of a session."""

        def __init__(self, conf, current=None):
            self.conf, self.sparkContext = conf, self
            self.master, self.getCheckpointDir = "spark://host", lambda: current

    assert session.work_path(Cluster({"spark.checkpoint.dir": "s3a://b/cp"}), "x").startswith("s3a://b/cp/x-")
    assert session.shared_dir(Cluster({}, "hdfs://cp")) == "hdfs://cp"
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster({}))
    df = session.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


# ---- streams ------------------------------------------------------------------------------

T0 = datetime(2024, 1, 1)


def slices(spark, tmp_path, batches):
    """Write one Parquet file per batch, in order of arrival."""
    path = str(tmp_path / "log")
    for rows in batches:
        data = [(T0 + timedelta(seconds=s), k, v) for s, k, v in rows]
        spark.createDataFrame(data, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(path), path


def run(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_live_metrics_equal_batch_for_closed_windows(spark, tmp_path):
    batches = [[(i * 30, "ab"[i % 2], float(i % 5)) for i in range(b * 40, b * 40 + 40)] for b in range(3)]
    stream, path = slices(spark, tmp_path, batches)
    live_rows = run(spark, live.live_metrics(stream, "v", F.col("v") > 1, "k"), tmp_path, "metrics").collect()
    batch = {(r.window_start, r.k): r.requests for r in rq.request_rate(spark.read.parquet(path), "k").collect()}
    got = {(r.window_start, r.k): r.requests for r in live_rows}
    assert len(got) == len(live_rows) > 10
    assert all(batch[key] == n for key, n in got.items())


def test_late_rows_are_dropped(spark, tmp_path):
    stream, _p = slices(spark, tmp_path, [[(0, "a", 1.0)], [(7200, "a", 1.0)], [(7201, "a", 1.0)], [(10, "a", 1.0)], [(14400, "a", 1.0)]])
    # rows are judged by the watermark of the batch before the last one
    rows = run(spark, live.live_metrics(stream, "v", F.col("v") > 0, "k"), tmp_path, "late").collect()
    first = min(rows, key=lambda r: r.window_start)
    assert first.requests == 1


def test_live_over_limit(spark, tmp_path):
    stream, _p = slices(spark, tmp_path, [[(i, "a", 0.0) for i in range(4)] + [(5, "b", 0.0)], [(900, "c", 0.0)]])
    rows = run(spark, live.live_over_limit(stream, "k", 3), tmp_path, "limit").collect()
    assert [(r.k, r.requests) for r in rows] == [("a", 4)]


def test_updates_hold_windows_that_are_still_open(spark, tmp_path):
    batches = [[(i, "a", 0.0) for i in range(3)], [(4, "a", 0.0), (900, "c", 0.0)], [(901, "c", 0.0)]]
    stream, path = slices(spark, tmp_path, batches)
    out = str(tmp_path / "updates")
    live.start_updates(live.live_over_limit(stream, "k", 1), out, out + "-cp").awaitTermination()
    got = {(r.window_start, r.k): r.requests for r in live.read_updates(spark, out, "window_start", "k").collect()}
    batch = rq.over_limit(spark.read.parquet(path), "k", 1)
    assert got == {(r.window_start, r.k): r.requests for r in batch.collect()} and sorted(got.values()) == [2, 4]


def sequential(rows, ttl):
    """Requests that find no valid answer, one key after the other in order of time."""
    out, stored = [], {}
    for t, k in sorted(set(rows)):
        if k not in stored or t - stored[k] >= ttl:
            stored[k] = t
            out.append((k, t))
    return sorted(out)


END = [(1_000_000, None, 0.0)]


def test_repeats_pass_again_after_the_ttl(spark, tmp_path):
    """The answer is stored at 0 and serves until just before 3600; hits do not renew it."""
    batches = [[(0, "a", 1.0)], [(60, "a", 2.0), (61, "b", 3.0)], [(3599, "a", 4.0)], [(3600, "a", 4.5)], [(7199, "a", 5.0)], [(7200, "a", 6.0)], END]
    stream, _p = slices(spark, tmp_path, batches)
    rows = run(spark, repeats.first_asked(stream, "k"), tmp_path, "repeats").collect()
    assert sorted((r.key, int((r.asked_at - T0).total_seconds())) for r in rows) == [("a", 0), ("a", 3600), ("a", 7200), ("b", 61)]


def test_repeats_do_not_depend_on_micro_batches(spark, tmp_path):
    """Late by up to ten minutes, in any split: the outcome of a scan in order of time."""
    rng = random.Random(8)
    log = sorted((rng.randrange(40_000), rng.choice("aaabcd"), 0.0) for _ in range(400))
    late = sorted(log, key=lambda r: r[0] + rng.randrange(590))
    for n in (1, 7):
        folder = tmp_path / f"in-{n}"
        folder.mkdir()
        size = -(-len(late) // n)
        stream, _p = slices(spark, folder, [late[i : i + size] for i in range(0, len(late), size)] + [END])
        rows = run(spark, repeats.first_asked(stream, "k", ttl_seconds=900), folder, "repeats").collect()
        got = sorted((r.key, int((r.asked_at - T0).total_seconds())) for r in rows)
        assert got == sequential([(t, k) for t, k, _ in log], 900)


def test_a_fed_table_gives_one_result_for_any_slices(spark, small):
    from docweave.plans.requests import first_asked_in

    rows = [(r["t"], r["k"]) for r in spark.read.parquet(f"{small}/events.parquet").selectExpr("unix_micros(timestamp(ts)) AS t", "concat_ws('|', event_type, props) AS k").collect()]
    want = sequential(rows, 3_600_000_000)
    for n in (1, 7):
        assert sorted((r["asked"], r["asked_at"]) for r in first_asked_in(spark, small, n).collect()) == want


def test_feed_with_missing_or_equal_order(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(None, "a")]), ("mixed", [(None, "a"), (1, "b"), (1, "c"), (9, "d")])):
        seen = []

        def start(stream):
            return stream.writeStream.foreachBatch(lambda b, _i: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()

        feed(spark.createDataFrame(rows, "t long, k string"), "t", 4, start)
        assert sorted(seen, key=str) == sorted(rows, key=str)


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    docs_dir, out = tmp_path / "docs", str(tmp_path / "store")
    docs_dir.mkdir()
    opt = ValidationOptions(min_length=5)

    def ingest_new():
        stream = files.stream_directory(spark, str(docs_dir), files_per_batch=1)
        ingest.start_ingest(stream, files.metadata_map(), out, str(tmp_path / "cp"), opt, 20, 5).awaitTermination()

    (docs_dir / "a.txt").write_text("alpha beta gamma delta epsilon", encoding="utf-8")
    (docs_dir / "bad.txt").write_text("<script>x</script>", encoding="utf-8")
    ingest_new()
    first = {r.chunk_id for r in ingest.read_chunks(spark, out).collect()}
    ingest_new()
    assert {r.chunk_id for r in ingest.read_chunks(spark, out).collect()} == first and len(first) == 2
    (docs_dir / "b.txt").write_text("another text file", encoding="utf-8")
    ingest_new()
    chunks = ingest.read_chunks(spark, out).collect()
    assert len(chunks) == 3 and all(len(r.embedding) == 64 for r in chunks)
    rejected = ingest.read_rejected(spark, out).collect()
    assert [r.errors for r in rejected] == [["[SECURITY_XSS] Potential XSS attack pattern detected: <script>x</script>..."]]
    stream = files.stream_directory(spark, str(docs_dir))
    model = lambda df, c: vectors.embed_with(df, c, vectors.term_counts_model(8))
    ingest.start_ingest(stream, files.metadata_map(), out, str(tmp_path / "cp2"), opt, 20, 5, model).awaitTermination()
    again = ingest.read_chunks(spark, out).collect()
    assert {r.chunk_id for r in again} == {r.chunk_id for r in chunks} and all(len(r.embedding) == 8 for r in again)
    assert ingest.read_rejected(spark, out).count() == 2
    ingest.compact(spark, out, str(tmp_path / "compact"), 2)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3
    batch, rejects = ingest.prepare(files.load_directory(spark, str(docs_dir)), files.metadata_map(), opt, 20, 5)
    assert {r.chunk_id for r in batch.collect()} == {r.chunk_id for r in chunks} and rejects.count() == 1
