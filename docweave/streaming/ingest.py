"""Incremental ingestion: validate, chunk, embed, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.chunking import chunk_documents
from docweave.operators.validation import DEFAULT, ValidationOptions, split_valid, validate
from docweave.operators.vectors import hash_embed
from docweave.session import work_path
from docweave.sources.buckets import BucketTable
from docweave.sources.tables import dealt

#: Documents that one task checks or splits.
BATCH_ROWS = 2000


def prepare(
    docs: DataFrame,
    metadata: Column,
    opt: ValidationOptions = DEFAULT,
    size: int = 1000,
    overlap: int = 200,
    embed: Callable[[DataFrame, str], DataFrame] = hash_embed,
) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors of the valid documents, and the report of the others.

    ``docs`` has doc_id, source and content; batch and stream share this plan.
    """
    return prepare_validated(validate(docs.withColumn("metadata", metadata), opt=opt), size, overlap, embed)


def prepare_validated(
    validated: DataFrame, size: int, overlap: int, embed: Callable[[DataFrame, str], DataFrame] = hash_embed
) -> tuple[DataFrame, DataFrame]:
    valid, rejected = split_valid(validated)
    kept = valid.drop("errors", "warnings", "is_valid", "metadata")
    return embed(chunk_documents(kept, size=size, overlap=overlap), "content"), rejected


def _even(batch: DataFrame) -> DataFrame:
    """Rows of a micro-batch dealt evenly: a large file is read by few tasks, however many splits it has."""
    return dealt(batch, "doc_id", "content", rows=BATCH_ROWS, least=batch.sparkSession.sparkContext.defaultParallelism)


def start_ingest(
    stream: DataFrame,
    metadata: Column,
    store: str,
    checkpoint: str,
    opt: ValidationOptions = DEFAULT,
    size: int = 1000,
    overlap: int = 200,
    embed: Callable[[DataFrame, str], DataFrame] = hash_embed,
) -> StreamingQuery:
    """Merge the chunks of each micro-batch into a bucketed table, and write its rejects.

    The table counts a micro-batch once, by the number of its checkpoint and its own, so
    a restart neither loses nor repeats rows; only buckets that hold a chunk again are
    written anew. Rejects have one folder per micro-batch, which a replay overwrites. A
    new checkpoint on an existing store adds to it.
    """
    run = _run_of(stream.sparkSession, store, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # both sinks read the checked rows of this micro-batch; they are stored, as no memory holds a large one
        checked = work_path(spark, "checked")
        validate(_even(batch).withColumn("metadata", metadata), opt=opt).write.parquet(checked)
        chunks, rejected = prepare_validated(spark.read.parquet(checked), size, overlap, embed)
        chunk_table(spark, store).merge(chunks, run=str(run), batch=batch_id)
        rejected.write.mode("overwrite").parquet(f"{store}/rejected/run={run}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _run_of(spark: SparkSession, store: str, checkpoint: str) -> int:
    """Number of the checkpoint among those that have written to a store, from 1; kept in the store."""
    known: dict[str, int] = {}
    try:
        known = {r["checkpoint"]: r["run"] for r in spark.read.parquet(f"{store}/runs").collect()}  # one row per checkpoint
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    if checkpoint not in known:
        known[checkpoint] = len(known) + 1
        row = spark.createDataFrame([(checkpoint, known[checkpoint])], "checkpoint string, run long")
        row.write.mode("append").parquet(f"{store}/runs")
    return known[checkpoint]


def chunk_table(spark: SparkSession, store: str) -> BucketTable:
    return BucketTable(spark, f"{store}/chunks", ["chunk_id"])


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """One row per chunk id, the newest over all micro-batches, later checkpoints after earlier ones."""
    return chunk_table(spark, store).read()


def read_rejected(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/rejected").drop("run", "batch")


def compact(spark: SparkSession, store: str, target: str, buckets: int = 200) -> None:
    """Write the newest row per chunk id to ``target``, clustered by id, for readers that come often."""
    read_chunks(spark, store).repartition(buckets, "chunk_id").sortWithinPartitions("chunk_id").write.parquet(target)
