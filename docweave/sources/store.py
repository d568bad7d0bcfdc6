"""Vector collections and graphs on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vectors(vectors: DataFrame, path: str, collection: str | None = None) -> None:
    """Write vectors by collection (S5); naming one leaves the others on disk alone."""
    rows = vectors if collection is None else vectors.where(F.col("collection") == collection)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if collection is None else "dynamic")
        .option("maxRecordsPerFile", 1_000_000)
        .partitionBy("collection")
        .parquet(path)
    )


def load_vectors(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Read all collections, or one by partition pruning."""
    rows = spark.read.parquet(path).withColumn("collection", F.col("collection").cast("string"))
    return rows if collection is None else rows.where(F.col("collection") == collection)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Write nodes and edges side by side."""
    if fmt not in ("json", "parquet"):
        raise ValueError("format must be 'json' or 'parquet'")
    nodes.write.mode("overwrite").format(fmt).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(fmt).save(f"{path}/edges")
