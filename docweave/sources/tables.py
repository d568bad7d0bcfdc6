"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Rows that one task groups at once.
GROUPED_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, least: int = 1) -> DataFrame:
    """A table as read, dealt by ``keys`` in tasks of about ``rows`` rows, at ``least`` so many.

    For a grouping by nearly unique keys: without this a task groups all rows of its split before the
    shuffle, to no use, and as many as a shuffle partition has after it. And for costly work per row,
    where few splits hold the rows. The rows of a Parquet table are counted from its footers.
    """
    return df.repartition(max(least, -(-df.count() // (rows or GROUPED_ROWS))), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a scan has fewer tasks than the session has cores.

    A small file is one task, however costly the work per row. Large inputs have
    more tasks than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
