"""Feed a table to a stream piece by piece, as a log that grows between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.session import work_path


def feed(
    rows: DataFrame,
    order: str,
    slices: int,
    start: Callable[[DataFrame], StreamingQuery],
    last: DataFrame | None = None,
) -> None:
    """Append ``rows`` to a folder in ``slices`` ranges of ``order``, and run the stream over it after each.

    ``start`` begins a query that stops when it has read what is there (``availableNow``) and
    keeps one checkpoint, so every run goes on with the state of the one before. A slice is
    one micro-batch, however many files it has. ``last`` are rows for a run at the end.
    Rows without ``order`` come with the first slice.
    """
    spark, path = rows.sparkSession, work_path(rows.sparkSession, "feed")
    bounds = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).select(
        *(F.expr(f"low + (high - low) * {i} / {slices}").alias(f"b{i}") for i in range(1, slices))
    )
    marks = list(bounds.first()) if slices > 1 else []
    for i in range(slices):
        mine = F.lit(True)
        if i and marks[i - 1] is not None:
            mine = mine & (F.col(order) >= F.lit(marks[i - 1]))
        if i < slices - 1 and marks[i] is not None:
            mine = mine & (F.col(order) < F.lit(marks[i]))
        part = rows.where(mine | F.col(order).isNull() if i == 0 else mine)
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
        if not marks or marks[0] is None:  # one run has had everything
            break
    if last is not None:
        last.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
