"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import stored


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest node around it.

    ``larger`` moves only neighbours above the node, else the node and its smaller
    neighbours. Minima come from a partially aggregated table, so a hub is never
    gathered; its links meet the minimum in a join that may be split.
    """
    if larger:
        around = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        around = around.toDF("node", "other")
        least = around.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        moved = around.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        least = links.groupBy("high").agg(F.min("low").alias("least"))
        joined = links.join(least, "high")
        moved = joined.select("high", F.col("least").alias("low")).union(
            joined.where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        )
    return moved.where("high > low").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a long, b long)`` that is not a root itself.

    The root is the smallest node that can be reached. Rounds go on until the links
    no longer change; each is stored in the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    now, state = stored(pairs.where("high > low").distinct(), "links"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).collect()[0]
        if seen == state or seen[0] == 0:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        now, state = stored(_star(_star(now, True), False), "links"), seen
