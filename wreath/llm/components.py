"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm.common import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node as component, for every node
    that has a link.

    Each round takes the smallest label among a node and its neighbours and then
    follows labels once (pointer jumping), so the rounds grow with the logarithm
    of the longest path. The labels are written after each round; only the count
    of changed labels comes to the driver. Raises if ``max_rounds`` do not
    suffice."""
    both = links.select(F.col(a).alias("v"), F.col(b).alias("u")).union(
        links.select(F.col(b).alias("v"), F.col(a).alias("u"))).where("v <> u").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
                .groupBy("v").agg(F.min("cu").alias("cu")))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "cu").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        done = stored(step.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        labels = done.select("v", "c")
        if done.where("c <> old").isEmpty():
            return labels.select(F.col("v").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
