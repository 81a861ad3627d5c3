"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links(a, b) to (c, root): each linked node and the least node that it reaches.

    Each round takes the least label among a node and its neighbours and then that label's own label, so the length of
    chains left to walk at least halves. Rounds are written to the shared folder; links and labels never reach the driver.
    """
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("root")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnsRenamed({"c": "b"}), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(near.withColumnRenamed("a", "c"), "c").select("c", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("c").alias("root"), F.col("root").alias("next"))
        turn += 1
        new = scratch.save(least.join(jump, "root", "left").select("c", "old", F.least("root", F.coalesce("next", "root")).alias("root")), f"{name}-{turn}")
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("c", "root")
        scratch.drop(f"{name}-{turn - 1}")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
