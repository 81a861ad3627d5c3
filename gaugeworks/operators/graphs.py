"""Small-diameter graph operators by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.folders import Steps


def distances(links: DataFrame, source: int) -> DataFrame:
    """(node, distance) of all nodes reached from source over links(a, b), both ways listed. Each round joins the frontier only and is written to the shared folder."""
    steps = Steps(links.sparkSession, "distances")
    links = steps.save(links, "links")
    seen = front = steps.save(links.sparkSession.createDataFrame([(source, 0)], "node int, distance int"), "0")
    d = 0
    while front.limit(1).count():
        d += 1
        step = front.join(links, front["node"] == links["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = steps.save(step.select("node", F.lit(d).alias("distance")), str(d))
        seen = seen.unionByName(front)
    return seen


def refined(links: DataFrame, rounds: int) -> DataFrame:
    """(node, signature): hashes of neighbours' hashes, begun from degrees; a renaming of nodes changes none.

    A node's neighbours enter by the sums of four 32-bit parts of their hashes, which are partial aggregates: the neighbours of a hub are never gathered.
    """
    part = lambda k: F.sum(F.conv(F.substring("t", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"p{k}")
    labels = links.groupBy("a").agg(F.md5(F.count("*").cast("string")).alias("s"))
    for _ in range(rounds):
        near = links.join(labels.withColumnsRenamed({"a": "b", "s": "t"}), "b").groupBy("a").agg(*map(part, range(4)))
        labels = labels.join(near, "a").select("a", F.md5(F.concat_ws("|", "s", "p0", "p1", "p2", "p3")).alias("s"))
    return labels.select(F.col("a").alias("node"), F.col("s").alias("signature"))
