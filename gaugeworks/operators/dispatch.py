"""Queues of requests after the fact: when each would have gone under a pace, a number of slots, or a halt."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import running


def paced(rows: DataFrame, group: str, at: str, tie: str, gap: float) -> DataFrame:
    """rows with start: requests of a group go in order of at, each no earlier than gap after the one before.

    The i-th starts at i * gap plus the greatest of at - j * gap of those up to it, so running values do and no request waits for another's result.
    """
    order = [F.col(at), F.col(tie)]
    numbered = running(rows, group, order, {"_i": (F.sum, F.lit(1))})
    found = running(numbered.withColumn("_free", F.col(at) - F.col("_i") * gap), group, order, {"_most": (F.max, F.col("_free"))})
    return found.withColumn("start", F.col("_most") + F.col("_i") * gap).drop("_i", "_free", "_most")


def halted(rows: DataFrame, group: str, order: str, fatal: Column) -> DataFrame:
    """rows with sent: whether a request of a group goes, which none does after a fatal one."""
    found = running(rows.withColumn("_fatal", F.coalesce(fatal, F.lit(False)).cast("int")), group, [F.col(order)], {"_before": (F.sum, F.col("_fatal"))}, before_own=True)
    return found.withColumn("sent", F.coalesce(F.col("_before"), F.lit(0)) == 0).drop("_fatal", "_before")


def slotted(rows: DataFrame, group: str, at: str, seconds: str, tie: str, slots: int) -> DataFrame:
    """(group, tie, start): requests of a group go in order of at, at most ``slots`` at a time, each for its seconds.

    What starts when hangs on everything before it, so a group is one task; only its times go there.
    """

    def play(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([at, tie], kind="stable")
        free, starts = [float("-inf")] * slots, []
        for arrives, takes in zip(g[at], g[seconds], strict=True):
            start = max(arrives, free[0])
            heapq.heapreplace(free, start + takes)
            starts.append(start)
        return pd.DataFrame({group: g[group], tie: g[tie], "start": starts})

    kinds = dict(rows.dtypes)
    return rows.select(group, tie, at, seconds).groupBy(group).applyInPandas(play, f"{group} {kinds[group]}, {tie} {kinds[tie]}, start double")
