"""Ledger operators: versions, pointers, duplicates, costs and running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import running


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlay(rows: DataFrame, corrections: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with ``value`` replaced where a correction exists; the original stays as original_<value>."""
    fixes = corrections.select(*keys, F.col(value).alias("_fix"))
    found = rows.join(fixes, keys, "left")
    return found.withColumn(f"original_{value}", F.col(value)).withColumn("overridden", F.col("_fix").isNotNull()).withColumn(
        value, F.coalesce("_fix", value)
    ).drop("_fix")


def best_version(new: DataFrame, old: DataFrame, cell: str) -> DataFrame:
    """(cell, version): the new version where complete, else the old one where complete, else none. Both have (cell, complete)."""
    n, o = new.select(cell, F.col("complete").alias("n")), old.select(cell, F.col("complete").alias("o"))
    version = F.when(F.coalesce("n", F.lit(False)), "new").when(F.coalesce("o", F.lit(False)), "old").otherwise("none")
    return n.join(o, cell, "full").select(cell, version.alias("version"))


def frontier(points: DataFrame, group: str, x: str, y: str, tie: str) -> DataFrame:
    """Points whose y exceeds that of every cheaper one of their group."""
    found = running(points, group, [F.col(x), F.desc(y), F.col(tie)], {"_b": (F.max, F.col(y))}, before_own=True)
    return found.where(F.col("_b").isNull() | (F.col(y) > F.col("_b"))).drop("_b")


def apportion(shares: DataFrame, group: str, name: str, weight: str, total: int) -> DataFrame:
    """Whole numbers that sum to total within each group, by largest remainder; ties go by name."""
    every = Window.partitionBy(group)
    quota = F.lit(total) * F.col(weight) / F.sum(weight).over(every)
    rows = shares.withColumn("_q", quota).withColumn("_f", F.floor("_q"))
    left = F.lit(total) - F.sum("_f").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), name))
    return rows.withColumn("_left", left).withColumn("seats", (F.col("_f") + (rank <= F.col("_left")).cast("long")).cast("long")).drop("_q", "_f", "_left")
