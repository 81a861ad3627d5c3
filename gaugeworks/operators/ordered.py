"""Running values over groups of any size: rows are cut by range, summed by part, and each part goes on from the parts before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.folders import Steps


def running(rows: DataFrame, group: str, order: list[Column], values: dict[str, tuple], before_own: bool = False) -> DataFrame:
    """rows with running values within each group in this order.

    values: by name of the new column, an aggregate function and the column it takes; the function must give the whole from parts, as sum, min and max do.
    before_own leaves a row's own value out. A group that a third of all rows share is spread over parts like any other, and only one row per group and part meets in a window.
    """
    parted = Steps(rows.sparkSession, "ordered").save(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "rows")
    parts = parted.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_at")).agg(*[f(c).alias(f"_{n}") for n, (f, c) in values.items()])
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_group", "_at", *[f(F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n, (f, _) in values.items()])
    here = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before_own else 0)
    whole = parted.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    out = [_with(f, f(c).over(here), F.col(f"_{n}")).alias(n) for n, (f, c) in values.items()]
    return whole.select(*rows.columns, *out)


def _with(f, own: Column, before: Column) -> Column:
    """The aggregate of two values, either of which may be null."""
    if f is F.max:
        return F.greatest(own, before)
    if f is F.min:
        return F.least(own, before)
    return F.when(own.isNotNull() | before.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))
