"""Least squares from sums, so that rows are read once and only sums move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple(x: str, y: str) -> dict[str, Column]:
    """slope, intercept and r2 of y on x, as aggregates."""
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x)}


def two_features(rows: DataFrame, by: list[str], a: str, b: str, y: str) -> DataFrame:
    """Coefficients of y on a, b and a constant by the normal equations of centred sums; null where they are singular."""
    cov = lambda u, v: F.covar_pop(u, v)
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.avg(y).alias("_my"), F.var_pop(a).alias("_aa"), F.var_pop(b).alias("_bb"),
        cov(a, b).alias("_ab"), cov(a, y).alias("_ay"), cov(b, y).alias("_by"),
    )
    c = F.col
    det = c("_aa") * c("_bb") - c("_ab") * c("_ab")
    singular = F.abs(det) <= 1e-12 * c("_aa") * c("_bb")
    solved = sums.withColumns({
        "beta_a": F.when(~singular, F.try_divide(c("_ay") * c("_bb") - c("_by") * c("_ab"), det)), "beta_b": F.when(~singular, F.try_divide(c("_by") * c("_aa") - c("_ay") * c("_ab"), det)),
    })
    return solved.withColumn("constant", c("_my") - c("beta_a") * c("_ma") - c("beta_b") * c("_mb")).select(*by, "n", "beta_a", "beta_b", "constant")


def demeaned(rows: DataFrame, block: str, columns: list[str]) -> DataFrame:
    """Columns less their block's mean: what block dummies leave."""
    w = Window.partitionBy(block)
    return rows.withColumns({f"{c}_d": F.col(c) - F.avg(c).over(w) for c in columns})
