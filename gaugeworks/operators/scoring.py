"""Scoring operators: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators.ordered import running


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all requested items by group, with Wilson bounds. scored has answered and correct."""
    n, k = F.count("*"), F.count_if("correct")
    return scored.groupBy(*by).agg(
        n.alias("n_requested"), F.count_if("answered").alias("n_answered"), k.alias("n_correct"), F.round(S.ratio(k, n), 9).alias("accuracy"),
        F.round(S.wilson(k, n, False), 9).alias("wilson_low"), F.round(S.wilson(k, n, True), 9).alias("wilson_high"),
    )


def duplicate_pairs(rows: DataFrame, payload: str, gold: str) -> DataFrame:
    """Per payload found more than once: items, pairs, and pairs whose gold differs."""
    cells = rows.groupBy(payload, gold).agg(F.count("*").alias("n"))
    n, square = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    found = cells.groupBy(payload).agg(n.alias("n_items"), square.alias("_square")).where("n_items > 1")
    return found.select(
        payload, "n_items", F.expr("n_items * (n_items - 1) div 2").alias("n_pairs"), F.expr("(n_items * n_items - _square) div 2").alias("n_conflicting")
    )


def reliability(rows: DataFrame, p: str, correct: str, bins: int) -> DataFrame:
    """bin, n, mean_p, rate of equal-width bins; the last bin holds 1."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(correct).cast("int")).alias("rate"))


def ece(bins: DataFrame) -> DataFrame:
    """n and the mean gap of reliability bins, weighted by their sizes."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate")))
    return bins.agg(F.sum("n").alias("n"), F.round(gap / F.sum("n"), 9).alias("ece"))


def risk_coverage(rows: DataFrame, group: str, p: str, correct: str, tie: str) -> DataFrame:
    """Running accuracy within a group in order of falling p; ties go by id."""
    ones = rows.select(group, tie, p, F.col(correct).cast("long").alias("_c"), F.lit(1).cast("long").alias("_n"))
    found = running(ones, group, [F.desc(p), F.col(tie)], {"covered": (F.sum, F.col("_n")), "right": (F.sum, F.col("_c"))})
    return found.select(group, tie, p, "covered", F.round(F.col("right") / F.col("covered"), 9).alias("accuracy"))


def stratified(sample: DataFrame, sizes: DataFrame, stratum: str, correct: str) -> DataFrame:
    """Estimate from a sample by strata, weighted by their sizes among the strata seen."""
    each = sample.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(correct).alias("k")).join(sizes, stratum)
    weighted = F.sum(F.col("size") * S.ratio(F.col("k"), F.col("n"))) / F.sum("size")
    return each.agg(F.count("*").alias("n_strata"), F.sum("n").alias("n"), F.round(weighted, 9).alias("estimate"))


def match_report(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Counts of rows without a key, of keys without a row, and of rows: one full join of counts by key."""
    a = rows.groupBy(key).agg(F.count("*").alias("n"))
    b = keys.groupBy(key).agg(F.count("*").alias("m"))
    none = F.lit(0).cast("long")
    return a.join(b, key, "full").agg(
        F.sum(F.when(F.col("m").isNull(), F.col("n")).otherwise(none)).alias("n_unmatched"),
        F.sum(F.when(F.col("n").isNull(), F.col("m")).otherwise(none)).alias("n_unused"), F.coalesce(F.sum("n"), none).alias("n_rows"),
    )
