"""Paired tests, bootstraps and multiplicity control over pre-aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S


#: Bounds of a Poisson(1) draw as hexadecimal 32-bit numbers: a uniform number stands for as many draws as there are bounds that it reaches.
POISSON = tuple(f"{round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))):08x}" for k in range(9))


def poisson_draws(u: Column) -> Column:
    """Draws from eight hexadecimal digits."""
    return sum(((u >= bound).cast("int") for bound in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def cluster_bootstrap(clusters: DataFrame, group: str, cluster: str, top: str, bottom: str, replicates: int, seed: str) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) by group, clusters drawn with replacement.

    clusters has one row per cluster of a group. How often a replicate draws a cluster is a Poisson(1) number, by an md5 of seed, group, cluster and replicate: a cluster
    needs to know nothing of the others, so one pass with partial sums of a fixed number per group does, and a lost task draws the same again. A replicate that draws
    none has no mean. Groups with one cluster get no interval.
    """
    digits = F.md5(F.concat_ws(":", F.lit(seed), F.col(group), F.col(cluster), F.col("q")))
    four = F.array(*[F.struct((F.col("q") * 4 + k).alias("r"), F.substring(digits, 1 + 8 * k, 8).alias("u")) for k in range(4)])
    each = clusters.select(group, cluster, F.col(top).alias("_t"), F.col(bottom).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))).alias("q"))
    drawn = each.select(group, "_t", "_b", F.explode(four).alias("d")).select(group, "_t", "_b", "d.r", poisson_draws(F.col("d.u")).alias("w")).where((F.col("w") > 0) & (F.col("r") < replicates))
    means = drawn.groupBy(group, "r").agg(S.ratio(F.sum(F.col("w") * F.col("_t")), F.sum(F.col("w") * F.col("_b"))).alias("mean"))
    # One value per replicate: a fixed number per group.
    ranked = means.groupBy(group).agg(F.sort_array(F.collect_list("mean")).alias("means"))
    at = lambda q: F.get("means", F.least(F.size("means") - 1, F.floor(q * F.size("means")).cast("int")))
    bounds = ranked.select(group, F.round(at(0.025), 9).alias("low"), F.round(at(0.975), 9).alias("high"))
    sizes = clusters.groupBy(group).agg(F.count("*").alias("n_clusters"), F.round(S.ratio(F.sum(top), F.sum(bottom)), 9).alias("estimate"))
    several = lambda c: F.when(F.col("n_clusters") >= 2, F.col(c)).alias(c)
    return sizes.join(bounds, group, "left").select(group, "n_clusters", "estimate", several("low"), several("high"))


def paired(rows: DataFrame, by: list[str], unit: str, a: Column, b: Column) -> DataFrame:
    """Discordant counts of two outcomes a unit has in both arms, by group, with the exact test."""
    units = rows.groupBy(*by, unit).agg(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    counts = units.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(F.col("b") & ~F.col("a")).alias("b_only")
    )
    return counts.withColumn("p", S.mcnemar(F.col("a_only"), F.col("b_only")))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p over a family; a test without a p counts as 1. A family is a handful of rows."""
    given = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    every = Window.partitionBy(F.lit(0))
    m = F.count("*").over(every)
    rank = F.row_number().over(every.orderBy("_p", name))
    stepped = given.withColumn("_s", F.least(F.lit(1.0), (m - rank + 1) * F.col("_p")))
    running = every.orderBy("_p", name).rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("p_holm", F.max("_s").over(running)).drop("_p", "_s")


def sign_flip(blocks: DataFrame, by: list[str], diff: str, most: int = 20) -> DataFrame:
    """Exact sign-flip p of the mean difference over at most ``most`` blocks: the share of all sign patterns as extreme; null over more."""
    lists = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", F.col(diff).alias("d")))).alias("_l"))
    d = F.transform("_l", lambda x: x["d"])
    lists = lists.select(*by, d.alias("_d")).where(F.size("_d") >= 1)
    n = F.size("_d")
    masks = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(most))) - 1)
    signed = lambda mask: F.aggregate(
        F.transform("_d", lambda x, i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x
    ) / n
    observed = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / n
    extreme = F.size(F.filter(F.transform(masks, signed), lambda x: F.abs(x) >= F.abs(observed) - 1e-12))
    return lists.select(*by, n.cast("long").alias("n_blocks"), observed.alias("mean_diff"), F.when(n <= most, extreme / F.size(masks)).alias("p"))
