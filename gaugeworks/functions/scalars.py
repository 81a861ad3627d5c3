"""Closed-form column functions; each stays in JVM expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    """Wilson score bound of k successes in n trials, clamped to 0..1; null where n is 0."""
    p, nd = ratio(k, n), n.cast("double")
    den = 1.0 + F.try_divide(F.lit(z * z), nd)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z / 2), nd), den)
    inner = F.try_divide(p * (1.0 - p), nd) + F.try_divide(F.lit(z * z / 4), nd * nd)
    half = F.try_divide(F.lit(z) * F.sqrt(inner), den)
    bound = F.least(F.lit(1.0), centre + half) if upper else F.greatest(F.lit(0.0), centre - half)
    return F.when(n > 0, bound)


def brier_binary(p: Column, y: Column) -> Column:
    """Squared error of a stated probability."""
    return F.pow(p - y.cast("double"), 2)


def brier_vector(v: Column, gold: Column) -> Column:
    """Sum of squared errors over the reported keys of array<struct<k,p>>; a gold key that isn't reported costs nothing."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x["p"] - (x["k"] == gold).cast("double"), 2))


def log_loss(p: Column) -> Column:
    """-ln p; infinite where p is not positive."""
    return F.when(p <= 0, F.lit(math.inf)).otherwise(-F.ln(p))


def log_loss_clipped(p: Column, least: float = 1e-12) -> Column:
    return -F.ln(F.greatest(p, F.lit(least)))


def at(v: Column, key: Column | str) -> Column:
    """p of a key in array<struct<k,p>>, 0 where it isn't reported."""
    return F.coalesce(F.get(F.filter(v, lambda x: x["k"] == key), F.lit(0))["p"], F.lit(0.0))


def total_variation(a: Column, b: Column) -> Column:
    """Half the sum of absolute differences over the keys of both vectors."""
    keys = F.array_union(F.transform(a, lambda x: x["k"]), F.transform(b, lambda x: x["k"]))
    return F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.abs(at(a, k) - at(b, k))) / 2.0


def max_deviation(a: Column, b: Column) -> Column:
    """Largest absolute difference over the keys of both vectors."""
    keys = F.array_union(F.transform(a, lambda x: x["k"]), F.transform(b, lambda x: x["k"]))
    return F.array_max(F.transform(keys, lambda k: F.abs(at(a, k) - at(b, k))))


def rank_probability(levels: Column, level: Column) -> Column:
    """Ranked probability score of array<double> over ordered levels: mean squared distance of the distribution functions."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    last = F.aggregate(
        levels,
        start,
        lambda a, p: F.struct(
            (a["c"] + p).alias("c"),
            (a["s"] + F.pow(a["c"] + p - (level <= a["i"]).cast("double"), 2)).alias("s"),
            (a["i"] + 1).alias("i"),
        ),
    )
    return last["s"] / (F.size(levels) - 1)


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p of discordant counts, at most 1, summed in log space; 1 where there are none."""
    n, k = (a_only + b_only).cast("int"), F.least(a_only, b_only).cast("int")
    start = F.struct((-n * math.log(2.0)).cast("double").alias("t"), F.exp(-n * math.log(2.0)).alias("s"))
    tail = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, i: F.struct(
            (a["t"] + F.ln((n - i + 1) / i)).alias("t"),
            (a["s"] + F.exp(a["t"] + F.ln((n - i + 1) / i))).alias("s"),
        ),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail["s"]))


def hash_draw(below: Column, *parts: Column) -> Column:
    """A draw from 0 to below - 1 by the md5 of the parts: the same in any engine, and of a replicate by itself."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % below


def hash_order(*parts: Column) -> Column:
    """A sort key that shuffles by seed and id."""
    return F.md5(F.concat_ws(":", *parts))


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """Entry round(q * (n - 1)), half to even, of a sorted array."""
    return F.get(sorted_values, F.bround(F.lit(q) * (F.size(sorted_values) - 1)).cast("int"))


def softmax(scores: Column) -> Column:
    """Shifted by the maximum, so no exponent overflows."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def tempered(v: Column, temperature: float, floor: float = 0.0) -> Column:
    """array<struct<k,p>> with a floor taken off, renormalised, raised to 1 / temperature and renormalised."""
    raised = F.transform(v, lambda x: F.struct(x["k"].alias("k"), F.pow(F.greatest(x["p"] - floor, F.lit(0.0)), 1.0 / temperature).alias("p")))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x["p"])
    return F.transform(raised, lambda x: F.struct(x["k"].alias("k"), F.try_divide(x["p"], total).alias("p")))


def argmax(v: Column) -> Column:
    """First key with the largest p, in the vector's order."""
    ps = F.transform(v, lambda x: x["p"])
    return F.get(v, (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))["k"]


def ties_at_max(v: Column, eps: float = 1e-9) -> Column:
    """How many keys share the largest p."""
    top = F.array_max(F.transform(v, lambda x: x["p"]))
    return F.size(F.filter(v, lambda x: top - x["p"] <= eps))


def chance_adjusted(a: Column, chance: Column) -> Column:
    """(a - c) / (1 - c); may be negative."""
    return F.try_divide(a - chance, 1.0 - chance)


def choice_confidence(v: Column) -> Column:
    """Largest p above chance over what is left above chance."""
    k = F.size(v).cast("double")
    return F.try_divide(F.array_max(F.transform(v, lambda x: x["p"])) - 1.0 / k, 1.0 - 1.0 / k)


def days_360(day: Column) -> Column:
    """A date in months of thirty days."""
    return F.year(day) * 360 + F.month(day) * 30 + F.dayofmonth(day)


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def slug(name: Column) -> Column:
    """File-safe form of a name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-")
