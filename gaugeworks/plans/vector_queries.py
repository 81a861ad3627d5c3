"""Probability vectors: lattices, ties, transforms, ensembles, remaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.plans.registry import query
from gaugeworks.plans.views import EVENT_TYPES, PROBS_SQL, probs
from gaugeworks.tables import load

#: Displayed values: hundredths, rounded half up.
_SHOWN_SQL = f"""WITH {PROBS_SQL}, shown AS (SELECT user_id, half, m, k, p, floor(p * 100 + 0.5) / 100 AS s FROM probs)"""


def _shown(v: Column | str) -> Column:
    return F.transform(v, lambda x: F.struct(x["k"].alias("k"), (F.floor(x["p"] * 100 + 0.5) / 100.0).alias("p")))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x["p"])


@query(
    "lattice_scan",
    f"""{_SHOWN_SQL}, r AS (SELECT user_id, half, any_value(m) AS m, sum(s) - 1 AS dev, count_if(abs(floor(p * 100 + 0.5) / 100 - p) > 1e-9) AS off, count_if(s <= 0.015) AS floored FROM shown GROUP BY ALL)
SELECT least(m // 20, 5)::bigint AS bucket, count(*)::bigint AS n, sum(off)::bigint AS n_off_grid, sum(floored)::bigint AS n_floor, round(avg(dev), 9) AS mean_dev, round(stddev_pop(dev), 9) AS sd_dev,
  count_if(dev > 1e-9)::bigint AS n_over, count_if(dev < -1e-9)::bigint AS n_under, round(sqrt(5 / 12.0) * 0.01, 9) AS predicted_sd FROM r GROUP BY 1""",
)
def lattice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How displayed values deviate from a distribution, by how many events stand behind it."""
    off = F.size(F.filter("v", lambda x: F.abs(F.floor(x["p"] * 100 + 0.5) / 100.0 - x["p"]) > 1e-9))
    rows = probs(spark, sf_dir).select("m", off.alias("off"), _shown("v").alias("s"))
    rows = rows.select("m", "off", (_sum(F.col("s")) - 1).alias("dev"), F.size(F.filter("s", lambda x: x["p"] <= 0.015)).alias("floored"))
    dev = F.col("dev")
    return rows.groupBy(F.least(F.floor(F.col("m") / 20), F.lit(5)).cast("long").alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("off").alias("n_off_grid"), F.sum("floored").alias("n_floor"), F.round(F.avg(dev), 9).alias("mean_dev"), F.round(F.stddev_pop(dev), 9).alias("sd_dev"),
        F.count_if(dev > 1e-9).alias("n_over"), F.count_if(dev < -1e-9).alias("n_under"), F.round(F.lit((5 / 12.0) ** 0.5 * 0.01), 9).alias("predicted_sd"),
    )


@query(
    "confidence_residual",
    f"""{_SHOWN_SQL}, c AS (SELECT user_id, half, (max(s) - 0.2) / 0.8 AS shown, (max(p) - 0.2) / 0.8 AS exact, max(p) AS top FROM shown GROUP BY ALL)
SELECT half, count(*)::bigint AS n, count_if(abs(shown - exact) <= 1e-9)::bigint AS n_exact, count_if(abs(shown - exact) > 1e-9 AND abs(shown - exact) <= 0.005)::bigint AS n_one, count_if(abs(shown - exact) > 0.005)::bigint AS n_beyond,
  round(corr(exact, top), 6) AS correlation FROM c GROUP BY half""",
)
def confidence_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from displayed values against that from exact ones."""
    rows = probs(spark, sf_dir).select("half", S.choice_confidence(_shown("v")).alias("shown"), S.choice_confidence(F.col("v")).alias("exact"), F.array_max(F.transform("v", lambda x: x["p"])).alias("top"))
    gap = F.abs(F.col("shown") - F.col("exact"))
    return rows.groupBy("half").agg(
        F.count("*").alias("n"), F.count_if(gap <= 1e-9).alias("n_exact"), F.count_if((gap > 1e-9) & (gap <= 0.005)).alias("n_one"), F.count_if(gap > 0.005).alias("n_beyond"), F.round(F.corr("exact", "top"), 6).alias("correlation")
    )


@query(
    "argmax_ties",
    f"""{_SHOWN_SQL}, r AS (SELECT user_id, half, max(s) AS top FROM shown GROUP BY ALL)
SELECT s.user_id, s.half, min(k) FILTER (WHERE s.s = top) AS pick, count_if(top - s.s <= 1e-9)::bigint AS n_tied, round(max(top), 9) AS top FROM shown s JOIN r USING (user_id, half) GROUP BY ALL""",
)
def argmax_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest displayed value; ties go to the first key and are counted."""
    rows = probs(spark, sf_dir).select("user_id", "half", _shown("v").alias("s"))
    return rows.select(
        "user_id", "half", S.argmax(F.col("s")).alias("pick"), S.ties_at_max(F.col("s")).cast("long").alias("n_tied"), F.round(F.array_max(F.transform("s", lambda x: x["p"])), 9).alias("top")
    )


@query(
    "temperature_top_p",
    f"""WITH {PROBS_SQL}, t AS (SELECT user_id, half, k, power(greatest(p - 0.02, 0), 2.0) AS q FROM probs), n AS (SELECT *, q / nullif(sum(q) OVER (PARTITION BY user_id, half), 0) AS r FROM t),
c AS (SELECT *, sum(r) OVER (PARTITION BY user_id, half ORDER BY round(r, 9) DESC, k ROWS UNBOUNDED PRECEDING) - r AS before FROM n)
SELECT user_id, half, k, round(r, 9) AS p FROM c WHERE before < 0.9 - 1e-9""",
)
def temperature_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpened vectors, cut where nine tenths of the mass is reached. All within a row: vectors are never shuffled."""
    rows = probs(spark, sf_dir).select("user_id", "half", S.tempered(F.col("v"), 0.5, 0.02).alias("t"))
    order = F.array_sort(F.transform("t", lambda x: F.struct((-F.round(x["p"], 9)).alias("o"), x["k"].alias("k"), x["p"].alias("p"))))
    rows = rows.withColumn("o", order)
    before = lambda i: F.aggregate(F.slice("o", F.lit(1), i), F.lit(0.0), lambda s, x: s + x["p"])
    kept = F.filter("o", lambda x, i: before(i) < 0.9 - 1e-9)
    return rows.select("user_id", "half", F.explode(kept).alias("x")).select("user_id", "half", "x.k", F.round("x.p", 9).alias("p"))


@query(
    "ensemble_sum",
    f"""WITH {PROBS_SQL}, e AS (SELECT user_id % 10 AS page, k, sum(p) AS s FROM probs GROUP BY ALL)
SELECT page, k, round(s / sum(s) OVER (PARTITION BY page), 9) AS p FROM e""",
)
def ensemble_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass summed by option over members and renormalised within a page."""
    mass = probs(spark, sf_dir).select((F.col("user_id") % 10).alias("page"), F.explode("v").alias("x")).groupBy("page", F.col("x.k").alias("k")).agg(F.sum("x.p").alias("s"))
    return mass.select("page", "k", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("page")), 9).alias("p"))


@query(
    "product_decode",
    f"""WITH {PROBS_SQL}, prior AS (SELECT event_type AS k, count(*)::double / (SELECT count(*) FROM events) AS w FROM events GROUP BY 1), j AS (SELECT user_id, half, k, p * w AS q FROM probs JOIN prior USING (k))
SELECT user_id, half, k, round(q / sum(q) OVER (PARTITION BY user_id, half), 9) AS p FROM j""",
)
def product_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector times a prior over options, renormalised. The prior is one row of five counts."""
    counts = load(spark, sf_dir, "events").agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == k).alias(k) for k in EVENT_TYPES])
    prior = F.broadcast(counts.select(F.array(*[F.col(k) / F.col("n") for k in EVENT_TYPES]).alias("w")))
    rows = probs(spark, sf_dir).join(prior, F.lit(True))
    rows = rows.withColumn("j", F.zip_with("v", "w", lambda x, w: F.struct(x["k"].alias("k"), (x["p"] * w).alias("p"))))
    return rows.select("user_id", "half", F.explode("j").alias("x"), _sum(F.col("j")).alias("t")).select("user_id", "half", "x.k", F.round(F.col("x.p") / F.col("t"), 9).alias("p"))


@query(
    "option_permutation_remap",
    f"""WITH {PROBS_SQL}, r AS (SELECT user_id, half, k, p, (row_number() OVER (PARTITION BY user_id, half ORDER BY k) - 1 + user_id) % 5 AS slot FROM probs)
SELECT k, slot::bigint AS slot, count(*)::bigint AS n, round(avg(p), 9) AS mean_p FROM r GROUP BY ALL""",
)
def option_permutation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options rotated by an offset per user; shown keys are mapped back by the inverse of the bijection."""
    names = F.array(*[F.lit(k) for k in EVENT_TYPES])
    offset = F.pmod(F.col("user_id"), F.lit(5)).cast("int")
    shown = F.transform(names, lambda k, i: F.pmod(i + offset, F.lit(5)))
    forward = F.map_from_arrays(names, shown)
    back = F.map_from_arrays(F.map_values(forward), F.map_keys(forward))
    rows = probs(spark, sf_dir).select("v", forward.alias("f"), back.alias("b"))
    # What was shown is read by slot and named again.
    slots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.struct(s.alias("slot"), F.element_at("b", s).alias("k"), S.at(F.col("v"), F.element_at("b", s)).alias("p")))
    return rows.select(F.explode(slots).alias("x")).groupBy("x.k", F.col("x.slot").cast("long").alias("slot")).agg(F.count("*").alias("n"), F.round(F.avg("x.p"), 9).alias("mean_p"))


@query(
    "option_mass_votes",
    f"""WITH {PROBS_SQL}, w AS (SELECT user_id, half, arg_max(k, (round(p, 9), -(row_number))) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY user_id, half ORDER BY k) AS row_number FROM probs) GROUP BY ALL)
SELECT p.half, p.k, round(avg(p.p), 9) AS mean_p, count_if(w.pick = p.k)::bigint AS n_votes, CASE WHEN k IN ('click', 'view') THEN 'browse' WHEN k = 'error' THEN 'fault' ELSE 'commit' END AS family
FROM probs p JOIN w USING (user_id, half) GROUP BY p.half, p.k""",
)
def option_mass_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean mass and votes by option, with its family."""
    rounded = F.transform("v", lambda x: F.named_struct(F.lit("k"), x["k"], F.lit("p"), F.round(x["p"], 9)))
    rows = probs(spark, sf_dir).select("half", S.argmax(rounded).alias("pick"), F.explode("v").alias("x"))
    family = F.when(F.col("k").isin("click", "view"), "browse").when(F.col("k") == "error", "fault").otherwise("commit")
    return rows.groupBy("half", F.col("x.k").alias("k")).agg(F.round(F.avg("x.p"), 9).alias("mean_p"), F.count_if(F.col("pick") == F.col("x.k")).alias("n_votes")).withColumn("family", family)


@query(
    "request_measures",
    f"""WITH {PROBS_SQL} SELECT user_id, half, count(*)::bigint AS n_options, count_if(p > 0)::bigint AS n_used, any_value(m)::bigint AS n_events, sum(length(k))::bigint AS option_chars FROM probs GROUP BY ALL""",
)
def request_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each request."""
    chars = F.aggregate("v", F.lit(0), lambda s, x: s + F.length(x["k"]))
    return probs(spark, sf_dir).select("user_id", "half", F.size("v").cast("long").alias("n_options"), F.size(F.filter("v", lambda x: x["p"] > 0)).cast("long").alias("n_used"), F.col("m").alias("n_events"), chars.cast("long").alias("option_chars"))


@query(
    "softmax_percentiles",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)
SELECT vec_id, label, round(list_max(p), 6) AS top, list_position(p, list_max(p))::bigint AS at, round(list_sort(p)[1 + round_even(0.5 * (len(p) - 1), 0)::int], 6) AS middle, round(list_sort(p)[len(p) // 2 + 1], 6) AS upper_middle FROM n""",
)
def softmax_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over a vector's components, its largest share and two conventions of a median."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", S.softmax(F.col("embedding").cast("array<double>")).alias("p")).withColumn("s", F.sort_array("p"))
    return rows.select(
        "vec_id", "label", F.round(F.array_max("p"), 6).alias("top"), F.array_position("p", F.array_max("p")).alias("at"), F.round(S.nearest_rank(F.col("s"), 0.5), 6).alias("middle"),
        F.round(F.get("s", F.floor(F.size("s") / 2).cast("int")), 6).alias("upper_middle"),
    )
