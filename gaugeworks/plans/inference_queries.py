"""Distances between distributions, paired tests, bootstraps and multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import inference
from gaugeworks.plans.registry import query
from gaugeworks.plans.views import PROBS_SQL, both_halves, probs
from gaugeworks.tables import load

_PAIRED_SQL = f"""WITH {PROBS_SQL}, pairs AS (SELECT a.user_id, a.k, a.p AS pa, b.p AS pb FROM probs a JOIN probs b USING (user_id, k) WHERE a.half = 'a' AND b.half = 'b')"""


@query("tvd_user_periods", f"{_PAIRED_SQL} SELECT user_id, round(sum(abs(pa - pb)) / 2, 9) AS tvd FROM pairs GROUP BY user_id")
def tvd_user_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation distance between a user's two halves."""
    return both_halves(spark, sf_dir).select("user_id", F.round(S.total_variation(F.col("a"), F.col("b")), 9).alias("tvd"))


@query("max_deviation", f"{_PAIRED_SQL} SELECT user_id, round(max(abs(pa - pb)), 9) AS deviation FROM pairs GROUP BY user_id")
def max_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest change of a probability between a user's two halves."""
    return both_halves(spark, sf_dir).select("user_id", F.round(S.max_deviation(F.col("a"), F.col("b")), 9).alias("deviation"))


@query(
    "isolation_summary",
    f"""{_PAIRED_SQL}, t AS (SELECT user_id, sum(abs(pa - pb)) / 2 AS tvd FROM pairs GROUP BY user_id)
SELECT user_id % 10 AS cohort, count(*)::bigint AS n, round(max(tvd), 9) AS worst, max(tvd) <= 0.05 AS stable FROM t GROUP BY 1""",
)
def isolation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst distance per cohort, and whether it stays within the margin."""
    t = both_halves(spark, sf_dir).select((F.col("user_id") % 10).alias("cohort"), S.total_variation(F.col("a"), F.col("b")).alias("tvd"))
    return t.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.max("tvd"), 9).alias("worst"), (F.max("tvd") <= 0.05).alias("stable"))


@query(
    "odds_ratio_vs_base",
    f"""WITH {PROBS_SQL}, o AS (SELECT user_id, half, max(CASE WHEN k = 'view' THEN p END) AS a, max(CASE WHEN k = 'click' THEN p END) AS b FROM probs GROUP BY ALL),
r AS (SELECT user_id % 5 AS cohort, half, a / b AS odds FROM o WHERE b > 0), base AS (SELECT median(odds) AS m FROM r WHERE half = 'a')
SELECT cohort, half, count(*)::bigint AS n, round(median(odds), 9) AS median_odds, round(median(odds) / (SELECT m FROM base), 9) AS ratio_to_base FROM r GROUP BY ALL""",
)
def odds_ratio_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median odds by cohort relative to the median of the base arm."""
    rows = probs(spark, sf_dir).select((F.col("user_id") % 5).alias("cohort"), "half", F.try_divide(S.at(F.col("v"), "view"), S.at(F.col("v"), "click")).alias("odds")).where("odds IS NOT NULL")
    base = F.broadcast(rows.where("half = 'a'").agg(F.median("odds").alias("m")))
    each = rows.groupBy("cohort", "half").agg(F.count("*").alias("n"), F.median("odds").alias("o")).join(base, F.lit(True))
    return each.select("cohort", "half", "n", F.round("o", 9).alias("median_odds"), F.round(F.try_divide(F.col("o"), F.col("m")), 9).alias("ratio_to_base"))


@query(
    "logodds_band",
    f"""WITH {PROBS_SQL}, o AS (SELECT user_id, half, floor(max(CASE WHEN k = 'view' THEN p END) * 100 + 0.5) / 100 AS a, floor(max(CASE WHEN k = 'error' THEN p END) * 100 + 0.5) / 100 AS b FROM probs GROUP BY ALL)
SELECT user_id, half, a, b, a <= 0.015 OR b <= 0.015 AS at_floor, round(ln(greatest(a, 0.005) / greatest(b, 0.005)), 9) AS log_odds,
  round(ln(greatest(a - 0.005, 0.0025) / (b + 0.005)), 9) AS low, round(ln((a + 0.005) / greatest(b - 0.005, 0.0025)), 9) AS high FROM o""",
)
def logodds_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log odds of displayed probabilities with the band that rounding to 0.01 leaves."""
    shown = lambda k: F.floor(S.at(F.col("v"), k) * 100 + 0.5) / 100.0
    rows = probs(spark, sf_dir).select("user_id", "half", shown("view").alias("a"), shown("error").alias("b"))
    a, b = F.col("a"), F.col("b")
    least = lambda x, y: F.greatest(x, F.lit(y))
    return rows.select(
        "user_id", "half", "a", "b", ((a <= 0.015) | (b <= 0.015)).alias("at_floor"), F.round(F.ln(least(a, 0.005) / least(b, 0.005)), 9).alias("log_odds"),
        F.round(F.ln(least(a - 0.005, 0.0025) / (b + 0.005)), 9).alias("low"), F.round(F.ln((a + 0.005) / least(b - 0.005, 0.0025)), 9).alias("high"),
    )


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's region; odd order keys are arm a, even ones arm b."""
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    region = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return orders.join(people, "o_custkey").join(F.broadcast(region), "n_nationkey")


_ARMS_SQL = """WITH arms AS (SELECT n_regionkey, n_nationkey, o_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
units AS (SELECT n_regionkey, o_custkey, bool_or(o_totalprice > 300000) FILTER (WHERE o_orderkey % 2 = 1) AS a, bool_or(o_totalprice > 300000) FILTER (WHERE o_orderkey % 2 = 0) AS b FROM arms GROUP BY ALL),
mc AS (SELECT n_regionkey, count(*)::bigint AS n_pairs, count_if(a AND NOT b)::bigint AS a_only, count_if(b AND NOT a)::bigint AS b_only FROM units WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
tests AS (SELECT *, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
  lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))))) END AS p FROM mc)"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, odd = F.col("o_totalprice") > 300000, F.col("o_orderkey") % 2 == 1
    return inference.paired(_arms(spark, sf_dir), ["n_regionkey"], "o_custkey", F.bool_or(F.when(odd, high)), F.bool_or(F.when(~odd, high)))


@query("mcnemar_paired", f"{_ARMS_SQL} SELECT n_regionkey, n_pairs, a_only, b_only, round(p, 9) AS p FROM tests")
def mcnemar_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact McNemar test by region over customers seen in both arms."""
    return _tests(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(
    "holm_family",
    f"""{_ARMS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, n_regionkey) AS rn, count(*) OVER () AS m FROM tests)
SELECT n_regionkey, round(p, 9) AS p, round(max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, n_regionkey ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""",
)
def holm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down correction over the regions' tests."""
    return inference.holm(_tests(spark, sf_dir), "n_regionkey", "p").select("n_regionkey", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query(
    "cross_period_sign_test",
    f"""{_ARMS_SQL}, d AS (SELECT n_regionkey, o_custkey, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) - avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS d FROM arms GROUP BY ALL),
c AS (SELECT n_regionkey, count_if(d > 0)::bigint AS a, count_if(d < 0)::bigint AS b FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT n_regionkey, a AS n_up, b AS n_down, round(least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2.0))))), 9) AS p FROM c""",
)
def cross_period_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign test on customers' differences between arms."""
    odd = F.col("o_orderkey") % 2 == 1
    d = F.avg(F.when(odd, F.col("o_totalprice"))) - F.avg(F.when(~odd, F.col("o_totalprice")))
    counts = _arms(spark, sf_dir).groupBy("n_regionkey", "o_custkey").agg(d.alias("d")).groupBy("n_regionkey").agg(F.count_if(F.col("d") > 0).alias("n_up"), F.count_if(F.col("d") < 0).alias("n_down"))
    return counts.withColumn("p", F.round(S.mcnemar(F.col("n_up"), F.col("n_down")), 9))


_BOOT_SQL = """WITH clusters AS ({clusters}),
sizes AS (SELECT g, count(*)::bigint AS n_clusters, round(sum(t)::double / sum(b), 9) AS estimate FROM clusters GROUP BY g),
drawn AS (SELECT g, t, b, q * 4 + k AS r, substr(md5(concat_ws(':', '{seed}', g, c, q)), (1 + 8 * k)::int, 8) AS u FROM clusters, range(0, 50) x(q), range(0, 4) y(k)),
means AS (SELECT g, r, sum(w * t)::double / nullif(sum(w * b), 0) AS mean FROM (SELECT *, """ + " + ".join(f"(u >= '{x}')::int" for x in inference.POISSON) + """ AS w FROM drawn) WHERE w > 0 GROUP BY ALL),
sorted AS (SELECT g, list_sort(list(mean)) AS v FROM means JOIN sizes USING (g) WHERE n_clusters >= 2 AND mean IS NOT NULL GROUP BY g),
bounds AS (SELECT g, round(v[floor(0.025 * len(v))::int + 1], 9) AS low, round(v[least(len(v) - 1, floor(0.975 * len(v))::int) + 1], 9) AS high FROM sorted)"""


@query(
    "cluster_bootstrap",
    _BOOT_SQL.format(
        clusters="SELECT c_nationkey AS g, o_custkey AS c, count_if(o_orderstatus = 'F') AS t, count(*) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL", seed="acc"
    ) + " SELECT g AS nation, n_clusters, estimate, low, high FROM sizes LEFT JOIN bounds USING (g)",
)
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finished orders by nation, customers resampled."""
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(people, "o_custkey")
    clusters = rows.groupBy("nation", "o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("t"), F.count("*").alias("b"))
    return inference.cluster_bootstrap(clusters, "nation", "o_custkey", "t", "b", 200, "acc")


_DIFF_CLUSTERS = """SELECT n_regionkey AS g, o_custkey AS c, avg((o_totalprice > 150000)::int) FILTER (WHERE o_orderkey % 2 = 1) - avg((o_totalprice > 150000)::int) FILTER (WHERE o_orderkey % 2 = 0) AS t, 1 AS b
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING t IS NOT NULL"""


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd, high = F.col("o_orderkey") % 2 == 1, (F.col("o_totalprice") > 150000).cast("int")
    d = F.avg(F.when(odd, high)) - F.avg(F.when(~odd, high))
    rows = _arms(spark, sf_dir).withColumnRenamed("n_regionkey", "region")
    clusters = rows.groupBy("region", "o_custkey").agg(d.alias("t"), F.lit(1).alias("b")).where("t IS NOT NULL")
    return inference.cluster_bootstrap(clusters, "region", "o_custkey", "t", "b", 200, "diff")


@query("paired_bootstrap", _BOOT_SQL.format(clusters=_DIFF_CLUSTERS, seed="diff") + " SELECT g AS region, n_clusters, estimate, low, high FROM sizes LEFT JOIN bounds USING (g)")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference between a customer's arms by region, with the interval."""
    return _difference(spark, sf_dir)


@query("equivalence_check", _BOOT_SQL.format(clusters=_DIFF_CLUSTERS, seed="diff") + " SELECT g AS region, low, high, low > -0.03 AND high < 0.03 AS equivalent FROM sizes LEFT JOIN bounds USING (g)")
def equivalence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the whole interval lies within the tolerance."""
    return _difference(spark, sf_dir).select("region", "low", "high", ((F.col("low") > -0.03) & (F.col("high") < 0.03)).alias("equivalent"))


@query(
    "interval_intersection",
    _BOOT_SQL.format(clusters=_DIFF_CLUSTERS, seed="diff") + " SELECT max(low) AS low, min(high) AS high, max(low) <= min(high) AS intersects FROM bounds",
)
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all regions' intervals share a value."""
    return _difference(spark, sf_dir).agg(F.max("low").alias("low"), F.min("high").alias("high"), (F.max("low") <= F.min("high")).alias("intersects"))


_BLOCKS_SQL = """WITH blocks AS (SELECT event_type, event_id * 8 // (SELECT max(event_id) + 1 FROM events) AS block,
  avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
diffs AS (SELECT event_type, block, a - b AS d, row_number() OVER (PARTITION BY event_type ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM blocks),
obs AS (SELECT event_type, n, avg(d) AS mean_diff FROM diffs GROUP BY ALL),
flips AS (SELECT event_type, m.mask, sum(CASE WHEN (m.mask >> i::int) & 1 = 0 THEN d ELSE -d END) / any_value(n) AS mean FROM diffs, LATERAL (SELECT unnest(range(0, (1 << n::int)::bigint)) AS mask) m GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    last = F.broadcast(events.agg(F.max("event_id").alias("last")))
    even = F.col("user_id") % 2 == 0
    rows = events.join(last, F.lit(True)).withColumn("block", F.expr("event_id * 8 div (last + 1)"))
    rows = rows.groupBy("event_type", "block").agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))


@query(
    "sign_flip_exact",
    f"""{_BLOCKS_SQL} SELECT event_type, any_value(o.n)::bigint AS n_blocks, round(any_value(mean_diff), 9) AS mean_diff,
  round(count_if(abs(mean) >= abs(mean_diff) - 1e-12)::double / count(*), 9) AS p FROM flips JOIN obs o USING (event_type) GROUP BY event_type""",
)
def sign_flip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact randomisation test of the mean block difference."""
    return inference.sign_flip(_blocks(spark, sf_dir), ["event_type"], "d").select("event_type", "n_blocks", F.round("mean_diff", 9).alias("mean_diff"), F.round("p", 9).alias("p"))


@query(
    "block_paired_shifts",
    f"""{_BLOCKS_SQL} SELECT event_type, block::bigint AS block, round(d, 9) AS shift, sign(d)::bigint AS direction FROM diffs""",
)
def block_paired_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment minus reference within each block."""
    return _blocks(spark, sf_dir).select("event_type", "block", F.round("d", 9).alias("shift"), F.signum("d").cast("long").alias("direction"))
