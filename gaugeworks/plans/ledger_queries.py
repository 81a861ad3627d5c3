"""Ledgers: attempts, versions, costs, roll-ups, windows and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators import ledger
from gaugeworks.plans.registry import query
from gaugeworks.tables import load


@query(
    "latency_by_condition",
    """SELECT event_type, count(*)::bigint AS n, round(median(value), 6) AS median, CASE WHEN count(*) >= 10 THEN round(list_sort(list(value))[1 + round_even(0.9 * (count(*) - 1), 0)::int], 6) END AS p90,
  round(count_if(user_id % 7 = 0)::double / count(*), 9) AS failure_rate FROM events GROUP BY event_type""",
)
def latency_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, nearest-rank p90 (withheld under ten rows) and failure rate. The p90 comes from counts per distinct value, so no group is gathered."""
    events = load(spark, sf_dir, "events")
    rank = F.bround(F.lit(0.9) * (F.col("n") - 1)).cast("long")
    whole = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg((F.col("user_id") % 7 == 0).cast("int")), 9).alias("failure_rate"))
    counts = events.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    picked = counts.withColumn("upto", upto).join(F.broadcast(whole.select("event_type", rank.alias("at"))), "event_type").where("upto > at").groupBy("event_type").agg(F.min("value").alias("p"))
    return whole.join(picked, "event_type").select("event_type", "n", "median", F.when(F.col("n") >= 10, F.round("p", 6)).alias("p90"), "failure_rate")


@query(
    "drift_halves",
    """WITH r AS (SELECT event_type, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, round(median(value) FILTER (WHERE rn <= n // 2), 6) AS early, round(median(value) FILTER (WHERE rn > n // 2), 6) AS late,
  median(value) FILTER (WHERE rn > n // 2) / median(value) FILTER (WHERE rn <= n // 2) >= 1.5 AS drifted FROM r GROUP BY event_type""",
)
def drift_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the late half against the early half in order of arrival."""
    w = Window.partitionBy("event_type")
    rows = load(spark, sf_dir, "events").select("event_type", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), F.count("*").over(w).alias("n"))
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    a, b = F.median(F.when(early, F.col("value"))), F.median(F.when(~early, F.col("value")))
    return rows.groupBy("event_type").agg(F.round(a, 6).alias("early"), F.round(b, 6).alias("late"), (F.try_divide(b, a) >= 1.5).alias("drifted"))


@query(
    "pareto_frontier",
    """WITH b AS (SELECT p_brand, p_partkey, p_retailprice, p_size, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM part)
SELECT p_brand, p_partkey, p_retailprice, p_size FROM b WHERE before IS NULL OR p_size > before""",
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts larger than every cheaper one of their brand."""
    return ledger.frontier(load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_brand", "p_retailprice", "p_size", "p_partkey")


@query("competition_rank", "SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part")
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more than the number strictly better."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.rank().over(w).cast("long").alias("rank"))


@query(
    "first_terminal_wins",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1""",
)
def first_terminal_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first settled row of each logical id stands."""
    rows = load(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "event_type", "event_id", "value", "ts")
    return ledger.first_by(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    "latest_raw",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::int DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of the wanted status, else the last row."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ledger.first_by(rows, ["user_id"], [F.desc(F.col("event_type") == "purchase"), F.desc("event_id")])


@query("active_pointer", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS active, count(*)::bigint AS n_versions FROM events GROUP BY user_id")
def active_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last pointer of a history of pointers."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("active"), F.count("*").alias("n_versions"))


@query(
    "pointer_resolution",
    """SELECT a.l_orderkey, a.l_linenumber, coalesce(CASE WHEN b.l_linestatus = 'F' THEN b.l_quantity END, a.l_quantity) AS quantity, b.l_linestatus IS NOT NULL AND b.l_linestatus = 'F' AS recovered
FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_returnflag = 'R'""",
)
def pointer_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flagged R point at the next line; its value counts if that line has settled."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    pointed = rows.withColumn("at", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") + 1))
    target = rows.select("l_orderkey", F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("s"))
    settled = F.coalesce(F.col("s") == "F", F.lit(False))
    found = pointed.join(target, ["l_orderkey", "at"], "left")
    return found.select("l_orderkey", "l_linenumber", F.when(settled, F.col("q")).otherwise(F.col("l_quantity")).alias("quantity"), settled.alias("recovered"))


_VERSION_SQL = """WITH n AS (SELECT l_orderkey, bool_and(l_returnflag <> 'N') AS complete FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
o AS (SELECT l_orderkey, bool_and(l_tax < 0.07) AS complete FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1),
v AS (SELECT l_orderkey, CASE WHEN coalesce(n.complete, false) THEN 'new' WHEN coalesce(o.complete, false) THEN 'old' ELSE 'none' END AS version FROM n FULL JOIN o USING (l_orderkey))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax", "l_quantity")
    new = rows.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "N").alias("complete"))
    old = rows.where("l_linenumber >= 2").groupBy("l_orderkey").agg(F.bool_and(F.col("l_tax") < 0.07).alias("complete"))
    return ledger.best_version(new, old, "l_orderkey")


@query("version_coalesce", f"{_VERSION_SQL} SELECT version, count(*)::bigint AS n_cells FROM v GROUP BY version")
def version_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the version that counts."""
    return _versions(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n_cells"))


@query(
    "active_summary",
    f"""{_VERSION_SQL} SELECT o_orderstatus, version, count(*)::bigint AS n, CASE WHEN version <> 'none' THEN round(avg((o_totalprice > 150000)::int), 9) END AS accuracy
FROM v JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderstatus, version""",
)
def active_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by row class, given only where a complete version exists."""
    rows = _versions(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    right = F.avg((F.col("o_totalprice") > 150000).cast("int"))
    return rows.groupBy("o_orderstatus", "version").agg(F.count("*").alias("n"), F.when(F.col("version") != "none", F.round(right, 9)).alias("accuracy"))


@query(
    "override_overlay",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderstatus = 'P' THEN 0.0 END, l_discount) AS l_discount, l_discount AS original_l_discount, o_orderstatus IS NOT NULL AND o_orderstatus = 'P' AS overridden
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def override_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of pending orders are overridden; originals stay beside them."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    fixes = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0.0).alias("l_discount"))
    return ledger.overlay(rows, fixes, ["l_orderkey"], "l_discount")


@query(
    "cost_reported_vs_estimated",
    """SELECT l_returnflag, count(*)::bigint AS n, round(sum(coalesce(CASE WHEN l_tax > 0.02 THEN l_extendedprice END, CASE WHEN l_discount > 0 THEN l_quantity * p_retailprice END)), 2) AS cost,
  count_if(l_tax > 0.02)::bigint AS n_reported, count_if(l_tax <= 0.02 AND l_discount > 0)::bigint AS n_estimated, count_if(l_tax <= 0.02 AND l_discount <= 0)::bigint AS n_unknown
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""",
)
def cost_reported_vs_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reported cost beats an estimated one; unknown costs are counted, never taken as zero."""
    prices = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_tax", "l_discount", "l_quantity", "l_extendedprice").join(prices, "l_partkey")
    reported, guess = F.col("l_tax") > 0.02, F.col("l_discount") > 0
    cost = F.when(reported, F.col("l_extendedprice")).when(guess, F.col("l_quantity") * F.col("p_retailprice"))
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum(cost), 2).alias("cost"), F.count_if(reported).alias("n_reported"), F.count_if(~reported & guess).alias("n_estimated"), F.count_if(~reported & ~guess).alias("n_unknown")
    )


@query(
    "billing_rollup",
    """SELECT source, count(*)::bigint AS calls, sum(units)::bigint AS units, round(sum(usd), 2) AS usd FROM (
  SELECT 'orders' AS source, NULL AS units, o_totalprice AS usd FROM orders UNION ALL SELECT 'lines', l_quantity::bigint, l_extendedprice FROM lineitem UNION ALL SELECT 'events', user_id, NULL FROM events) GROUP BY source""",
)
def billing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, units and money by source; a source that reports none has null, not zero."""
    orders = load(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_totalprice").alias("usd"))
    lines = load(spark, sf_dir, "lineitem").select(F.lit("lines").alias("source"), F.col("l_quantity").cast("long").alias("units"), F.col("l_extendedprice").alias("usd"))
    events = load(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("user_id").alias("units"))
    every = orders.unionByName(lines, allowMissingColumns=True).unionByName(events, allowMissingColumns=True)
    return every.groupBy("source").agg(F.count("*").alias("calls"), F.sum("units").alias("units"), F.round(F.sum("usd"), 2).alias("usd"))


@query(
    "heatmap_pivot",
    """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS "P"
FROM orders GROUP BY 1""",
)
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by columns; the columns are given, so no pass looks for them, and a missing cell is null."""
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query(
    "grouping_sets_cells",
    "SELECT o_orderpriority, o_orderstatus, count(*)::bigint AS n, round(avg((o_totalprice > 150000)::int), 9) AS rate FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())",
)
def grouping_sets_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and pooled rows in one pass."""
    return load(spark, sf_dir, "orders").groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], []], "o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("int")), 9).alias("rate")
    )


@query(
    "violation_codes",
    """WITH v AS (SELECT unnest(list_filter([CASE WHEN value < 1 THEN 'too_small' END, CASE WHEN value > 200 THEN 'too_large' END, CASE WHEN event_type = 'error' THEN 'error_type' END,
  CASE WHEN length(props) < 9 THEN 'short_props' END, CASE WHEN user_id % 50 = 0 THEN 'probe_user' END], lambda x: x IS NOT NULL)) AS code, user_id FROM events)
SELECT code, count(*)::bigint AS n, count(DISTINCT user_id)::bigint AS n_users FROM v GROUP BY code""",
)
def violation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's broken rules as an array, exploded and counted; nothing is repaired."""
    value = F.col("value")
    codes = F.array_compact(F.array(
        F.when(value < 1, "too_small"), F.when(value > 200, "too_large"), F.when(F.col("event_type") == "error", "error_type"),
        F.when(F.length("props") < 9, "short_props"), F.when(F.col("user_id") % 50 == 0, "probe_user"),
    ))
    return load(spark, sf_dir, "events").select("user_id", F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    "condition_parse",
    """WITH c AS (SELECT 'role=' || event_type || ';user=' || (user_id % 20)::varchar || ';k=' || json_extract_string(props, '$.k') AS condition FROM events)
SELECT regexp_extract(condition, 'role=([^;]*)', 1) AS role, regexp_extract(condition, 'user=([^;]*)', 1)::bigint AS cohort, count(*)::bigint AS n, round(avg(regexp_extract(condition, 'k=([^;]*)$', 1)::bigint), 9) AS mean_k FROM c GROUP BY ALL""",
)
def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k=v;k=v strings, built and parsed again."""
    text = F.concat(F.lit("role="), "event_type", F.lit(";user="), (F.col("user_id") % 20).cast("string"), F.lit(";k="), F.get_json_object("props", "$.k"))
    parsed = load(spark, sf_dir, "events").select(F.str_to_map(text, F.lit(";"), F.lit("=")).alias("m"))
    return parsed.groupBy(F.col("m")["role"].alias("role"), F.col("m")["user"].cast("long").alias("cohort")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("m")["k"].cast("long")), 9).alias("mean_k"))


@query(
    "sliding_rate",
    """SELECT event_id, user_id, count(*) OVER w AS n_in_window, round(sum(value) OVER w, 6) AS sum_in_window FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW)""",
)
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and units of a user in the hour up to each request."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.count("*").over(w).alias("n_in_window"), F.round(F.sum("value").over(w), 6).alias("sum_in_window"))


@query(
    "loop_detection",
    """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count_if(event_type = a AND a = b)::bigint AS n_loops, min(CASE WHEN event_type = a AND a = b THEN event_id END) AS first_loop FROM l GROUP BY user_id""",
)
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal steps in a row."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = F.col("event_type")
    loop = (e == F.lag(e).over(w)) & (e == F.lag(e, 2).over(w))
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(loop, F.lit(False)).alias("loop"))
    return rows.groupBy("user_id").agg(F.count_if("loop").alias("n_loops"), F.min(F.when(F.col("loop"), F.col("event_id"))).alias("first_loop"))


@query(
    "recent_word_ban",
    """SELECT user_id, event_id, coalesce(list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))), []) AS banned FROM events""",
)
def recent_word_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's last four steps held."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, -1)
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.sort_array(F.collect_set("event_type").over(w)).alias("banned"))


@query(
    "running_budget",
    """WITH r AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events)
SELECT user_id, event_id, round(held, 6) AS held, held <= 500 AS admitted FROM r""",
)
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations of each user summed in order; those beyond the budget aren't admitted."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum("value").over(w)
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.round(held, 6).alias("held"), (held <= 500).alias("admitted"))


@query(
    "last_block_holdout",
    """WITH b AS (SELECT event_id, event_type, value, date_trunc('day', ts) AS day FROM events), d AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY day) AS block FROM b),
m AS (SELECT event_type, max(block) AS blocks FROM d GROUP BY 1)
SELECT event_type, count_if(block <= blocks - greatest(1, round_even(0.25 * blocks, 0)))::bigint AS n_train, count_if(block > blocks - greatest(1, round_even(0.25 * blocks, 0)))::bigint AS n_test,
  round(avg(value) FILTER (WHERE block > blocks - greatest(1, round_even(0.25 * blocks, 0))), 6) AS test_mean FROM d JOIN m USING (event_type) GROUP BY event_type""",
)
def last_block_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quarter of each type's days is held out. Days are numbered among themselves, so no window runs over rows."""
    events = load(spark, sf_dir, "events").select("event_type", "value", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    days = events.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    w = Window.partitionBy("event_type")
    ranked = days.withColumn("block", F.row_number().over(w.orderBy("day"))).withColumn("blocks", F.count("*").over(w))
    test = F.col("block") > F.col("blocks") - F.greatest(F.lit(1), F.bround(0.25 * F.col("blocks")))
    held = lambda c: F.sum(F.when(test, F.col(c)))
    return ranked.groupBy("event_type").agg(
        F.sum(F.when(~test, F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("n_test"), F.round(held("s") / held("n"), 6).alias("test_mean")
    )


@query(
    "largest_remainder",
    """WITH s AS (SELECT o_orderstatus AS g, o_orderpriority AS name, count(*) AS w FROM orders GROUP BY ALL), q AS (SELECT *, 100.0::double * w / sum(w) OVER (PARTITION BY g) AS q FROM s),
f AS (SELECT *, floor(q) AS f, 100 - sum(floor(q)) OVER (PARTITION BY g) AS left_over FROM q)
SELECT g AS o_orderstatus, name AS o_orderpriority, (f + (row_number() OVER (PARTITION BY g ORDER BY round(q - f, 9) DESC, name) <= left_over)::int)::bigint AS seats FROM f""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seats shared out by priority within each status."""
    shares = load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("w"))
    return ledger.apportion(shares, "o_orderstatus", "o_orderpriority", "w", 100).drop("w")


@query(
    "round_robin",
    "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part QUALIFY turn <= 3",
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of taking one part per brand; order by turn and brand to interleave."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(w).cast("long").alias("turn")).where("turn <= 3")


@query(
    "composite_key_answers",
    """SELECT o_orderpriority, count(*)::bigint AS n, count_if(l_returnflag = CASE WHEN l_linenumber % 2 = 0 THEN 'R' ELSE 'N' END)::bigint AS n_strict, count_if(lower(l_returnflag) IN ('r', 'n'))::bigint AS n_recovered, round(sum(l_extendedprice) / count(*), 4) AS cost_each
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def composite_key_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers matched on (order, line) against a key of the same grain, strictly and leniently."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_extendedprice")
    key = rows.select("o_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("N").alias("expected")).distinct()
    found = rows.join(key, ["o_orderkey", "l_linenumber"]).join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return found.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == F.col("expected")).alias("n_strict"), F.count_if(F.lower("l_returnflag").isin("r", "n")).alias("n_recovered"),
        F.round(F.sum("l_extendedprice") / F.count("*"), 4).alias("cost_each"),
    )


@query(
    "expected_cells",
    """WITH e AS (SELECT o_orderkey, o_orderstatus, unnest(range(1, 8)) AS cell FROM orders),
l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count_if(l_quantity >= 25) AS k FROM lineitem GROUP BY ALL)
SELECT o_orderstatus, count(*)::bigint AS n_expected, coalesce(sum(n), 0)::bigint AS n_found, coalesce(sum(k), 0)::bigint AS n_right FROM e LEFT JOIN l ON l_orderkey = o_orderkey AND l_linenumber = cell GROUP BY 1""",
)
def expected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expected cell of a grid, found or not. Orders are exploded after their lines are counted, so expected cells are never shuffled."""
    cells = load(spark, sf_dir, "lineitem").where("l_linenumber BETWEEN 1 AND 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("found"), F.count_if(F.col("l_quantity") >= 25).alias("right"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(cells, "o_orderkey", "left")
    none = F.lit(0).cast("long")
    return rows.groupBy("o_orderstatus").agg((F.count("*") * 7).alias("n_expected"), F.sum(F.coalesce("found", none)).alias("n_found"), F.sum(F.coalesce("right", none)).alias("n_right"))


@query(
    "conditional_medians",
    """SELECT event_type, round(median(value) FILTER (WHERE user_id % 2 = 0), 6) AS warm, round(median(value) FILTER (WHERE user_id % 2 = 1), 6) AS cold,
  round((arg_max(value, event_id) - arg_min(value, event_id)) / (max(event_id) - min(event_id)), 9) AS marginal, round(max(value) - min(value), 6) AS span FROM events GROUP BY event_type""",
)
def conditional_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by condition and the marginal change from the first to the last row."""
    even, value = F.col("user_id") % 2 == 0, F.col("value")
    slope = (F.max_by("value", "event_id") - F.min_by("value", "event_id")) / (F.max("event_id") - F.min("event_id"))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.median(F.when(even, value)), 6).alias("warm"), F.round(F.median(F.when(~even, value)), 6).alias("cold"), F.round(slope, 9).alias("marginal"), F.round(F.max(value) - F.min(value), 6).alias("span")
    )


@query(
    "price_lookup_estimates",
    """SELECT p_brand, count(*)::bigint AS n, round(sum(l_quantity * p_retailprice), 2) AS expected, round(sum(50 * p_retailprice), 2) AS worst_case, CASE WHEN sum(l_quantity * p_retailprice) < 1e6 THEN 'low' WHEN sum(l_quantity * p_retailprice) < 1e8 THEN 'mid' ELSE 'high' END AS band
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def price_lookup_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and worst-case spend from a price table, with its band."""
    prices = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    spend = F.sum(F.col("l_quantity") * F.col("p_retailprice"))
    return load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(prices, "l_partkey").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(spend, 2).alias("expected"), F.round(F.sum(50 * F.col("p_retailprice")), 2).alias("worst_case"),
        F.when(spend < 1e6, "low").when(spend < 1e8, "mid").otherwise("high").alias("band"),
    )


@query(
    "union_run_summary",
    "SELECT 'run' || (event_id % 3)::varchar AS run_id, event_type AS status, count(*)::bigint AS n, count(DISTINCT user_id)::bigint AS n_users FROM events GROUP BY ALL",
)
def union_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs put together by name and summed up by run and status."""
    events = load(spark, sf_dir, "events")
    runs = [events.where(F.col("event_id") % 3 == k).select(F.lit(f"run{k}").alias("run_id"), F.col("event_type").alias("status"), "user_id") for k in range(3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("run_id", "status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    "stratum_tables",
    "SELECT lang, source, count(*)::bigint AS n, min(doc_id) AS first_id, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ALL",
)
def stratum_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of strata."""
    return load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query(
    "case_rules",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN 'non_terminal' WHEN o_totalprice < 50000 THEN 'settled_non_ok' WHEN o_orderpriority LIKE '1%' THEN 'keep_original' WHEN o_orderkey % 5 = 0 THEN 'salvage' ELSE 'rerun' END AS rerun_class,
  count(*)::bigint AS n, count_if(o_orderkey % 600 IN (0, 429, 500, 502, 503, 504))::bigint AS n_retryable, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END), 2) AS corrected FROM orders GROUP BY 1""",
)
def case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules; the first that holds names the class."""
    cls = (
        F.when(F.col("o_orderstatus") == "P", "non_terminal").when(F.col("o_totalprice") < 50000, "settled_non_ok").when(F.col("o_orderpriority").startswith("1"), "keep_original")
        .when(F.col("o_orderkey") % 5 == 0, "salvage").otherwise("rerun")
    )
    return load(spark, sf_dir, "orders").groupBy(cls.alias("rerun_class")).agg(
        F.count("*").alias("n"), F.count_if((F.col("o_orderkey") % 600).isin(0, 429, 500, 502, 503, 504)).alias("n_retryable"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))), 2).alias("corrected"),
    )


@query(
    "admission_reasons",
    """SELECT CASE WHEN text IS NULL OR length(text) < 20 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN position('chance=' IN text) > 0 THEN 'chance' WHEN n_chars > 8000 THEN 'too_long' ELSE 'admitted' END AS reason, count(*)::bigint AS n, min(doc_id) AS first_id
FROM documents GROUP BY 1""",
)
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the reason that keeps them out."""
    text = F.col("text")
    reason = (
        F.when(text.isNull() | (F.length(text) < 20), "too_short").when(~F.col("lang").isin("en", "de"), "language").when(F.contains(text, F.lit("chance=")), "chance")
        .when(F.col("n_chars") > 8000, "too_long").otherwise("admitted")
    )
    return load(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "recoverability_inventory",
    """SELECT role, count(*)::bigint AS n, count_if(length(text) >= 200)::bigint AS n_complete, count_if(length(text) BETWEEN 50 AND 199)::bigint AS n_partial, count_if(length(text) < 50)::bigint AS n_rerun FROM conversations GROUP BY role""",
)
def recoverability_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each cell is complete, partial, or to be run again."""
    n = F.length("text")
    return load(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(n >= 200).alias("n_complete"), F.count_if(n.between(50, 199)).alias("n_partial"), F.count_if(n < 50).alias("n_rerun"))


@query(
    "set_and_cover_checks",
    """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM (SELECT k FROM o INTERSECT SELECT k FROM c))::bigint AS n_both, (SELECT count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM o))::bigint AS n_only_asked,
  (SELECT count(*) FROM (SELECT k FROM o EXCEPT SELECT k FROM c))::bigint AS n_only_found, (SELECT count(*) FROM c)::bigint AS n_asked""",
)
def set_and_cover_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, differences and cover of two id sets in one full join of distinct keys."""
    found = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("f", F.lit(True))
    asked = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("a"))
    return asked.join(found, "k", "full").agg(
        F.count_if(F.col("a") & F.col("f")).alias("n_both"), F.count_if(F.col("a") & F.col("f").isNull()).alias("n_only_asked"),
        F.count_if(F.col("f") & F.col("a").isNull()).alias("n_only_found"), F.count("a").alias("n_asked"),
    )


@query("stored_answer_replay", "SELECT sha256(o_orderpriority || '|' || o_orderstatus) AS request, count(*)::bigint AS n, round(avg(o_totalprice), 4) AS answer FROM orders GROUP BY 1")
def stored_answer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the hash of what was asked, with the stored answer."""
    asked = F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256)
    return load(spark, sf_dir, "orders").groupBy(asked.alias("request")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("answer"))


