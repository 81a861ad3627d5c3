"""Scoring: all-requested accuracy, proper scores, calibration, risk-coverage, weighted and stratified scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import scoring
from gaugeworks.plans.registry import query
from gaugeworks.plans.views import PROBS_SQL, SCORED_SQL, probs, scored
from gaugeworks.tables import load

Z = S.Z95


def wilson_sql(k: str, n: str) -> str:
    """The two Wilson bounds of k in n, rounded."""
    p = f"(({k})::double / ({n}))"
    den, centre = f"(1 + {Z * Z} / ({n}))", f"({p} + {Z * Z / 2} / ({n}))"
    half = f"{Z} * sqrt({p} * (1 - {p}) / ({n}) + {Z * Z / 4} / (({n})::double * ({n})))"
    return f"round(greatest(0.0, ({centre} - {half}) / {den}), 9) AS wilson_low, round(least(1.0, ({centre} + {half}) / {den}), 9) AS wilson_high"


@query(
    "all_requested_accuracy",
    f"""WITH {SCORED_SQL}
SELECT gold, count(*)::bigint AS n_requested, count_if(answered)::bigint AS n_answered, count_if(correct)::bigint AS n_correct,
       round(count_if(correct)::double / count(*), 9) AS accuracy, {wilson_sql('count_if(correct)', 'count(*)')}
FROM scored GROUP BY gold""",
)
def all_requested_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over every requested item: an item without a result counts as wrong."""
    return scoring.accuracy(scored(spark, sf_dir), ["gold"])


@query(
    "conditional_vs_all_block",
    f"""WITH {SCORED_SQL}
SELECT toxic, count(*)::bigint AS n_requested, count_if(answered)::bigint AS n_valid, count_if(NOT answered)::bigint AS n_missing,
       count_if(answered AND NOT correct)::bigint AS n_wrong, round(count_if(correct)::double / count(*), 9) AS accuracy_all,
       round(count_if(correct)::double / nullif(count_if(answered), 0), 9) AS accuracy_valid
FROM scored GROUP BY toxic""",
)
def conditional_vs_all_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all requested items and over the answered ones alone."""
    c, a = F.count_if("correct"), F.count_if("answered")
    return scored(spark, sf_dir).groupBy("toxic").agg(
        F.count("*").alias("n_requested"), a.alias("n_valid"), F.count_if(~F.col("answered")).alias("n_missing"),
        F.count_if(F.col("answered") & ~F.col("correct")).alias("n_wrong"),
        F.round(S.ratio(c, F.count("*")), 9).alias("accuracy_all"), F.round(S.ratio(c, a), 9).alias("accuracy_valid"),
    )


@query(
    "missing_and_unknown_ids",
    """SELECT 'missing' AS kind, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars <= 4000)
UNION ALL SELECT 'unknown', doc_id FROM documents WHERE n_chars <= 4000 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_and_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested items without a result, and results that nobody requested."""
    asked, got = load(spark, sf_dir, "labels").select("doc_id"), load(spark, sf_dir, "documents").where("n_chars <= 4000").select("doc_id")
    missing = asked.join(got, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id")
    return missing.unionByName(got.join(asked, "doc_id", "left_anti").select(F.lit("unknown").alias("kind"), "doc_id"))


@query(
    "semi_join_matched_subset",
    """SELECT o_orderstatus, count(*)::bigint AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_orderstatus""",
)
def semi_join_matched_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows restricted to a matched subset of keys."""
    subset = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = load(spark, sf_dir, "orders").join(subset, "o_custkey", "left_semi")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "duplicate_payload_pairs",
    """WITH g AS (SELECT sha256(d.text) AS payload, l.quality AS gold FROM documents d JOIN labels l USING (doc_id)),
cells AS (SELECT payload, gold, count(*) AS n FROM g GROUP BY ALL)
SELECT payload, sum(n)::bigint AS n_items, ((sum(n) * (sum(n) - 1)) / 2)::bigint AS n_pairs, ((sum(n) * sum(n) - sum(n * n)) / 2)::bigint AS n_conflicting
FROM cells GROUP BY payload HAVING sum(n) > 1""",
)
def duplicate_payload_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items with the same payload, and how many of them disagree on gold, from counts alone: no pair is listed."""
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select(F.sha2("text", 256).alias("payload"), F.col("quality").alias("gold"))
    return scoring.duplicate_pairs(rows, "payload", "gold")


@query(
    "brier_logloss_by_type",
    f"""WITH {PROBS_SQL}, last AS (
  SELECT user_id, CASE WHEN event_id < (SELECT max(event_id) + 1 FROM events) / 2.0 THEN 'a' ELSE 'b' END AS half, max_by(event_type, event_id) AS gold
  FROM events GROUP BY ALL
), scored AS (SELECT l.gold, p.user_id, p.half, sum(power(p - (k = gold)::int, 2)) AS brier, sum(CASE WHEN k = gold THEN p END) AS pg
  FROM probs p JOIN last l USING (user_id, half) GROUP BY ALL)
SELECT gold, count(*)::bigint AS n, round(avg(brier), 9) AS brier, round(avg(-ln(greatest(pg, 1e-12))), 9) AS log_loss, round(avg(pg), 9) AS p_gold FROM scored GROUP BY gold""",
)
def brier_logloss_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper scores of each user's distribution against their last event."""
    events = load(spark, sf_dir, "events")
    bound = F.broadcast(events.agg(F.max("event_id").alias("last")))
    gold = events.join(bound, F.lit(True)).withColumn("half", F.when(F.col("event_id") < (F.col("last") + 1) / 2.0, "a").otherwise("b"))
    gold = gold.groupBy("user_id", "half").agg(F.max_by("event_type", "event_id").alias("gold"))
    rows = probs(spark, sf_dir).join(gold, ["user_id", "half"])
    pg = S.at(F.col("v"), F.col("gold"))
    return rows.groupBy("gold").agg(
        F.count("*").alias("n"), F.round(F.avg(S.brier_vector(F.col("v"), F.col("gold"))), 9).alias("brier"),
        F.round(F.avg(S.log_loss_clipped(pg)), 9).alias("log_loss"), F.round(F.avg(pg), 9).alias("p_gold"),
    )


@query(
    "exact_log_loss",
    f"""WITH {SCORED_SQL}
SELECT source, count(*)::bigint AS n, round(avg(CASE WHEN CASE WHEN gold = 1 THEN p - 0.01 ELSE 1 - p END <= 0 THEN 'Infinity'::double
  ELSE -ln(CASE WHEN gold = 1 THEN p - 0.01 ELSE 1 - p END) END), 9) AS log_loss, round(avg(power(p - gold, 2)), 9) AS brier
FROM scored WHERE answered GROUP BY source""",
)
def exact_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss that is infinite where the stated probability of the gold answer is 0."""
    said = F.when(F.col("gold") == 1, F.col("p") - 0.01).otherwise(1 - F.col("p"))
    return scored(spark, sf_dir).where("answered").groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg(S.log_loss(said)), 9).alias("log_loss"), F.round(F.avg(S.brier_binary(F.col("p"), F.col("gold"))), 9).alias("brier"),
    )


_BINS_SQL = f"""WITH {SCORED_SQL}, b AS (
  SELECT least(floor(p * 10), 9)::int AS bin, count(*) AS n, avg(p) AS mean_p, avg(correct::int) AS rate FROM scored WHERE answered GROUP BY bin
)"""


@query("reliability_bins", f"{_BINS_SQL} SELECT bin, n::bigint AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM b")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-width bins, half-open but for the last; empty ones are left out."""
    bins = scoring.reliability(scored(spark, sf_dir).where("answered"), "p", "correct", 10)
    return bins.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query("reliability_ece", f"{_BINS_SQL} SELECT sum(n)::bigint AS n, round(sum(n * abs(mean_p - rate)) / sum(n), 9) AS ece FROM b")
def reliability_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over ten bins."""
    return scoring.ece(scoring.reliability(scored(spark, sf_dir).where("answered"), "p", "correct", 10))


@query(
    "calibration_block",
    f"""WITH {SCORED_SQL}
SELECT lang, count(*)::bigint AS n, round(avg(p) FILTER (WHERE correct), 9) AS p_when_right, round(avg(p) FILTER (WHERE NOT correct), 9) AS p_when_wrong,
  round(avg(power(p - correct::int, 2)), 9) AS brier FROM scored WHERE answered GROUP BY lang""",
)
def calibration_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated probability split by correctness."""
    p, c = F.col("p"), F.col("correct")
    return scored(spark, sf_dir).where("answered").groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(c, p)), 9).alias("p_when_right"), F.round(F.avg(F.when(~c, p)), 9).alias("p_when_wrong"),
        F.round(F.avg(S.brier_binary(p, c)), 9).alias("brier"),
    )


@query(
    "risk_coverage",
    f"""WITH {SCORED_SQL}
SELECT source, doc_id, p, row_number() OVER w AS covered, round((sum(correct::int) OVER w)::double / row_number() OVER w, 9) AS accuracy
FROM scored WHERE answered WINDOW w AS (PARTITION BY source ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)""",
)
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the most confident items, one step a row, within each source."""
    return scoring.risk_coverage(scored(spark, sf_dir).where("answered"), "source", "p", "correct", "doc_id")


@query(
    "rps_ordinal",
    """WITH levels AS (SELECT o_orderpriority AS pr, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS level FROM orders GROUP BY o_orderpriority),
base AS (SELECT l.level AS j, count(*)::double / (SELECT count(*) FROM orders) AS p FROM orders o JOIN levels l ON o.o_orderpriority = l.pr GROUP BY l.level),
cdf AS (SELECT j, sum(p) OVER (ORDER BY j) AS c FROM base),
each AS (SELECT l.level, sum(power(c.c - (l.level <= c.j)::int, 2)) / (SELECT count(*) - 1 FROM base) AS rps,
         (SELECT sum(b.p * abs(b.j - l.level)) FROM base b) AS mae FROM levels l CROSS JOIN cdf c GROUP BY l.level)
SELECT o.o_orderstatus, count(*)::bigint AS n, round(avg(e.rps), 9) AS rps, round(avg(e.mae), 9) AS expected_mae
FROM orders o JOIN levels l ON o.o_orderpriority = l.pr JOIN each e USING (level) GROUP BY o.o_orderstatus""",
)
def rps_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked probability score and expected distance of the overall distribution over order priorities."""
    rows = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    # One row: at most a handful of priorities.
    shares = rows.groupBy("o_orderpriority").count().agg(F.sort_array(F.collect_list(F.struct("o_orderpriority", "count"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    shares = shares.select(F.transform("s", lambda x: x["o_orderpriority"]).alias("names"), F.transform("s", lambda x: x["count"] / total).alias("p"))
    level = (F.array_position("names", F.col("o_orderpriority")) - 1).cast("int")
    each = rows.join(F.broadcast(shares), F.lit(True)).withColumn("level", level)
    off = F.aggregate(F.transform("p", lambda p, i: p * F.abs(i - F.col("level"))), F.lit(0.0), lambda a, x: a + x)
    return each.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.avg(S.rank_probability(F.col("p"), F.col("level"))), 9).alias("rps"), F.round(F.avg(off), 9).alias("expected_mae"),
    )


@query(
    "weighted_scores",
    f"""WITH {PROBS_SQL}
SELECT half, count(*)::bigint AS n, count_if(m < 2)::bigint AS n_excluded, round(avg(CASE WHEN m >= 2 THEN p END), 9) AS mean_p,
  round(avg(CASE WHEN m >= 2 THEN p * p END), 9) AS mean_pair FROM probs WHERE k = 'view' GROUP BY half""",
)
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of the expected answer, with exclusions counted; mean_pair is the product over two read-outs."""
    p, fit = S.at(F.col("v"), "view"), F.col("m") >= 2
    return probs(spark, sf_dir).groupBy("half").agg(
        F.count("*").alias("n"), F.count_if(~fit).alias("n_excluded"), F.round(F.avg(F.when(fit, p)), 9).alias("mean_p"), F.round(F.avg(F.when(fit, p * p)), 9).alias("mean_pair"),
    )


@query(
    "stratified_estimate",
    """WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n, count_if(c_acctbal > 0) AS k FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
w AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1)
SELECT count(*)::bigint AS n_strata, sum(n)::bigint AS n, round(sum(size * (k::double / n)) / sum(size), 9) AS estimate FROM s JOIN w USING (stratum)""",
)
def stratified_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of positive balances from every third customer, weighted by segment sizes."""
    people = load(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "stratum")
    sizes = people.groupBy("stratum").agg(F.count("*").alias("size"))
    return scoring.stratified(people.where("c_custkey % 3 = 0").withColumn("correct", F.col("c_acctbal") > 0), sizes, "stratum", "correct")


@query("kish_ess", "WITH c AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) SELECT sum(m)::bigint AS n, count(*)::bigint AS n_clusters, round(sum(m)::double * sum(m) / sum(m * m), 9) AS ess FROM c")
def kish_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective sample size of orders clustered by customer."""
    sizes = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"))
    m, square = F.sum("m").cast("double"), F.sum(F.col("m") * F.col("m"))
    return sizes.agg(F.sum("m").alias("n"), F.count("*").alias("n_clusters"), F.round(m * m / square, 9).alias("ess"))


_CELL = "l_quantity >= 5"


@query("digit_all_of", f"SELECT l_orderkey, count(*)::bigint AS n_digits, bool_and({_CELL}) AS correct FROM lineitem GROUP BY l_orderkey")
def digit_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item is right only if each of its digits is."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_digits"), F.bool_and(F.expr(_CELL)).alias("correct"))


@query(
    "grid_task_rollup",
    f"""WITH grid AS (SELECT l_orderkey, count(*) AS cells, count_if({_CELL}) AS right_cells, bool_and({_CELL}) AS ok FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*)::bigint AS n_grids, coalesce(sum(cells), 0)::bigint AS n_cells, coalesce(sum(right_cells), 0)::bigint AS n_right,
  count_if(coalesce(ok, false))::bigint AS n_grids_ok, bool_and(coalesce(ok, false)) AS task_ok
FROM orders LEFT JOIN grid ON o_orderkey = l_orderkey GROUP BY o_custkey""",
)
def grid_task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to grids to tasks; a missing grid is wrong."""
    grids = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("cells"), F.count_if(F.expr(_CELL)).alias("right_cells"), F.bool_and(F.expr(_CELL)).alias("ok")
    )
    ok = F.coalesce("ok", F.lit(False))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(grids, "o_orderkey", "left").groupBy("o_custkey").agg(
        F.count("*").alias("n_grids"), F.coalesce(F.sum("cells"), F.lit(0)).alias("n_cells"), F.coalesce(F.sum("right_cells"), F.lit(0)).alias("n_right"),
        F.count_if(ok).alias("n_grids_ok"), F.bool_and(ok).alias("task_ok"),
    )


@query(
    "chance_adjusted_by_group",
    f"""WITH {SCORED_SQL}, g AS (SELECT lang, count(*) AS n, avg(correct::int) AS a FROM scored WHERE answered GROUP BY lang)
SELECT lang, n::bigint AS n, round(a, 9) AS accuracy, round((a - 0.25) / 0.75, 9) AS adjusted FROM g""",
)
def chance_adjusted_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy above chance by group."""
    a = F.avg(F.col("correct").cast("int"))
    return scored(spark, sf_dir).where("answered").groupBy("lang").agg(
        F.count("*").alias("n"), F.round(a, 9).alias("accuracy"), F.round(S.chance_adjusted(a, F.lit(0.25)), 9).alias("adjusted")
    )


@query(
    "gold_extract_explode",
    """WITH q AS (SELECT doc_id, 'quality' AS qid, quality AS gold FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT qid, count(*)::bigint AS n, count_if(gold = 1)::bigint AS n_yes, count_if((CASE WHEN qid = 'toxic' THEN 0 ELSE (n_chars >= 500)::int END) = gold)::bigint AS n_correct
FROM q JOIN documents USING (doc_id) GROUP BY qid""",
)
def gold_extract_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items carry a map of questions to gold answers; it is exploded and each question scored by its own rule."""
    items = load(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("gold"))
    asked = items.select("doc_id", F.explode("gold").alias("qid", "gold")).join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    said = F.when(F.col("qid") == "toxic", 0).otherwise((F.col("n_chars") >= 500).cast("int"))
    return asked.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == 1).alias("n_yes"), F.count_if(said == F.col("gold")).alias("n_correct"))


@query(
    "score_validity_reasons",
    f"""WITH {PROBS_SQL}, v AS (SELECT user_id, half, any_value(m) AS m, sum(round(p, 1)) AS s, max(round(p, 1)) AS top FROM probs GROUP BY ALL)
SELECT reason, count(*)::bigint AS n FROM (SELECT CASE WHEN m < 2 THEN 'too_few' WHEN abs(s - 1) > 0.05 THEN 'sum_off' WHEN top >= 1 THEN 'certain' ELSE 'ok' END AS reason FROM v) GROUP BY reason""",
)
def score_validity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a displayed distribution can't be scored."""
    shown = F.transform("v", lambda x: F.round(x["p"], 1))
    total = F.aggregate(shown, F.lit(0.0), lambda s, x: s + x)
    reason = F.when(F.col("m") < 2, "too_few").when(F.abs(total - 1) > 0.05, "sum_off").when(F.array_max(shown) >= 1, "certain").otherwise("ok")
    return probs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "item_level_collapse",
    """WITH i AS (SELECT l_orderkey, count(*) AS n, count_if(l_discount > 0.05) AS k, bool_and(l_discount > 0.05) AS every_one FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*)::bigint AS n_items, sum(n)::bigint AS n_rows, round(avg(k::double / n), 9) AS mean_rate, count_if(every_one)::bigint AS n_every
FROM i JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def item_level_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measures count once an item; n_every counts items that are right each time."""
    hit = F.col("l_discount") > 0.05
    items = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"), F.bool_and(hit).alias("every_one"))
    return items.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority").agg(
        F.count("*").alias("n_items"), F.sum("n").alias("n_rows"), F.round(F.avg(S.ratio(F.col("k"), F.col("n"))), 9).alias("mean_rate"), F.count_if("every_one").alias("n_every")
    )


@query(
    "unmatched_reference_rows",
    """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::bigint AS n_unmatched,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::bigint AS n_unused, (SELECT count(*) FROM lineitem)::bigint AS n_rows""",
)
def unmatched_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows find no match, which must be none before an inner join may be trusted."""
    rows, keys = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return scoring.match_report(rows, keys, "k")


@query(
    "option_rotation_groups",
    """SELECT l_returnflag, l_linenumber::bigint AS variant, count(*)::bigint AS n, round(avg((l_tax > 0.04)::int), 9) AS accuracy
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""",
)
def option_rotation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by rotation variant over a matched subset; variants are never pooled."""
    subset = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf_dir, "lineitem").join(subset, "l_orderkey", "left_semi").groupBy("l_returnflag", F.col("l_linenumber").cast("long").alias("variant")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("l_tax") > 0.04).cast("int")), 9).alias("accuracy")
    )


