"""Studies: contrasts, cells, checks of responses, resumption and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import inference
from gaugeworks.plans.inference_queries import _BLOCKS_SQL, _BOOT_SQL, _blocks
from gaugeworks.plans.registry import query
from gaugeworks.plans.views import EVENT_TYPES, PROBS_SQL, SCORED_SQL, both_halves, probs, scored
from gaugeworks.tables import load


@query(
    "item_bootstrap",
    _BOOT_SQL.format(
        clusters="SELECT g, c, t, b FROM (WITH " + SCORED_SQL + " SELECT source AS g, doc_id AS c, power(p - gold, 2) AS t, 1 AS b FROM scored WHERE answered)", seed="item"
    ) + " SELECT g AS source, n_clusters, estimate, low, high FROM sizes LEFT JOIN bounds USING (g)",
)
def item_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of stated probabilities by source, items resampled."""
    rows = scored(spark, sf_dir).where("answered").select("source", "doc_id", S.brier_binary(F.col("p"), F.col("gold")).alias("t"), F.lit(1).alias("b"))
    return inference.cluster_bootstrap(rows, "source", "doc_id", "t", "b", 200, "item")


@query(
    "block_ratio_bootstrap",
    _BOOT_SQL.format(
        clusters="SELECT event_type AS g, event_id // 100 AS c, sum(value) AS t, sum(user_id) AS b FROM events GROUP BY ALL", seed="ratio"
    ) + " SELECT g AS event_type, n_clusters, estimate, low, high FROM sizes LEFT JOIN bounds USING (g)",
)
def block_ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of means by type, blocks of the stream resampled."""
    blocks = load(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 100").alias("c")).agg(F.sum("value").alias("t"), F.sum("user_id").alias("b"))
    return inference.cluster_bootstrap(blocks, "event_type", "c", "t", "b", 200, "ratio")


@query(
    "contrast_summary",
    f"""{_BLOCKS_SQL}, s AS (SELECT event_type, any_value(mean_diff) AS d, count_if(abs(mean) >= abs(mean_diff) - 1e-12)::double / count(*) AS p FROM flips JOIN obs o USING (event_type) GROUP BY event_type),
r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS rn, count(*) OVER () AS m FROM s)
SELECT event_type, round(d, 9) AS shift, round(p, 9) AS p, round(max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING), 9) AS p_holm, abs(d) <= 3 AS within_margin FROM r""",
)
def contrast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift, exact p, family-wise p and margin of each contrast."""
    tests = inference.holm(inference.sign_flip(_blocks(spark, sf_dir), ["event_type"], "d"), "event_type", "p")
    return tests.select("event_type", F.round("mean_diff", 9).alias("shift"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), (F.abs("mean_diff") <= 3).alias("within_margin"))


@query(
    "distribution_check",
    f"""WITH {PROBS_SQL}, shown AS (SELECT user_id, half, k, CASE WHEN k = 'signup' AND user_id % 4 = 0 THEN NULL ELSE round(p, 2) END AS s FROM probs),
r AS (SELECT user_id, half, count_if(s IS NULL) AS n_missing, abs(sum(s) - 1) AS off FROM shown GROUP BY ALL)
SELECT CASE WHEN n_missing > 0 THEN 'missing_key' WHEN off > 5e-2 THEN 'sum_error' WHEN off > 1e-6 THEN 'sum_warning' ELSE 'ok' END AS code, count(*)::bigint AS n FROM r GROUP BY 1""",
)
def distribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by the first rule they break: a missing key, then a sum beyond either tolerance."""
    kept = F.filter("v", lambda x: ~((x["k"] == "signup") & (F.col("user_id") % 4 == 0)))
    rows = probs(spark, sf_dir).select(kept.alias("v"))
    missing = F.array_except(F.array(*[F.lit(k) for k in EVENT_TYPES]), F.transform("v", lambda x: x["k"]))
    off = F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.round(x["p"], 2)) - 1)
    code = F.when(F.size(missing) > 0, "missing_key").when(off > 5e-2, "sum_error").when(off > 1e-6, "sum_warning").otherwise("ok")
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(
    "score_check",
    f"""WITH {PROBS_SQL}, lv AS (SELECT user_id, half, p, row_number() OVER (PARTITION BY user_id, half ORDER BY k) - 1 AS level FROM probs),
e AS (SELECT user_id, half, sum(level * p) AS expectation, sum(level * floor(p * 100 + 0.5) / 100) AS shown FROM lv GROUP BY ALL),
d AS (SELECT user_id, half, sum(p * abs(level - expectation)) AS mad FROM lv JOIN e USING (user_id, half) GROUP BY ALL)
SELECT user_id, half, round(expectation, 9) AS expectation, abs(shown - expectation) <= 0.005 * 10 AS within_bound, round(1 - mad / 1.2, 9) + 0.0 AS confidence FROM e JOIN d USING (user_id, half)""",
)
def score_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected level against the one from displayed values, bounded by half a quantum per level; confidence from the spread against a uniform one."""
    add = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda s, x: s + x)
    rows = probs(spark, sf_dir).withColumn("e", add(lambda x, i: i * x["p"])).withColumn("s", add(lambda x, i: i * F.floor(x["p"] * 100 + 0.5) / 100))
    spread = add(lambda x, i: x["p"] * F.abs(i - F.col("e")))
    return rows.select("user_id", "half", F.round("e", 9).alias("expectation"), (F.abs(F.col("s") - F.col("e")) <= 0.05).alias("within_bound"), (F.round(1 - spread / 1.2, 9) + 0.0).alias("confidence"))


@query(
    "placement_cells",
    """SELECT l_linenumber AS placement, l_shipdate < TIMESTAMP '1995-01-01' AS early, count(*)::bigint AS n, round(avg((l_returnflag = 'R')::int), 9) AS hit_rate, round(avg(l_quantity), 6) AS mean_quantity
FROM lineitem GROUP BY GROUPING SETS ((l_linenumber, l_shipdate < TIMESTAMP '1995-01-01'), (l_linenumber))""",
)
def placement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates by placement and order, and pooled over order."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("placement"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"), "l_returnflag", "l_quantity")
    return rows.groupingSets([["placement", "early"], ["placement"]], "placement", "early").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 9).alias("hit_rate"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity")
    )


@query(
    "seed_sensitivity",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s1:' || doc_id::varchar)) <= 20 AS a, row_number() OVER (PARTITION BY lang ORDER BY md5('s2:' || doc_id::varchar)) <= 20 AS b FROM documents)
SELECT lang, count_if(a)::bigint AS n_first, count_if(b)::bigint AS n_second, count_if(a AND b)::bigint AS n_both FROM r GROUP BY lang""",
)
def seed_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much two seeds' samples overlap."""
    place = lambda seed: F.row_number().over(Window.partitionBy("lang").orderBy(S.hash_order(F.lit(seed), F.col("doc_id")))) <= 20
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    a, b = (docs.withColumn("in_it", place(s)).where("in_it").select("doc_id", "lang") for s in ("s1", "s2"))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["lang", "doc_id"], "full")
    return both.groupBy("lang").agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))


@query(
    "resume_pending",
    """WITH s AS (SELECT user_id, event_type, bool_or(value > 50) AS done, bool_or(value BETWEEN 20 AND 50) AS uncertain FROM events GROUP BY ALL), t AS (SELECT DISTINCT e.user_id, y.event_type FROM events e CROSS JOIN (SELECT DISTINCT event_type FROM events) y)
SELECT t.event_type, count(*)::bigint AS n_tasks, count_if(coalesce(done, false))::bigint AS n_done, count_if(NOT coalesce(done, false) AND coalesce(uncertain, false))::bigint AS n_uncertain, count_if(NOT coalesce(done, false) AND NOT coalesce(uncertain, false))::bigint AS n_pending
FROM t LEFT JOIN s USING (user_id, event_type) GROUP BY 1""",
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run skips, holds and still has to do. Tasks of a user are five, so they are an array, not a join."""
    e, value = F.col("event_type"), F.col("value")
    states = [F.struct(F.lit(k).alias("event_type"), F.bool_or((e == k) & (value > 50)).alias("done"), F.bool_or((e == k) & value.between(20, 50)).alias("uncertain")) for k in EVENT_TYPES]
    tasks = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array(*states).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    d, u = F.col("done"), F.col("uncertain")
    return tasks.groupBy("event_type").agg(F.count("*").alias("n_tasks"), F.count_if(d).alias("n_done"), F.count_if(~d & u).alias("n_uncertain"), F.count_if(~d & ~u).alias("n_pending"))


@query(
    "rename_reorder",
    f"""WITH {PROBS_SQL}, pairs AS (SELECT a.user_id, a.k, a.p AS pa, b.p AS pb FROM probs a JOIN probs b USING (user_id, k) WHERE a.half = 'a' AND b.half = 'b')
SELECT 'q_' || k AS renamed, count(*)::bigint AS n, round(max(abs(pa - pb)), 9) AS worst, round(avg(abs(pa - pb)), 9) AS mean FROM pairs GROUP BY k""",
)
def rename_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys renamed and reordered in one arm, and mapped back before arms are compared."""
    renamed = F.reverse(F.transform("b", lambda x: F.struct(F.concat(F.lit("q_"), x["k"]).alias("k"), x["p"].alias("p"))))
    rows = both_halves(spark, sf_dir).select("a", renamed.alias("b"))
    gaps = F.transform("a", lambda x: F.struct(F.concat(F.lit("q_"), x["k"]).alias("k"), F.abs(x["p"] - S.at(F.col("b"), F.concat(F.lit("q_"), x["k"]))).alias("gap")))
    return rows.select(F.explode(gaps).alias("g")).groupBy(F.col("g.k").alias("renamed")).agg(F.count("*").alias("n"), F.round(F.max("g.gap"), 9).alias("worst"), F.round(F.avg("g.gap"), 9).alias("mean"))


@query(
    "echo_recover",
    r"""WITH r AS (SELECT conv_id, turn, regexp_extract(text, '^([A-Za-z]+)[ ,.:]+([^ ,.]+)', 1) AS key, regexp_extract(text, '^([A-Za-z]+)[ ,.:]+([^ ,.]+)', 2) AS echo FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN echo = CASE key WHEN 'The' THEN 'the' WHEN 'To' THEN 'of' WHEN 'And' THEN 'the' WHEN 'Is' THEN 'and' END THEN key END AS key FROM r""",
)
def echo_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key counts if the text after it is that key's option."""
    options = F.create_map(*[F.lit(x) for kv in {"The": "the", "To": "of", "And": "the", "Is": "and"}.items() for x in kv])
    shape = "^([A-Za-z]+)[ ,.:]+([^ ,.]+)"
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract("text", shape, 1).alias("k"), F.regexp_extract("text", shape, 2).alias("echo"))
    return rows.select("conv_id", "turn", F.when(F.col("echo") == F.element_at(options, F.col("k")), F.col("k")).alias("key"))


@query(
    "ordered_dedup",
    "SELECT user_id, event_type, min(event_id) AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS place FROM events GROUP BY user_id, event_type",
)
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct settings of each user in order of first use."""
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")).cast("long"))


@query(
    "canonical_identity",
    """SELECT sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS spec_sha256, count(*)::bigint AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1""",
)
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the digest of their canonical JSON: keys in order, no white space."""
    spec = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return load(spark, sf_dir, "orders").groupBy(F.sha2(spec, 256).alias("spec_sha256")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    "ranked_fits",
    """WITH f AS (SELECT l_shipdate IS NOT NULL AS known, l_returnflag || l_linestatus AS model, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY ALL),
e AS (SELECT f.model, sqrt(avg(power(l_extendedprice - a - b * l_quantity, 2))) AS rmse, count_if(abs(l_extendedprice - a - b * l_quantity) < 1000)::bigint AS n_close FROM lineitem JOIN f ON f.model = l_returnflag || l_linestatus GROUP BY 1)
SELECT model, round(rmse, 3) AS rmse, n_close, row_number() OVER (ORDER BY round(rmse, 3), n_close DESC) AS place FROM e""",
)
def ranked_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits in order of error, then of close rows. Six models: the last window is over six rows."""
    rows = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    fits = rows.groupBy("model").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    off = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    errors = rows.join(fits, "model").groupBy("model").agg(F.round(F.sqrt(F.avg(F.pow(off, 2))), 3).alias("rmse"), F.count_if(F.abs(off) < 1000).alias("n_close"))
    return errors.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse", F.desc("n_close"))).cast("long"))


@query(
    "workload_disagreement",
    """WITH w AS (SELECT event_id // 500 AS block, event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT event_type, count(*)::bigint AS n_blocks, count_if(a IS NULL OR b IS NULL)::bigint AS n_unpaired, round(avg(abs(a - b)), 9) AS mean_gap, count_if((a > 60) <> (b > 60))::bigint AS n_disagree FROM w GROUP BY event_type""",
)
def workload_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes of a workload, block by block: gaps and disagreements."""
    even = F.col("user_id") % 2 == 0
    cells = load(spark, sf_dir, "events").groupBy(F.expr("event_id div 500").alias("block"), "event_type").agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return cells.groupBy("event_type").agg(
        F.count("*").alias("n_blocks"), F.count_if(a.isNull() | b.isNull()).alias("n_unpaired"), F.round(F.avg(F.abs(a - b)), 9).alias("mean_gap"), F.count_if((a > 60) != (b > 60)).alias("n_disagree")
    )


@query(
    "policy_labels",
    """SELECT o_orderpriority, count(*)::bigint AS n, count_if((CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'audit' WHEN o_orderstatus = 'F' THEN 'close' WHEN o_totalprice > 100000 THEN 'hold' ELSE 'open' END) =
  (CASE WHEN o_totalprice <= 100000 THEN CASE WHEN o_orderstatus = 'F' THEN 'close' ELSE 'open' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'audit' ELSE 'hold' END END))::bigint AS n_verified FROM orders GROUP BY 1""",
)
def policy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels derived by rules in order, verified by a table of both conditions."""
    done, dear = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    label = F.when(done & dear, "audit").when(done, "close").when(dear, "hold").otherwise("open")
    table = F.create_map(*[F.lit(x) for kv in {"truetrue": "audit", "truefalse": "close", "falsetrue": "hold", "falsefalse": "open"}.items() for x in kv])
    again = F.element_at(table, F.concat(done.cast("string"), dear.cast("string")))
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(label == again).alias("n_verified"))
