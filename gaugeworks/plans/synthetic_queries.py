"""Generated questions with independent solvers, mock answers, a simulated endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.plans.registry import query
from gaugeworks.sources import synthetic
from gaugeworks.tables import load


def _draw(name: str, below: int, seed: str = "world") -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', o_orderkey)), 1, 8))::bigint % {below})"


_GOLD_SQL = f"""golds AS (SELECT o_orderkey AS item, o_orderkey % 6 AS f, {_draw("days", 91)} AS days, {_draw("amount", 601)} AS amount, {_draw("tier", 2)} = 1 AS gold, {_draw("damaged", 5)} = 0 AS damaged,
  {_draw("gap", 61)} AS gap, {_draw("red", 9)} AS red, {_draw("blue", 9)} AS blue, {_draw("right", 100, "mock")} < 70 AS fit, {_draw("silent", 50, "mock")} > 0 AS said FROM orders),
answers AS (SELECT *, ['lookup', 'routing', 'chain', 'window', 'unstated', 'base_rate'][f + 1] AS family, CASE f WHEN 1 THEN CASE WHEN damaged THEN 'escalate'
    WHEN days <= CASE WHEN gold THEN 60 ELSE 30 END AND amount <= CASE WHEN gold THEN 500 ELSE 200 END THEN 'approve' ELSE 'deny' END
  WHEN 3 THEN CASE WHEN gap <= 30 THEN 'yes' ELSE 'no' END WHEN 4 THEN 'not_stated' WHEN 5 THEN CASE WHEN red > blue THEN 'yes' ELSE 'no' END ELSE 'a name' END AS gold_value FROM golds)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.items(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "world")


@query("generated_items", f"WITH {_GOLD_SQL} SELECT family, gold_value AS gold, count(*)::bigint AS n, count(*)::bigint AS n_agree FROM answers GROUP BY ALL")
def generated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by family and label, and how many of them a solver that reads the text answers alike."""
    rows = synthetic.solved(_items(spark, sf_dir))
    label = F.when(F.col("family").isin("lookup", "chain"), "a name").otherwise(F.col("gold")).alias("gold")
    return rows.groupBy("family", label).agg(F.count("*").alias("n"), F.count_if(F.col("answer") == F.col("gold")).alias("n_agree")).select("family", "gold", "n", "n_agree")


@query("mock_accuracy", f"WITH {_GOLD_SQL} SELECT family, count(*)::bigint AS n, count_if(said)::bigint AS n_said, count_if(said AND fit)::bigint AS n_right FROM answers GROUP BY family")
def mock_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded mock answers by family; silent ones count as wrong."""
    rows = synthetic.mocked(_items(spark, sf_dir), "mock", 70)
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count("prediction").alias("n_said"), F.count_if(F.col("prediction") == F.col("gold")).alias("n_right"))


@query(
    "simulated_endpoint",
    f"""WITH c AS (SELECT {_draw("tokens", 2000, "calls")} + 100 AS tokens, {_draw("fail", 100, "calls")} < 3 AS bad, {_draw("jitter", 32, "calls")} AS jitter FROM orders)
SELECT CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, count(*)::bigint AS n, sum(tokens)::bigint AS tokens, round(avg(70.0::double + 0.0625::double * tokens + jitter / 4.0::double), 6) AS mean_ms FROM c GROUP BY 1""",
)
def simulated_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a simulated endpoint by status."""
    rows = synthetic.calls(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "calls")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
