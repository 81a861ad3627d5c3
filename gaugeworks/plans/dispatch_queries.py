"""Requests under a pace, in slots, and up to a halt; steps as an event stream; tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import dispatch
from gaugeworks.plans.registry import query
from gaugeworks.sources import files
from gaugeworks.streaming import ledgers
from gaugeworks.tables import load


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value")
    return rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")


@query(
    "paced_requests",
    """WITH r AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS came, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(max(came - i * 1500.0) OVER (PARTITION BY event_type ORDER BY i) + i * 1500.0 - came, 3) AS wait FROM r""",
)
def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each event would have waited if those of its type went 25 minutes apart."""
    rows = dispatch.paced(_requests(spark, sf_dir), "event_type", "at", "event_id", 1500.0)
    return rows.select("event_id", F.round(F.col("start") - F.col("at"), 3).alias("wait"))


@query(
    "halted_requests",
    """WITH r AS (SELECT user_id, event_id, coalesce(sum((event_type = 'error')::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM events)
SELECT user_id, count_if(e = 0)::bigint AS n_sent, count_if(e > 0)::bigint AS n_cancelled FROM r GROUP BY user_id""",
)
def halted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events up to the first error, and those that it cancels."""
    rows = dispatch.halted(_requests(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.count_if("sent").alias("n_sent"), F.count_if(~F.col("sent")).alias("n_cancelled"))


@query("bounded_dispatch")
def bounded_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type in four slots, each for an hour a unit of value: how many wait and how long in all. A simulation that SQL can't state."""
    rows = _requests(spark, sf_dir).withColumn("seconds", F.col("value") * 3600)
    found = dispatch.slotted(rows, "event_type", "at", "seconds", "event_id", 4).join(rows.select("event_id", "at"), "event_id")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("start") > F.col("at")).alias("n_waiting"), F.round(F.sum(F.col("start") - F.col("at")), 1).alias("wait"))


@query("stream_steps", """SELECT 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"user_id":' || user_id || '}' AS message FROM events""")
def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a message of an event stream, as a stream writes them."""
    return ledgers.messages(spark, f"{sf_dir}/events.parquet")


@query("markdown_table", "SELECT '| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |' AS line FROM region UNION ALL SELECT unnest(['| r_regionkey | r_name |', '|---|---|'])")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as lines of a Markdown table."""
    return files.markdown(load(spark, sf_dir, "region").select("r_regionkey", "r_name")).select("line")
