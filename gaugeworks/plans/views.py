"""Ledger-shaped views over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.tables import load

#: Every requested item with its result, if it has one: documents of up to 4,000 characters are answered.
SCORED_SQL = """scored AS (
  SELECT l.doc_id, d.lang, d.source, l.quality AS gold, l.toxic, d.doc_id IS NOT NULL AS answered,
         least(0.99, greatest(0.01, floor(d.n_chars / 40.0) / 100.0))::double AS p,
         coalesce((d.n_chars >= 500)::int = l.quality, false) AS correct
  FROM labels l LEFT JOIN (SELECT * FROM documents WHERE n_chars <= 4000) d USING (doc_id)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, gold, toxic, answered, p (stated probability), correct; unanswered counts as wrong."""
    results = load(spark, sf_dir, "documents").where("n_chars <= 4000").select("doc_id", "lang", "source", "n_chars", F.lit(True).alias("hit"))
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.floor(F.col("n_chars") / 40.0) / 100.0))
    return load(spark, sf_dir, "labels").join(results, "doc_id", "left").select(
        "doc_id", "lang", "source", F.col("quality").alias("gold"), "toxic", F.coalesce("hit", F.lit(False)).alias("answered"),
        F.when(F.col("hit"), p).alias("p"),
        F.coalesce((F.col("n_chars") >= 500).cast("int") == F.col("quality"), F.lit(False)).alias("correct"),
    )


#: Each user's distribution over event types in the first and the second half of the stream (by event id), with every type present.
PROBS_SQL = """types AS (SELECT DISTINCT event_type AS k FROM events),
halves AS (SELECT user_id, CASE WHEN event_id < (SELECT max(event_id) + 1 FROM events) / 2.0 THEN 'a' ELSE 'b' END AS half, event_type FROM events),
cells AS (SELECT user_id, half, event_type AS k, count(*) AS n FROM halves GROUP BY ALL),
totals AS (SELECT user_id, half, sum(n) AS m FROM cells GROUP BY ALL),
probs AS (
  SELECT t.user_id, t.half, y.k, coalesce(c.n, 0) AS n, t.m, coalesce(c.n, 0)::double / t.m AS p
  FROM totals t CROSS JOIN types y LEFT JOIN cells c ON c.user_id = t.user_id AND c.half = t.half AND c.k = y.k
)"""

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, half, event_type of every event."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    last = events.agg(F.max("event_id").alias("last"))
    # One row: the bound of the first half.
    return events.join(F.broadcast(last), F.lit(True)).select(
        "user_id", F.when(F.col("event_id") < (F.col("last") + 1) / 2.0, "a").otherwise("b").alias("half"), "event_type"
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, half, m (events), v: array<struct<k,p>> over all event types in name order. One partial aggregate, no pivot join."""
    counts = [F.count_if(F.col("event_type") == k).alias(k) for k in EVENT_TYPES]
    wide = halves(spark, sf_dir).groupBy("user_id", "half").agg(F.count("*").alias("m"), *counts)
    v = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(k) / F.col("m")).alias("p")) for k in EVENT_TYPES])
    return wide.select("user_id", "half", "m", v.alias("v"))


def both_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, a, b: the two halves' vectors of users that have both."""
    rows = probs(spark, sf_dir)
    cells = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("half") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("half") == "b", F.col("v"))).alias("b")
    )
    return cells.where("a IS NOT NULL AND b IS NOT NULL")
