"""Samples, permutations, graphs and streams."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import graphs, ledger
from gaugeworks.plans.registry import query
from gaugeworks.streaming import ledgers
from gaugeworks.tables import load


def _ranked(docs: DataFrame, seed: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(S.hash_order(F.lit(seed), F.col("doc_id")))
    return docs.select("doc_id", "lang", F.row_number().over(w).cast("long").alias("place"))


@query(
    "stratified_sample",
    """WITH s AS (SELECT lang, count(*) AS w FROM documents GROUP BY 1), q AS (SELECT lang, w, 100.0::double * w / sum(w) OVER () AS q FROM s), f AS (SELECT *, 100 - sum(floor(q)) OVER () AS left_over FROM q),
a AS (SELECT lang, greatest(1, floor(q) + (row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, lang) <= left_over)::int) AS n FROM f),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('strat:' || doc_id::varchar)) AS place FROM documents)
SELECT doc_id, lang, place FROM r JOIN a USING (lang) WHERE place <= n""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents in proportion to languages, at least one of each."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("w")).withColumn("whole", F.lit(1))
    seats = ledger.apportion(sizes, "whole", "lang", "w", 100).select("lang", F.greatest(F.lit(1), "seats").alias("n"))
    return _ranked(docs, "strat").join(seats, "lang").where("place <= n").select("doc_id", "lang", "place")


@query("equal_sample", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('equal:' || doc_id::varchar)) AS place FROM documents QUALIFY place <= 20")
def equal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each language."""
    return _ranked(load(spark, sf_dir, "documents"), "equal").where("place <= 20")


@query("srs", "SELECT doc_id FROM documents ORDER BY md5('srs:' || doc_id::varchar) LIMIT 50")
def srs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents at random; a top-k by hash, kept per task."""
    return load(spark, sf_dir, "documents").select("doc_id").orderBy(S.hash_order(F.lit("srs"), F.col("doc_id"))).limit(50)


@query("within_block_shuffle", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('blk:' || o_orderkey::varchar)) AS place FROM orders")
def within_block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of rows within a block by a seeded hash."""
    w = Window.partitionBy("o_custkey").orderBy(S.hash_order(F.lit("blk"), F.col("o_orderkey")))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("factor_sweep", "WITH f AS (SELECT unnest(range(0, 4)) AS a), g AS (SELECT unnest(range(0, 4)) AS b) SELECT a, b, count(*)::bigint AS n FROM f, g, region WHERE a = 0 OR b = 0 OR a = b GROUP BY ALL")
def factor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor at a time plus the diagonal, for each region; the factors are arrays of four."""
    four = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    rows = load(spark, sf_dir, "region").select(F.explode(four).alias("a")).select("a", F.explode(four).alias("b"))
    return rows.where("a = 0 OR b = 0 OR a = b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "bfs_distances",
    """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, (s_suppkey % 25)::int AS b FROM supplier WHERE s_nationkey <> s_suppkey % 25), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 0 AS node, 0 AS d UNION SELECT u.b, r.d + 1 FROM r JOIN u ON r.node = u.a WHERE r.d < (SELECT count(*) FROM nation))
SELECT node, min(d) AS distance FROM r GROUP BY node""",
)
def bfs_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from nation 0 over links that suppliers make."""
    links = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b")).where("a <> b").distinct()
    return graphs.distances(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 0)


_PARTS = ", ".join(f"sum(('0x' || substr(n.s, {1 + 8 * k}, 8))::bigint)" for k in range(4))
_ROUNDS = ", ".join(f"l{k + 1} AS (SELECT e.a, md5(concat_ws('|', any_value(o.s), {_PARTS})) AS s FROM e JOIN l{k} o ON e.a = o.a JOIN l{k} n ON e.b = n.a GROUP BY e.a)" for k in range(3))


@query(
    "structural_signature",
    f"""WITH u AS (SELECT DISTINCT s_nationkey AS a, (s_suppkey % 25)::int AS b FROM supplier WHERE s_nationkey <> s_suppkey % 25), e AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
l0 AS (SELECT a, md5(count(*)::varchar) AS s FROM e GROUP BY a), {_ROUNDS} SELECT a AS node, s AS signature FROM l3""",
)
def structural_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of nations by their place in the supplier graph, the same under any renaming."""
    links = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b")).where("a <> b")
    return graphs.refined(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 3)


@query("greedy_pair_match")
def greedy_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand paired by equal size but other type, each used once: in order of id, each with the first that waits and has another type.

    Those that wait are of one type, as any other would have been paired with them; so a look at the first of them does."""
    import pandas as pd

    def match(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("p_partkey")
        waiting, pairs = deque(), []
        for key, kind in zip(parts["p_partkey"], parts["p_type"], strict=True):
            if waiting and waiting[0][1] != kind:
                pairs.append((waiting.popleft()[0], key))
            else:
                waiting.append((key, kind))
        return pd.DataFrame([(parts["p_brand"].iloc[0], a, b) for a, b in pairs], columns=["p_brand", "a", "b"])

    parts = load(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    return parts.groupBy("p_brand", "p_size").applyInPandas(match, "p_brand string, a bigint, b bigint")


@query("stream_dedup", "SELECT user_id, event_type, count(DISTINCT event_id)::bigint AS n FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read twice as a stream; repeats of an event id are refused."""
    return ledgers.deduplicated(spark, f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_window",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::bigint AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
)
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts kept up by a stream."""
    return ledgers.hourly(spark, f"{sf_dir}/events.parquet").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "stream_budget",
    "SELECT user_id, count(*)::bigint AS n, round(sum(value), 4) AS reserved, sum(value) > 3000 AS exhausted FROM events GROUP BY user_id",
)
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's reservations kept as the state of a stream."""
    return ledgers.budgets(spark, f"{sf_dir}/events.parquet", 3000.0).select("user_id", "n", F.round("reserved", 4).alias("reserved"), "exhausted")


@query(
    "stream_budget_ledger",
    """SELECT user_id AS owner, count_if(event_type <> 'click')::bigint AS n_requests, 0::bigint AS n_denied, count_if(event_type = 'error')::bigint AS n_unknown, count_if(event_type = 'signup')::bigint AS n_open,
  round(coalesce(sum(CASE event_type WHEN 'view' THEN value * 0.8 WHEN 'purchase' THEN value END), 0), 4) AS billed, round(coalesce(sum(value) FILTER (WHERE event_type IN ('error', 'signup')), 0), 4) AS reserved FROM events GROUP BY user_id""",
)
def stream_budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations, releases and reconciliations of each user as the state of a stream; what is unknown stays held."""
    rows = ledgers.event_budgets(spark, f"{sf_dir}/events.parquet")
    return rows.withColumns({"billed": F.round("billed", 4), "reserved": F.round("reserved", 4)})
