r"""Exact top-k search among binary codes by incremental multi-index hashing.

A code of 64 bits is cut into four segments of 16 bits. For each query, radius r = 0, 1, 2, ... a round looks up, in the index of each segment,
the values at exactly r bits from the query's own, and verifies the full Hamming distance of what it finds. After round r every code
within distance 4 * (r + 1) - 1 has been seen (a code further off in all segments differs in at least 4 * (r + 1) bits), so a query
is done once its kth verified distance is no more than that. Rounds end when no query is left; the last radius, 16, has seen every code.
A round's values are all masks of r bits, or, where fewer, the values that a segment has at all, by their distance.

A code is taken in the one round and segment in which it is nearest (the first of equal segments), so no pair of query and code is met
twice, and only if it isn't further than the query's kth verified distance so far.

Equal codes are one row of the index, with the k + 1 least ids (no answer can need more, as equal codes tie and ties go to
the least id), and equal query codes are searched once. So a code that a third of all rows share costs one row. Codes come from the signs of a vector's
first 64 components (missing ones count as not positive).

Vectors that are null, or have null or non-finite components, take no part. Fewer than k other rows: all of them are returned.
Rows with a null id take no part; of rows that share an id each is a candidate.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch

BITS, SEGMENTS, SEGMENT = 64, 4, 16


def sign_code(v: Column) -> Column:
    """The signs of the first 64 components as a bigint, component i in bit i."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda code, i: F.when(F.get(v, i) > 0, code.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(code),
    )


def usable(v: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad), F.lit(False))


def segment(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, k * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def at_distance(values: Column, own: Column, r: int) -> Column:
    return F.filter(values, lambda v: distance(v, own) == r)


def nearest_in(q: Column, code: Column, s: Column, r: int) -> Column:
    """Whether the codes are r bits apart in segment s, more in the segments before it, and no less in those after it."""
    apart = F.array(*[distance(segment(q, k), segment(code, k)) for k in range(SEGMENTS)])
    return (F.array_min(apart) == r) & (F.array_position(apart, F.lit(r)) == s + 1)


def search(spark: SparkSession, codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """codes(id, code) and queries(query_id, code, with query_id among the ids) to (query_id, rank, id, distance, radius); ties to the least id.

    radius is the last that was searched for the query."""
    scratch = Scratch(spark, "hamming")
    # The least k + 1 ids of each code are ranked within salted groups and then among those, so a hot code is never gathered.
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("code").orderBy("id")
    ranked = codes.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    ranked = ranked.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    index = scratch.save(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "index")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col("code"), s).alias("v")) for s in range(SEGMENTS)]))
    entries = scratch.save(index.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"), each.alias("e")).select("e.s", "e.v", "code", "n", "least"), "entries")
    # One row a segment, of at most 65,536 values.
    values = scratch.save(entries.groupBy("s").agg(F.collect_set("v").alias("values")), "values")
    most = values.agg(F.max(F.size("values"))).first()[0] or 0
    left = scratch.save(queries.select("code").distinct().select(F.col("code").alias("q"), F.lit(BITS).alias("bound"), F.lit(0).alias("held")), "asked")
    # The masks of each number of bits, 65,536 in all.
    every = spark.range(1 << SEGMENT).select(F.bit_count("id").cast("int").alias("r"), F.col("id").cast("int").alias("m"))
    masks = scratch.save(every.groupBy("r").agg(F.collect_list("m").alias("masks")).coalesce(1), "masks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = None
    done = []
    for r in range(SEGMENT + 1):
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col("q"), s).alias("own")) for s in range(SEGMENTS)]))
        # Few queries make many probes, so they are dealt to all tasks.
        probes = left.repartition(parts, "q").select("q", "bound", own.alias("e")).select("q", "bound", "e.s", "e.own", F.lit(r).alias("r"))
        if comb(SEGMENT, r) <= most:
            probes = probes.join(F.broadcast(masks), "r").select("q", "bound", "s", F.explode("masks").alias("m"), "own")
            probes = probes.select("q", "bound", "s", F.col("own").bitwiseXOR(F.col("m")).alias("v"))
        else:
            probes = probes.join(F.broadcast(values), "s").select("q", "bound", "s", F.explode(at_distance(F.col("values"), F.col("own"), r)).alias("v"))
        met = probes.join(entries.hint("merge"), ["s", "v"]).withColumn("distance", distance(F.col("q"), F.col("code")))
        new = met.where((F.col("distance") <= F.col("bound")) & nearest_in(F.col("q"), F.col("code"), F.col("s"), r)).select("q", "distance", "code", "n", "least")
        best = scratch.save(kept_best(new if best is None else best.unionByName(new), k), f"best{r}")
        reach = best.groupBy("q").agg(F.sum("n").alias("held"), F.max("distance").alias("reach"))
        # All queries, also those for which nothing has been found yet.
        known = left.select("q").join(reach, "q", "left").select("q", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("reach", F.lit(BITS)).alias("reach"))
        settled = (F.col("held") > k) & (F.col("reach") <= SEGMENTS * (r + 1) - 1) | F.lit(r == SEGMENT)
        known = scratch.save(known.withColumn("settled", settled), f"known{r}")
        done.append(best.join(known.where("settled").select("q"), "q", "left_semi").withColumn("radius", F.lit(r)))
        left = known.where("NOT settled").select("q", F.when(F.col("held") > k, F.col("reach")).otherwise(BITS).alias("bound"))
        best = best.join(left.select("q"), "q", "left_semi")
        if not left.limit(1).count():
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = scratch.save(found, "found")
    scratch.keep("found", "index")
    return answers(found, index, queries, k)


def kept_best(hits: DataFrame, k: int) -> DataFrame:
    """(q, distance, code, n, least) of the nearest codes that together hold the k + 1 least answers: at most k + 1 codes.

    Of codes at one distance those with the least first ids do, as each holds an id; so Spark cuts a query's hits to k + 1 in every task before it shuffles them.
    """
    nearest = F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))
    few = hits.withColumn("r", nearest).where(F.col("r") <= k + 1).drop("r")
    before = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    return few.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") <= k).drop("before")


def answers(found: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Codes to ids, without the query's own."""
    rows = found.join(index, "code").select("q", "distance", "radius", F.explode("ids").alias("id"))
    # A query code's k + 1 nearest ids serve every query that has it: leaving out its own leaves k.
    order = Window.partitionBy("q").orderBy("distance", "id")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "distance", "radius", "id")
    each = queries.select("query_id", F.col("code").alias("q")).join(rows, "q").where("id <> query_id")
    own = Window.partitionBy("query_id").orderBy("distance", "id")
    return each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "radius")


def report(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """The k nearest codes to every vec_id divisible by ``every``: query_id, rank, vec_id, distance."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding")).alias("code"))
    rows = Scratch(spark, "codes").save(rows, "codes")
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    return search(spark, rows, queries, k).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


ORACLE = """
WITH codes AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS c FROM embeddings
), dist AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.c, x.c), lambda p: (p[1] <> p[2])::int))::int AS distance
  FROM codes q JOIN codes x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist
) WHERE rank <= 10"""
