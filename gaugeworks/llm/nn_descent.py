r"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph over distinct vectors: each has its ``DEGREE`` nearest neighbours found so far. It begins with random neighbours and with neighbours in the
order along a few random projections; each round gathers a node's neighbours and a bounded number of nodes that name it, joins their vectors, compares
all of them with one another, and offers each the best of the others; lists keep the nearest offers. Rounds end when few
lists change, or after ``ROUNDS``. Lists of a node number at most ``2 * DEGREE``, so a node that a third of all name (a hub) costs no more than any other:
of the nodes that name a hub, those with the least hash for the round are compared, others in later rounds.

For the search, each node keeps ``LONG`` random neighbours besides, so that no tight cluster is closed to the rest. A query starts from its own node, if its
vector is in the graph, and from the nearest of a sample of nodes by hash, the seeds: ``SEEDS``, or eight times the root of the number of nodes if that is more, at most
``MOST_SEEDS``, as every task gets them. It walks greedily:
it keeps its nearest nodes, ``BEAM`` and more as the table doubles, expands those not yet expanded, and stops when none is left. Every step is a join of the walking queries with the graph, so
graph, vectors and queries stay distributed, and every row holds one node at most.

Equal vectors are one node, which lists its k + 1 least ids: no answer can need more, as equal vectors tie and ties go to the least id. Nodes are named by a 64-bit hash; of
vectors that collide in it all but one get another name from a second hash. The graph is built and walked over
differences from a centre, the medians of the seeds' components, in single precision; in lists of neighbours they are in half precision, each scaled by its own largest component, so that
vectors far larger than the rest cost these nothing. Answers are ranked by exact distances in double precision over the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without an id or of another length than most. Rows that
share an id are candidates each. With at most ``SEEDS`` nodes the seeds are all nodes. Fewer candidates than k: all are returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch
from gaugeworks.llm.hamming_search import usable

DEGREE = 32
ROUNDS = 8
OFFERS = 10
SEEDS = 512
MOST_SEEDS = 100_000
BEAM = 160
EXPANDED = 20
LONG = 4
#: Up to so many nodes a walk keeps BEAM; each doubling beyond adds half as many.
BEAM_NODES = 8192
PROJECTIONS = 3
#: Components further than this from the centre count as this far for the graph, so that no square overflows.
FARTHEST = 1e15
#: Lists of neighbours that are compared at once.
AT_ONCE = 500


def raw(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, which has no nulls, one after another."""
    if not len(column):
        return np.empty(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, little-endian singles, as a matrix."""
    return raw(column).view("<f4").reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def unhalved(column: pa.Array) -> np.ndarray:
    """What halved() made, as a matrix of singles."""
    if not len(column):
        return np.zeros((0, 1), np.float32)
    rows = raw(column).reshape(len(column), -1)
    return np.ascontiguousarray(rows[:, 4:]).view("<f2").astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view("<f4")


def binary(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, one value a row."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def encoded(batches: Iterator[pa.RecordBatch], name: str, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(name, embedding) to (name, v)."""
    for batch in batches:
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        v = np.clip(flat - centre[None, :], -FARTHEST, FARTHEST).astype("<f4") if batch.num_rows else np.zeros((0, 1), "<f4")
        yield pa.RecordBatch.from_arrays([batch.column(name), binary(v)], [name, "v"])


def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, v) with v in half precision, after its scale in single precision."""
    for batch in batches:
        v = matrix(batch.column("v"))
        top = np.maximum(np.abs(v).max(axis=1, keepdims=True), np.float32(1e-30)).astype("<f4")
        small = np.hstack([top.view(np.uint8).reshape(len(v), -1), (v / top).astype("<f2").view(np.uint8).reshape(len(v), -1)])
        yield pa.RecordBatch.from_arrays([batch.column("node"), binary(small)], ["node", "v"])


def least_ids(rows: DataFrame, k: int) -> DataFrame:
    """(node, ids) with each node's k + 1 least ids, ranked in salted groups first."""
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("node").orderBy("id")
    ranked = rows.select("node", "id").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    ranked = ranked.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    return ranked.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def projected(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = matrix(batch.column("v"))
        axis = np.random.default_rng(seed).standard_normal(v.shape[1]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array((v @ axis).astype(np.float64))], ["node", "at"])


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted along a projection to pairs of close rows."""
    for batch in batches:
        nodes = batch["node"].to_numpy()
        for step in range(1, DEGREE // PROJECTIONS + 1):
            if len(nodes) > step:
                yield pd.DataFrame({"node": nodes[:-step], "other": nodes[step:]})


def compared(batches: Iterator[pa.RecordBatch], offers: int) -> Iterator[pa.RecordBatch]:
    """Rows (near: array of struct(node, v, fresh)) to offers (node, other, d): for each member its nearest fellow members.

    Pairs of two members that aren't fresh have been compared already.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            near = whole.column(0).slice(at, AT_ONCE)
            members = near.flatten()
            bounds = near.offsets.to_numpy() - near.offsets[0].as_py()
            nodes, fresh = members.field("node").to_numpy(), members.field("fresh").to_numpy(zero_copy_only=False)
            vectors = unhalved(members.field("v"))
            out = []
            for lo, hi in itertools.pairwise(bounds.tolist()):
                if hi - lo < 2:
                    continue
                v, own, new = vectors[lo:hi], nodes[lo:hi], fresh[lo:hi]
                square = (v * v).sum(axis=1)
                d = np.maximum(square[:, None] + square[None, :] - 2 * (v @ v.T), 0)
                d[~(new[:, None] | new[None, :])] = np.inf
                np.fill_diagonal(d, np.inf)
                n = min(offers, hi - lo - 1)
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                rows = np.repeat(np.arange(hi - lo), n)
                cols = best.ravel()
                good = np.isfinite(d[rows, cols])
                out.append((own[rows[good]], own[cols[good]], d[rows, cols][good]))
            if out:
                x, y, d = (np.concatenate(z) for z in zip(*out, strict=True))
                # Of these offers to a node only the nearest go on.
                order = np.lexsort((y, d, x))
                x, y, d = x[order], y[order], d[order]
                new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                x, y, d = x[new], y[new], d[new]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                near_enough = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) < DEGREE // 2
                x, y, d = x[near_enough], y[near_enough], d[near_enough]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(d, pa.float64())], ["node", "other", "d"])


def measured(batches: Iterator[pa.RecordBatch], names: tuple[str, str], decode: Callable[[pa.Array], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(names, v, w) to (names, d)."""
    for batch in batches:
        d = ((decode(batch.column("v")) - decode(batch.column("w"))) ** 2).sum(axis=1, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(d)], [*names, "d"])


class Graph:
    """The neighbour graph of the distinct vectors among vectors(vec_id, embedding)."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, k: int) -> None:
        self.spark, self.k = spark, k
        self.scratch = scratch = Scratch(spark, "nn-descent")
        v = F.col("embedding")
        rows = vectors.where(usable(v) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())
        rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("embedding"))
        size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.width = size[0]["n"] if size else 0
        # Adding 0 makes both zeros the same, as their distance is 0.
        rows = self.plain(rows.where(F.size("embedding") == self.width))
        clash = rows.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").select("a", "low")
        self.clash = scratch.save(clash, "clash")
        self.rows = scratch.save(self.named(rows), "rows")
        vectors = scratch.save(self.rows.groupBy("node").agg(F.any_value("embedding").alias("embedding")), "vectors")
        self.ids = scratch.save(least_ids(self.rows, k), "ids")
        self.n = vectors.count()
        seeds = vectors.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(min(MOST_SEEDS, max(SEEDS, math.isqrt(64 * self.n)))).toPandas()
        self.centre = np.median(np.stack(seeds["embedding"].to_list()), axis=0) if len(seeds) else np.zeros(1)
        self.nodes = scratch.save(self.encoded(vectors, "node"), "nodes")
        scratch.drop("vectors")
        self.seeds = seeds["node"].to_numpy(), np.clip(np.stack(seeds["embedding"].to_list()) - self.centre, -FARTHEST, FARTHEST).astype(np.float32) if len(seeds) else np.zeros((0, 1), np.float32)
        self.beam = round(BEAM * (1 + max(0.0, math.log2(max(1, self.n) / BEAM_NODES)) / 2))
        # Lists of neighbours carry vectors in half precision; only the graph depends on it.
        self.halves = scratch.save(self.nodes.mapInArrow(halved, "node bigint, v binary"), "halves")
        self.edges = self.descend()

    @staticmethod
    def plain(rows: DataFrame) -> DataFrame:
        """rows(..., embedding) with two hashes a and b of it. Adding 0 makes both zeros the same, as their distance is 0."""
        rows = rows.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)))
        return rows.withColumns({"a": F.xxhash64("embedding"), "b": F.xxhash64("embedding", F.lit(7))})

    def named(self, rows: DataFrame) -> DataFrame:
        """rows(..., a, b) with their node."""
        name = F.when(F.col("low").isNull() | (F.col("b") == F.col("low")), F.col("a")).otherwise(F.xxhash64("a", "b"))
        return rows.join(self.clash, "a", "left").withColumn("node", name).drop("a", "b", "low")

    def encoded(self, rows: DataFrame, name: str) -> DataFrame:
        centre = self.centre
        return rows.select(name, "embedding").mapInArrow(lambda b: encoded(b, name, centre), f"{name} bigint, v binary")

    def kept(self, offers: DataFrame) -> DataFrame:
        """The DEGREE nearest of each node's offers(node, other, d, age); age counts the rounds since an edge was found."""
        # Dealt by node once, for both the aggregate and the window; a node gets a bounded number of offers from each batch.
        each = offers.repartition(F.col("node")).groupBy("node", "other").agg(F.min("d").alias("d"), F.max("age").alias("age"))
        nearest = Window.partitionBy("node").orderBy("d", "other")
        return each.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= DEGREE).select("node", "other", "d", "age")

    def with_vectors(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.halves, "node").join(self.halves.withColumnsRenamed({"node": "other", "v": "w"}), "other").select("node", "other", "v", "w")

    def strangers(self) -> DataFrame:
        """(node, other): LONG random neighbours of each node, both ways: nodes by hash, each with the next in rings of about 1,000."""
        pairs = None
        for turn in range(LONG // 2):
            ring = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(max(1, self.n // 1000))).alias("ring")
            order = Window.partitionBy("ring").orderBy(F.xxhash64("node", F.lit(turn), F.lit(1)), "node")
            found = self.nodes.select("node", ring).select("node", F.lead("node").over(order).alias("other")).where("other IS NOT NULL")
            pairs = found if pairs is None else pairs.unionByName(found)
        return pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))

    def start(self) -> DataFrame:
        """Random neighbours and neighbours along a few random projections, both ways."""
        pairs = None
        for seed in range(PROJECTIONS):
            line = self.nodes.mapInArrow(lambda b, s=seed: projected(b, s), "node bigint, at double")
            found = line.repartitionByRange(F.col("at")).sortWithinPartitions("at", "node").select("node").mapInPandas(runs, "node bigint, other bigint")
            pairs = found if pairs is None else pairs.unionByName(found)
        both = pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).union(self.random).where("node <> other").distinct()
        offers = self.with_vectors(both).mapInArrow(lambda b: measured(b, ("node", "other"), unhalved), "node bigint, other bigint, d double")
        return self.scratch.save(self.kept(offers.withColumn("age", F.lit(0))), "graph0")

    def descend(self) -> DataFrame:
        self.random = self.scratch.save(self.strangers(), "random")
        graph = self.start()
        for turn in range(1, ROUNDS + 1):
            # Forward neighbours all; of those that name a node, a bounded number, fresh ones first. Spark cuts a hub's list to that
            # number in each task before it is shuffled. An edge stays fresh for two rounds, so that those left out get another turn.
            edges = graph.select("node", "other", (F.col("age") < 2).alias("fresh"))
            by_hash = [F.desc("fresh"), F.xxhash64("other", F.lit(turn))]
            back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
            back = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*by_hash))).where(F.col("r") <= DEGREE).drop("r")
            near = edges.unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
            near = near.join(self.halves.withColumnsRenamed({"node": "other"}), "other")
            lists = near.groupBy("node").agg(F.collect_list(F.struct(F.col("other").alias("node"), "v", "fresh")).alias("near"))
            offers = lists.select("near").mapInArrow(lambda b: compared(b, OFFERS), "node bigint, other bigint, d double")
            known = graph.withColumn("age", F.col("age") + 1)
            graph = self.scratch.save(self.kept(known.unionByName(offers.withColumn("age", F.lit(0)))), f"graph{turn}")
            self.scratch.drop(f"graph{turn - 1}")
            if graph.where("age = 0").count() < 0.02 * self.n * DEGREE:
                break
        # Searched both ways: a node's own neighbours and a bounded number of nodes that name it.
        back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "d")
        nearest = Window.partitionBy("node").orderBy("d", "other")
        both = graph.select("node", "other", "d").unionByName(back).distinct().withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= 2 * DEGREE)
        both = both.select("node", "other").unionByName(self.random).distinct()
        return self.scratch.save(both.groupBy("node").agg(F.collect_list("other").alias("others")), "edges")

    def search(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, embedding) to (query_id, rank, vec_id, score): the k nearest found."""
        asked = self.scratch.save(self.named(self.plain(queries)).withColumnRenamed("node", "q"), "asked")
        points = self.scratch.save(self.encoded(asked.groupBy("q").agg(F.any_value("embedding").alias("embedding")), "q"), "points")
        keep = max(self.beam, self.k + 1)
        # As many steps for a wide beam as for one of BEAM.
        step = EXPANDED * keep // BEAM
        nearest = Window.partitionBy("q").orderBy("d", "node")
        beam = self.scratch.save(self.entries(points, keep), "beam0")
        turn = 0
        while beam.where("NOT seen").limit(1).count():
            turn += 1
            front = beam.where("NOT seen").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= step).select("q", "node", "d")
            front = self.scratch.save(front, f"front{turn}")
            reached = front.join(self.edges, "node").select("q", F.explode("others").alias("node")).distinct()
            fresh = reached.join(beam.select("q", "node"), ["q", "node"], "left_anti").join(self.nodes, "node").join(points.withColumnRenamed("v", "w"), "q")
            found = fresh.mapInArrow(lambda b: measured(b, ("q", "node"), matrix), "q bigint, node bigint, d double").withColumn("seen", F.lit(False))
            # What was expanded is in front too, as seen. Dealt by query once, for both the aggregate and the window.
            known = beam.unionByName(front.withColumn("seen", F.lit(True))).unionByName(found).repartition(F.col("q"))
            known = known.groupBy("q", "node").agg(F.min("d").alias("d"), F.max("seen").alias("seen"))
            beam = self.scratch.save(known.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= keep).drop("r"), f"beam{turn}")
            self.scratch.drop(f"beam{turn - 1}", f"front{turn}")
        return self.answers(beam, asked)

    def entries(self, points: DataFrame, keep: int) -> DataFrame:
        """(q, node, d, seen): each query's own node and its nearest seeds."""
        names, v = self.seeds

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, inside, x in zip(batch.column("q").to_pylist(), batch.column("inside").to_pylist(), matrix(batch.column("v")), strict=True):
                    d = ((v - x) ** 2).sum(axis=1, dtype=np.float64)
                    best = np.lexsort((names, d))[:keep]
                    node, far = names[best], d[best]
                    if inside and q not in node:
                        node, far = np.r_[q, node], np.r_[0.0, far]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), q)), pa.array(node), pa.array(far), pa.array(np.zeros(len(node), bool))], ["q", "node", "d", "seen"])

        own = self.nodes.select(F.col("node").alias("q"), F.lit(True).alias("inside"))
        return points.join(own, "q", "left").withColumn("inside", F.coalesce("inside", F.lit(False))).mapInArrow(near, "q bigint, node bigint, d double, seen boolean")

    def answers(self, beam: DataFrame, asked: DataFrame) -> DataFrame:
        found = beam.select("q", "node")
        pairs = asked.select("query_id", "embedding", "q").join(found, "q").join(self.ids, "node").select("query_id", "embedding", "node", F.explode("ids").alias("id"))
        # Ids alone may repeat; of rows equal in id and vector one answers.
        own = self.rows.select("id", "node", F.col("embedding").alias("other")).dropDuplicates(["id", "node"])
        pairs = pairs.where("id <> query_id").distinct().join(own, ["id", "node"])
        score = exact(F.col("embedding"), F.col("other"))
        order = Window.partitionBy("query_id").orderBy("score", "id")
        ranked = pairs.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def exact(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed in order of components."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def report(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest found for every vec_id divisible by ``every``: query_id, rank, vec_id, score."""
    graph = Graph(spark, vectors.select("vec_id", "embedding"), k)
    queries = graph.rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding")
    return graph.search(queries)
