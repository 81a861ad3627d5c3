"""Near duplicates, searches, graphs and the pipeline, against brute force in Python."""

import itertools
import random

import numpy as np
import pandas
import pytest

from gaugeworks.llm import graph, hamming_search, minhash_dedup, nn_descent
from gaugeworks.llm.common import Scratch

random.seed(2)


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\r", " ").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def shingle_set(t, size):
    w = [x for x in words(t) if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(rows, size, percent):
    """doc_id to (set size, least reachable id) for rows of distinct ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(base, edits):
    w = base.split(" ")
    for _ in range(edits):
        w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
    return " ".join(w)


def corpus():
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    base, other, passage = text(80), text(60), text(50)
    rows = [edited(base, random.randint(0, 9)) for _ in range(120)]  # one large group, some of it out of reach
    rows += [edited(other, random.randint(0, 4)) for _ in range(40)]
    rows += [f"{passage} {text(30)}" for _ in range(40)]  # a passage that many share
    chain = text(60).split(" ")
    rows += [" ".join(chain[k : k + 50]) for k in range(0, 10, 2)]  # each like the next only
    rows += [text(random.randint(1, 60)) for _ in range(40)] + [base] * 20
    rows += ["one", "One", "one two", "ONE\ttwo", "", None, " \n", "z" * 20_000]
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_components(docs, spark, size):
    rows = corpus()
    expected = components(rows, size, 80)
    found = minhash_dedup.report(spark, docs(rows), size, 80).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_one_of_each_group_is_kept(docs, spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v"), (None, "q r s t u v"), (None, "other words of null here"), (4, ""), (5, None)]
    kept = minhash_dedup.kept(spark, docs(rows), 5, 80)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d e f g"), (3, "q r s t u v"), (None, "other words of null here"), (4, ""), (5, None)], key=str
    )
    assert minhash_dedup.report(spark, docs([]).where("false"), 5, 80).count() == 0


def test_differences_from_a_hub_find_every_link():
    # The bound behind the inverted index, on random sets: an outlier that links with y shares one of y's chosen elements.
    for _ in range(4000):
        hub = set(range(40))
        change = lambda k: (hub - set(random.sample(range(40), k))) | {random.randrange(1000, 1006) for _ in range(k)}
        x, y = change(random.randint(0, 12)), change(random.randint(0, 12))
        linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        if linked(x, hub) or not linked(x, y):
            continue
        dx, dy = x ^ hub, y ^ hub
        least = (len(dy) * 180 + (len(hub) - len(y)) * 20) // 360 + 1
        assert len(dx & dy) >= least
        assert dx & set(sorted(dy)[: len(dy) - least + 1])


def test_graph_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    found = graph.components(Scratch(spark, "t"), spark.createDataFrame(links, "a bigint, b bigint"), "g").collect()
    assert {r["c"]: r["root"] for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(Scratch(spark, "t"), spark.createDataFrame([], "a bigint, b bigint"), "g").count() == 0


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 64))
    v = centres[rng.integers(0, 6, n)] + 0.6 * rng.standard_normal((n, 64))
    if copies:
        v[rng.choice(n, copies, replace=False)] = v[0]
    return v


ODD_VECTORS = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (9005, [None] * 64), (None, [1.0] * 64), (9100, [])]


def test_hamming_search(spark):
    v = vectors(400, 3, copies=130)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + ODD_VECTORS
    found = hamming_search.report(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    # A zero vector is usable here: its code has no bit set.
    ids, bits = np.array([*range(400), 9002]), np.vstack([v > 0, np.zeros((1, 64), bool)])
    expected = set()
    for q in range(0, 400, 50):
        d = (bits != bits[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        expected |= {(q, r + 1, int(ids[j]), int(d[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in found} == expected


def test_hamming_search_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in hamming_search.report(spark, rows).collect()] == [(0, 1, 1, 64)]
    assert hamming_search.report(spark, rows.where("false")).count() == 0


def nearest(rows, q, k):
    x = dict(rows)[q]
    d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))), i) for i, y in rows if i != q)
    return d[:k]


def test_few_vectors_are_searched_exactly(spark):
    v = vectors(200, 4, copies=70)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = nn_descent.report(spark, spark.createDataFrame(rows + ODD_VECTORS, "vec_id bigint, embedding array<double>")).collect()
    for q in (0, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        expected = nearest(rows, q, 10)
        assert [r[1] for r in own] == [i for _, i in expected]
        assert [r[2] for r in own] == pytest.approx([d for d, _ in expected], abs=1e-12)
    assert {r["query_id"] for r in found} == {0, 100}


def test_descent_recalls_most(spark):
    v = vectors(1500, 5, copies=400)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = nn_descent.report(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(found) == 150
    hits = sum(len({i for _, i in nearest(rows, q, 10)} & {r["vec_id"] for r in found if r["query_id"] == q}) for q in range(0, 1500, 100))
    assert hits >= 0.95 * 150


def test_no_vectors(spark):
    assert nn_descent.report(spark, spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_descent_finds_neighbours_in_more_clusters_than_seeds(spark):
    rng = np.random.default_rng(8)
    clusters, each = 600, 36
    v = np.repeat(100 * rng.standard_normal((clusters, 16)), each, axis=0) + rng.standard_normal((clusters * each, 16))
    table = spark.createDataFrame(pandas.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    found = nn_descent.report(spark, table, every=240).collect()
    hits = 0
    queries = range(0, len(v), 240)
    for q in queries:
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.97 * 10 * len(queries)


def test_descent_with_a_vector_far_larger_than_the_rest(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1500, 64))
    v[700] *= 1e9
    table = spark.createDataFrame(pandas.DataFrame({"vec_id": np.arange(1500), "embedding": v.tolist()}))
    found = nn_descent.report(spark, table).collect()
    rows = list(enumerate(v))
    hits = sum(len({i for _, i in nearest(rows, q, 10)} & {r["vec_id"] for r in found if r["query_id"] == q}) for q in range(0, 1500, 100))
    assert hits >= 0.95 * 150


def test_vectors_with_one_hash_stay_apart(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "query_id bigint, embedding array<double>")
    graph = object.__new__(nn_descent.Graph)
    same = graph.plain(rows).withColumn("a", nn_descent.F.lit(5).cast("long"))
    clash = same.groupBy("a").agg(nn_descent.F.min("b").alias("low"), nn_descent.F.max("b").alias("high"))
    graph.clash = clash.where("low <> high").select("a", "low")
    assert graph.named(same).select("node").distinct().count() == 3


def test_every_query_is_settled_through_the_index(spark):
    v = vectors(900, 10)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>").select("id", hamming_search.sign_code(nn_descent.F.col("embedding")).alias("code"))
    queries = rows.where("id % 90 = 0").withColumnRenamed("id", "query_id")
    found = hamming_search.search(spark, rows, queries, 10).groupBy("query_id").agg({"distance": "max", "radius": "max"}).collect()
    assert len(found) == 10
    for r in found:
        # No query goes further than the radius that proves its tenth distance, and all end before everything has been seen.
        assert r["max(distance)"] <= 4 * (r["max(radius)"] + 1) - 1
        assert r["max(radius)"] <= -(-(r["max(distance)"] + 2) // 4) < 16
