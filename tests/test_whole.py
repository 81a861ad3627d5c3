"""Queries over whole tables, against brute force on small ones."""

import hashlib
import math
import random
import unicodedata

import pytest

from gaugeworks.plans.catalog import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of small tables from rows and schemas by name."""

    def make(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def draws(seed, g, c, r):
    """How often replicate r draws cluster c: the number of cumulative Poisson(1) chances that a uniform number reaches."""
    u = int(hashlib.md5(f"{seed}:{g}:{c}:{r // 4}".encode()).hexdigest()[8 * (r % 4) :][:8], 16) / 2**32
    n, below = 0, math.exp(-1)
    while u >= below and n < 9:
        n += 1
        below += math.exp(-1) / math.factorial(n)
    return n


def interval(values, g):
    """values: by cluster."""
    weights = [{c: draws("diff", g, c, r) for c in values} for r in range(200)]
    means = sorted(sum(w[c] * values[c] for c in values) / sum(w.values()) for w in weights if any(w.values()))
    return means[int(0.025 * len(means))], means[min(len(means) - 1, int(0.975 * len(means)))]


def test_paired_bootstrap_takes_all_customers(spark, tables):
    rng = random.Random(7)
    orders = [(k, rng.randrange(1, 31), rng.choice([100000.0, 200000.0])) for k in range(1, 300)]
    sf = tables(
        customer=([(c, c % 2) for c in range(1, 31)], "c_custkey bigint, c_nationkey int"),
        nation=([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        orders=([(k, c, p) for k, c, p in orders], "o_orderkey bigint, o_custkey bigint, o_totalprice double"),
    )
    expected = {}
    for g in (0, 1):
        values = {}
        for c in range(1, 31):
            arms = [[p > 150000 for k, x, p in orders if x == c and k % 2 == odd] for odd in (1, 0)]
            if c % 2 == g and all(arms):
                values[c] = sum(arms[0]) / len(arms[0]) - sum(arms[1]) / len(arms[1])
        expected[g] = (len(values), sum(values.values()) / len(values), *interval(values, g))
    found = {r["region"]: (r["n_clusters"], r["estimate"], r["low"], r["high"]) for r in QUERIES["paired_bootstrap"](spark, sf).collect()}
    assert found.keys() == expected.keys()
    for g in expected:
        assert found[g] == pytest.approx(expected[g], abs=2e-9)
    same = {r["region"]: r["equivalent"] for r in QUERIES["equivalence_check"](spark, sf).collect()}
    assert same == {g: x[2] > -0.03 and x[3] < 0.03 for g, x in expected.items()}
    both = QUERIES["interval_intersection"](spark, sf).first()
    assert (both["low"], both["high"]) == pytest.approx((max(x[2] for x in expected.values()), min(x[3] for x in expected.values())), abs=2e-9)


def test_questions_of_all_sources(spark, tables):
    sf = tables(documents=([(1, "a", "src1"), (2, "b", "src2")], "doc_id bigint, text string, source string"), labels=([(2, 1)], "doc_id bigint, quality int"))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    found = {tuple(r) for r in QUERIES["field_strip_split"](spark, sf).collect()}
    assert found == {(md5("1"), md5("a"), None), (md5("2"), md5("b"), None), (md5("2"), None, 1)}


def test_sign_flip_of_many_blocks(spark):
    inference = pytest.importorskip("gaugeworks.operators.inference")
    rows = [("a", k, 1.0) for k in range(14)] + [("b", k, 1.0) for k in range(21)]
    found = {r["g"]: (r["n_blocks"], r["mean_diff"], r["p"]) for r in inference.sign_flip(spark.createDataFrame(rows, "g string, block long, d double"), ["g"], "d").collect()}
    assert found == {"a": (14, 1.0, 2 / 2**14), "b": (21, 1.0, None)}


def test_leaks_are_whole_items(spark, tables):
    long = " ".join(f"word{i}" for i in range(20))
    docs = [(1, f"x{long}y"), (2, long[:80]), (3, "so few wordsy"), (4, "none")]
    sf = tables(documents=(docs, "doc_id bigint, text string"), benchmark=([(1, long), (2, "few words"), (3, "not there")], "item_id bigint, text string"))
    found = {tuple(r) for r in QUERIES["leakage_predicate"](spark, sf).collect()}
    assert found == {(1, 1, 1), (2, 1, 3), (3, 0, None)}


def test_a_bootstrap_of_few_clusters(spark):
    from gaugeworks.operators import inference

    rows = [("same", k, 1, 1) for k in range(4)] + [("one", 0, 1, 2)]
    found = {r["g"]: tuple(r)[1:] for r in inference.cluster_bootstrap(spark.createDataFrame(rows, "g string, c int, t int, b int"), "g", "c", "t", "b", 200, "x").collect()}
    assert found == {"same": (4, 1.0, 1.0, 1.0), "one": (1, 0.5, None, None)}


def test_distances_end_where_the_graph_does(spark):
    from gaugeworks.operators import graphs

    line = [(i, i + 1) for i in range(40)]
    links = spark.createDataFrame(line + [(b, a) for a, b in line] + [(90, 91)], "a int, b int")
    assert {tuple(r) for r in graphs.distances(links, 0).collect()} == {(i, i) for i in range(41)}


def test_signatures_don_t_depend_on_names(spark):
    from gaugeworks.operators import graphs

    rng = random.Random(3)
    links = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(20)) if a != b}
    links |= {(b, a) for a, b in links}
    labels = {a: hashlib.md5(str(sum(x == a for x, _ in links)).encode()).hexdigest() for a, _ in links}
    for _ in range(3):
        near = {a: [labels[y] for x, y in links if x == a] for a in labels}
        labels = {a: hashlib.md5("|".join([labels[a], *(str(sum(int(t[8 * k : 8 * k + 8], 16) for t in near[a])) for k in range(4))]).encode()).hexdigest() for a in labels}
    found = {r["node"]: r["signature"] for r in graphs.refined(spark.createDataFrame(sorted(links), "a int, b int"), 3).collect()}
    assert found == labels
    renamed = spark.createDataFrame([(a * 7 % 12 + 50, b * 7 % 12 + 50) for a, b in sorted(links)], "a int, b int")
    assert sorted(r["signature"] for r in graphs.refined(renamed, 3).collect()) == sorted(labels.values())


def test_parts_are_paired_greedily(spark, tables):
    rng = random.Random(4)
    parts = [(k, f"b{rng.randrange(2)}", rng.randrange(2), rng.choice("xyz")) for k in range(120)]
    expected = set()
    for brand, size in {(b, z) for _, b, z, _ in parts}:
        waiting = []
        for k, kind in sorted((k, t) for k, b, z, t in parts if (b, z) == (brand, size)):
            at = next((i for i, (_, other) in enumerate(waiting) if other != kind), None)
            if at is None:
                waiting.append((k, kind))
            else:
                expected.add((brand, waiting.pop(at)[0], k))
    sf = tables(part=(parts, "p_partkey bigint, p_brand string, p_size int, p_type string"))
    assert {tuple(r) for r in QUERIES["greedy_pair_match"](spark, sf).collect()} == expected


def test_texts_that_composing_changes(spark, tables):
    texts = ["plain", "e\u0301", "\u00e9", None, "\u1100\u1161", "A\u030a b"]
    sf = tables(documents=([(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    expected = {(x, 3, sum(t is not None and unicodedata.normalize("NFC", t) != t for k, t in enumerate(texts) if ("en" if k % 2 else "fr") == x)) for x in ("en", "fr")}
    assert {tuple(r) for r in QUERIES["nfc_variants"](spark, sf).collect()} == expected


def test_words_that_may_be_offered(spark, tables):
    rng = random.Random(5)
    words = ["the", "of", "aaa", "abab", "ababab", "xabcabcabc", "b\u0007d", "Good", "good", "ok", *("".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400))]
    sf = tables(documents=([(0, " ".join(words[:200])), (1, "\n".join(words[200:]))], "doc_id bigint, text string"))
    freq = {}
    for w in words:
        freq[w.lower()] = freq.get(w.lower(), 0) + 1
    again = lambda w: any(w[-n:] == w[-2 * n : -n] == w[-3 * n : -2 * n] for n in range(1, len(w) // 3 + 1))
    fit = {w: n for w, n in freq.items() if w not in ("the", "of", "and") and not again(w) and all(unicodedata.category(c) != "Cc" for c in w)}
    expected = sorted(fit.items(), key=lambda x: (-x[1], x[0]))[:254]
    assert [tuple(r) for r in QUERIES["candidate_filter"](spark, sf).collect()] == expected


def test_budgets_go_on_from_batch_to_batch(spark, tmp_path):
    from gaugeworks.streaming import ledgers

    rng = random.Random(6)
    ops, seq = [], 0
    for _ in range(300):
        owner, ticket = rng.randrange(3), rng.randrange(60)
        op = rng.choices(["reserve", "reconcile", "release"], [5, 4, 1])[0]
        amount = float(rng.randrange(1, 40)) if op == "reserve" or op == "reconcile" and rng.random() < 0.8 else None
        ops.append((owner, seq, op, ticket, amount))
        seq += 1
    expected = {}
    for owner in range(3):
        n = denied = unknown = 0
        billed = reserved = 0.0
        held = {}
        for _, _, op, ticket, amount in (o for o in ops if o[0] == owner):
            if op == "reserve":
                if ticket in held or billed + reserved + amount > 300 or n + 1 > 25:
                    denied += 1
                else:
                    held[ticket], n, reserved = amount, n + 1, reserved + amount
            elif ticket in held:
                was = held.pop(ticket)
                if op == "release":
                    n, reserved = n - 1, reserved - was
                elif amount is None:
                    unknown += 1
                else:
                    billed, reserved = billed + amount, reserved - was
        expected[owner] = (n, denied, unknown, len(held), billed, reserved)
    schema = "owner bigint, seq bigint, op string, ticket bigint, amount double"
    for k in (0, 150):
        spark.createDataFrame(ops[k : k + 150], schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/ops")
        # The second run finds what the first has left.
        found = ledgers.budget_ledger(spark.readStream.schema(schema).parquet(f"{tmp_path}/ops"), 300.0, 25, f"{tmp_path}/run")
    assert {r["owner"]: tuple(r)[1:] for r in found.collect()} == expected
    assert sum(x[1] for x in expected.values()) > 10 and sum(x[2] for x in expected.values()) > 0


def test_running_values_go_on_over_parts(spark):
    from pyspark.sql import functions as F

    from gaugeworks.operators.ordered import running

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, *range(9)])) for k in range(3000)]
    table = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    found = {r["k"]: (r["total"], r["most"]) for r in running(table, "g", [F.col("k")], {"total": (F.sum, F.col("v")), "most": (F.max, F.col("v"))}, before_own=True).collect()}
    seen, expected = {}, {}
    for g, k, v in rows:
        before = [x for x in seen.setdefault(g, []) if x is not None]
        expected[k] = (sum(before) if before else None, max(before, default=None))
        seen[g].append(v)
    assert found == expected


def test_steps_are_swept(spark):
    from gaugeworks.sources import folders

    steps = folders.Steps(spark, "swept")
    assert steps.save(spark.range(3), "x").count() == 3
    folders.sweep(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(steps.root)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_keys_are_refused_for_good(spark, tmp_path):
    from gaugeworks.streaming import ledgers

    schema = "k int, at int"
    for at, keys in enumerate(([1, 2, 2], [2, 3], [], [1, 4])):
        spark.createDataFrame([(k, at) for k in keys], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows, counts = ledgers.appended(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"], f"{tmp_path}/run")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0), (2, 0), (3, 1), (4, 3)]
    assert counts.agg({"n_appended": "sum", "n_refused": "sum"}).first()[:] in ((4, 3), (3, 4))


def test_requests_in_slots_and_at_a_pace(spark):
    from gaugeworks.operators import dispatch

    rng = random.Random(11)
    rows = [(k, rng.choice("ab"), float(rng.randrange(200)), float(rng.randrange(1, 30))) for k in range(90)]
    table = spark.createDataFrame(rows, "k int, g string, at double, seconds double")
    slots, pace = {}, {}
    for g in "ab":
        busy, last = [], float("-inf")
        for k, _, at, seconds in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            start = at
            while sum(end > start for end in busy) >= 3:
                start = min(end for end in busy if end > start)
            # A request that went earlier keeps its place: none overtakes.
            slots[k] = start
            busy.append(start + seconds)
            last = pace[k] = max(at, last + 4.0)
    assert {r["k"]: r["start"] for r in dispatch.slotted(table, "g", "at", "seconds", "k", 3).collect()} == slots
    assert {r["k"]: r["start"] for r in dispatch.paced(table, "g", "at", "k", 4.0).collect()} == pytest.approx(pace)


def test_markdown(spark):
    from gaugeworks.sources import files

    rows = spark.createDataFrame([(1, "a|b"), (2, None), (3, "x\n y")], "n int, s string").coalesce(1)
    assert [r["line"] for r in files.markdown(rows).orderBy("place").collect()] == ["| n | s |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |", "| 3 | x y |"]
