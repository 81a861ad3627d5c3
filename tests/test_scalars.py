"""Hand-computed values of the closed-form functions and of the statistical operators."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import recovery
from gaugeworks.functions import scalars as S
from gaugeworks.operators import inference, ledger, regression, scoring, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(**p):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("p")) for k, v in p.items()])


def test_wilson(spark):
    low, high = (one(spark, S.wilson(F.lit(70), F.lit(100), u)) for u in (False, True))
    assert low == pytest.approx(0.60415, abs=1e-4) and high == pytest.approx(0.78105, abs=1e-4)
    assert one(spark, S.wilson(F.lit(0), F.lit(0), True)) is None


@pytest.mark.parametrize(("p", "y", "expected"), [(0.8, True, 0.04), (0.3, False, 0.09), (1.0, False, 1.0)])
def test_brier_binary(spark, p, y, expected):
    assert one(spark, S.brier_binary(F.lit(p), F.lit(y))) == pytest.approx(expected)


def test_brier_vector_and_log_loss(spark):
    assert one(spark, S.brier_vector(vec(a=0.7, b=0.2, c=0.1), F.lit("b"))) == pytest.approx(1.14)
    assert one(spark, S.log_loss(F.lit(0.0))) == math.inf
    assert one(spark, S.log_loss_clipped(F.lit(0.0))) == pytest.approx(-math.log(1e-12))


def test_distances(spark):
    assert one(spark, S.total_variation(vec(a=1), vec(b=1))) == pytest.approx(1.0)
    assert one(spark, S.total_variation(vec(a=0.6, b=0.4), vec(a=0.4, b=0.6))) == pytest.approx(0.2)
    assert one(spark, S.max_deviation(vec(a=0.6, b=0.4), vec(a=0.4, b=0.6))) == pytest.approx(0.2)


def test_rank_probability(spark):
    assert one(spark, S.rank_probability(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), F.lit(1))) == pytest.approx(0.065)


@pytest.mark.parametrize(("a", "b", "p"), [(45, 81, 0.001709), (0, 0, 1.0), (3, 3, 1.0), (5, 0, 0.0625)])
def test_mcnemar(spark, a, b, p):
    assert one(spark, S.mcnemar(F.lit(a), F.lit(b))) == pytest.approx(p, abs=1e-6)


def test_mcnemar_is_finite_for_many(spark):
    assert 0 <= one(spark, S.mcnemar(F.lit(3000), F.lit(3200))) < 0.02


def test_chance_and_ties(spark):
    assert one(spark, S.chance_adjusted(F.lit(0.8), F.lit(0.25))) == pytest.approx(0.7333333)
    assert one(spark, S.argmax(vec(a=0.4, b=0.4, c=0.2))) == "a"
    assert one(spark, S.ties_at_max(vec(a=0.4, b=0.4, c=0.2))) == 2


def test_reliability_and_ece(spark):
    rows = spark.createDataFrame([(0.1, False), (0.15, True), (0.75, True), (0.85, False), (0.95, True)], "p double, correct boolean")
    bins = {r["bin"]: r for r in scoring.reliability(rows, "p", "correct", 10).collect()}
    assert sorted(bins) == [1, 7, 8, 9]
    assert (bins[1]["n"], bins[1]["mean_p"], bins[1]["rate"]) == (2, pytest.approx(0.125), 0.5)
    assert scoring.ece(scoring.reliability(rows, "p", "correct", 10)).first()["ece"] == pytest.approx((2 * 0.375 + 0.25 + 0.85 + 0.05) / 5)


def test_risk_coverage(spark):
    rows = spark.createDataFrame([(1, 0.9, True), (2, 0.8, True), (3, 0.7, False), (4, 0.1, False)], "id int, p double, correct boolean").withColumn("g", F.lit(1))
    steps = [r["accuracy"] for r in scoring.risk_coverage(rows, "g", "p", "correct", "id").orderBy("covered").collect()]
    assert steps[0] == 1.0 and steps[-1] == 0.5
    ties = spark.createDataFrame([(1, 0.5, True), (2, 0.5, False), (3, 0.5, True)], "id int, p double, correct boolean").withColumn("g", F.lit(1))
    steps = [r["accuracy"] for r in scoring.risk_coverage(ties, "g", "p", "correct", "id").orderBy("covered").collect()]
    assert steps == [1.0, 0.5, pytest.approx(0.666667, abs=1e-6)]


def test_stratified(spark):
    rows = [("easy", i < 9) for i in range(10)] + [("hard", i < 2) for i in range(10)]
    sizes = spark.createDataFrame([("easy", 900), ("hard", 100)], "s string, size long")
    assert scoring.stratified(spark.createDataFrame(rows, "s string, c boolean"), sizes, "s", "c").first()["estimate"] == pytest.approx(0.83)


def test_holm(spark):
    six = spark.createDataFrame([(str(i), 0.03) for i in range(6)], "name string, p double")
    assert [r["p_holm"] for r in inference.holm(six, "name", "p").collect()] == [pytest.approx(0.18)] * 6
    open_family = spark.createDataFrame([("a", 0.01), ("b", None)], "name string, p double")
    assert {r["name"]: r["p_holm"] for r in inference.holm(open_family, "name", "p").collect()} == {"a": pytest.approx(0.02), "b": 1.0}


def test_sign_flip(spark):
    blocks = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 2.0), ("g", 2, 3.0)], "g string, block int, d double")
    r = inference.sign_flip(blocks, ["g"], "d").first()
    assert (r["n_blocks"], r["p"]) == (3, 0.25)


def test_bootstrap_of_a_perfect_shift(spark):
    clusters = spark.createDataFrame([("g", i, 1.0, 1) for i in range(4)], "g string, c int, t double, b int")
    r = inference.cluster_bootstrap(clusters, "g", "c", "t", "b", 50, "s").first()
    assert (r["estimate"], r["low"], r["high"]) == (1.0, 1.0, 1.0)
    alone = inference.cluster_bootstrap(clusters.where("c = 0"), "g", "c", "t", "b", 50, "s").first()
    assert alone["low"] is None


def test_two_features(spark):
    rows = spark.createDataFrame([(float(a), float(b), 3.0 + 2 * a + 5 * b) for a in range(4) for b in range(3)], "a double, b double, y double").withColumn("g", F.lit(1))
    r = regression.two_features(rows, ["g"], "a", "b", "y").first()
    assert [r["constant"], r["beta_a"], r["beta_b"]] == [pytest.approx(v) for v in (3, 2, 5)]
    assert regression.two_features(rows.withColumn("b", F.col("a")), ["g"], "a", "b", "y").first()["beta_a"] is None


def test_apportion(spark):
    shares = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 1)], "g string, n string, w long")
    assert {r["n"]: r["seats"] for r in ledger.apportion(shares, "g", "n", "w", 100).collect()} == {"a": 34, "b": 33, "c": 33}


@pytest.mark.parametrize(
    ("reply", "keys", "expected"),
    [
        ("A", "ABCD", ("A", "exact")),
        ("(o1)", ["o0", "o1", "o2", "o3"], ("o1", "stripped")),
        ("Some words about A and B.\n\nD", "ABCD", ("D", "final_line_key")),
        ("The answer is A. Wait, the answer is B.", "ABCD", ("B", "answer_pattern")),
        ("the answer is b, not C", "ABCD", ("B", "answer_pattern")),
        ("The answer is A or B.", "ABCD", (None, "unrecovered")),
        ("Option C is wrong.", "ABCD", (None, "unrecovered")),
        ("Clearly B fits here well", "ABCD", ("B", "isolated_key")),
        ("A fits and B fits", "ABCD", (None, "unrecovered")),
        ("", "ABCD", (None, "unrecovered")),
        (None, "ABCD", (None, "unrecovered")),
        ("a cat sat", "ABCD", (None, "unrecovered")),
    ],
)
def test_recovery(reply, keys, expected):
    assert recovery.recover(reply, list(keys)) == expected


def test_recovery_from_reasoning():
    assert recovery.recover("", list("ABCD"), "so the answer is C") == ("C", "reasoning_channel")


def test_redaction(spark):
    given = "Authorization: Bearer abc.def, api_key = 'xyz123' and apikey_0123456789ab, hunter22 ok"
    assert one(spark, text.redacted(F.lit(given), ("hunter22",))) == (
        "Authorization: Bearer [REDACTED], api_key = '[REDACTED]' and [REDACTED], [REDACTED] ok"
    )
    assert one(spark, text.secret_key(F.lit("X-Api-Key"))) and not one(spark, text.secret_key(F.lit("input_tokens")))
