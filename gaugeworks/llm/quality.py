"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics of a text (lengths, shares of kinds of characters, repetition, entropy) are made roughly normal by
logarithms. Each class has its mean and a covariance shrunk towards the pooled one and its diagonal; a score is the
posterior chance of quality 1 from the difference of the two log densities, whose Mahalanobis terms come from
Cholesky factors that are computed once and cached in the model.

Fitting takes every labelled row that ``trains`` admits: sums and products of statistics are added up by Spark, so
only d * (d + 1) numbers a class reach the driver, however large the corpus. Statistics come from the text alone.

Defined cases: null and empty texts have the statistics of no characters and are scored like any other; rows with a null label or
id train nothing; where labels hold fewer than two rows of a class, every score is the share of label 1 (0.5 without labels).
Repeated rows are scored alike. Extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, text_or_empty

THRESHOLD = 0.7
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, [44, 46, 59, 58])
_OTHER = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT | _STOP)
_WIDE = _BYTES >= 192
_INNER = (_BYTES >= 128) & (_BYTES < 192)
N_STATS = 14
#: Characters of usual text that every share is smoothed with.
SMOOTH = 60


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = float(hist.sum() - hist[_INNER].sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    nw, nl = len(words), len(lines)
    distinct = len(set(words))
    upper, lower, other = float(hist[_UPPER].sum()), float(hist[_LOWER].sum()), float(hist[_OTHER].sum())
    wide = float(hist[_WIDE].sum())
    p = hist[hist > 0] / max(1, len(raw))
    # A share counts as if SMOOTH more units of the usual share were there, so that short texts don't look extreme.
    share = lambda x, y, usual, unit=SMOOTH: float(np.log((x + unit * usual) / (y + unit) + 1e-3))
    sizes = np.fromiter(map(len, words), np.float64, nw)
    mean = (sizes.sum() + 20 * 5.0) / (nw + 20)
    spread = (((sizes - mean) ** 2).sum() + 20 * 9.0) / (nw + 20)
    return [
        float(np.log(n + 1000)),
        float(np.log(mean)),
        float(np.log(spread)),
        share(upper, upper + lower + wide, 0.03),
        share(hist[_DIGIT].sum(), n, 0.002),
        share(hist[_STOP].sum(), n, 0.025),
        share(other, n, 0.001),
        share(hist[_SPACE].sum(), n, 0.16),
        share(wide, n, 0.03),
        float(np.log((-(p * np.log(p)).sum() * n + SMOOTH * 2.9) / (n + SMOOTH))),
        share(distinct, nw, 0.6, 30) + 0.1 * float(np.log(nw + 30)),
        share(len(set(lines)), nl, 0.95, 3),
        float(np.log((nw + 3 * 60) / (nl + 3))),
        share(sum(1 for w in words if len(w) == 1 and not w.isalnum()), nw, 0.001, 20),
    ]


def _stats(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def stats(text: Column) -> Column:
    """Column of a text's statistics."""
    return F.pandas_udf(_stats, "array<double>")(text_or_empty(text))


@dataclass
class Quadratic:
    """A fitted discriminant; factors are lower Cholesky factors of the shrunk covariances."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    sharpness: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None or not len(x):
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = []
        for mean, low in zip(self.means, self.factors, strict=True):
            solved = np.linalg.solve(low, (z - mean).T)
            density.append(-0.5 * (solved**2).sum(axis=0) - np.log(np.diag(low)).sum())
        logit = self.sharpness * (density[1] - density[0]) + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))

    def score(self, given: Column) -> Column:
        """Scores of a column of statistics."""
        model = self

        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.array(x.tolist(), dtype=float).reshape(len(x), -1)))

        return F.pandas_udf(score, "double")(given)


def trains(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, isn't 2."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(known: DataFrame, shrink: float = 0.2, ridge: float = 0.05, sharpness: float = 0.25) -> Quadratic:
    """known(label, x) to a model. shrink: weight of the pooled covariance; ridge: of its diagonal; sharpness tempers the posterior.

    These three have the least log loss of a grid in cross-validation over the three folds that train (crc32 modulo 4 of 0, 1 and 3); held-out rows had no part in it.
    """
    d = N_STATS
    one = F.concat(F.array(F.lit(1.0)), F.col("x"))
    pairs = F.posexplode(F.flatten(F.transform(one, lambda a: F.transform(one, lambda b: a * b))))
    sums = known.select("label", pairs.alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    tables = {k: np.zeros((d + 1) ** 2) for k in (0, 1)}
    for r in sums.collect():  # 2 * (d + 1)^2 rows
        if r["label"] in tables:
            tables[r["label"]][r["at"]] = r["v"]
    moments = {k: v.reshape(d + 1, d + 1) for k, v in tables.items()}
    n = {k: m[0, 0] for k, m in moments.items()}
    if min(n.values()) < 2:
        return Quadratic(prior=float(n[1] / sum(n.values())) if sum(n.values()) else 0.5)
    whole = moments[0] + moments[1]
    centre = whole[0, 1:] / whole[0, 0]
    scale = np.sqrt(np.maximum(np.diag(whole)[1:] / whole[0, 0] - centre**2, 1e-6))
    means, covs = {}, {}
    for k, m in moments.items():
        mean = m[0, 1:] / n[k]
        means[k] = (mean - centre) / scale
        covs[k] = (m[1:, 1:] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    factors = []
    for k in (0, 1):
        shrunk = (1 - shrink) * covs[k] + shrink * pooled
        shrunk = (1 - ridge) * shrunk + ridge * np.diag(np.maximum(np.diag(pooled), 1e-2))
        factors.append(np.linalg.cholesky(shrunk))
    return Quadratic(float(n[1] / (n[0] + n[1])), centre, scale, (means[0], means[1]), (factors[0], factors[1]), sharpness)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(doc_id, x) with the labels of those that may train."""
    given = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return rows.where(trains(F.col("doc_id"))).join(given, "doc_id").select("label", "x")


def measured(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, ...) with the statistics of each text as __gw_x, written to the shared folder, so that they are taken once."""
    return Scratch(spark, "quality").save(docs.withColumn("__gw_x", stats(F.col("text"))), "stats")


def learned(rows: DataFrame, labels: DataFrame) -> Quadratic:
    return fit(labelled(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__gw_x").alias("x")), labels))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = Scratch(spark, "quality").save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), stats(F.col("text")).alias("__gw_x")), "stats")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), learned(rows, labels).score(F.col("__gw_x")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold, unchanged."""
    rows = measured(spark, docs)
    return rows.where(learned(rows, labels).score(F.col("__gw_x")) >= THRESHOLD).drop("__gw_x")
