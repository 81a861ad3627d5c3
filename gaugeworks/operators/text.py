"""Text operators: shingles, redaction, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.folders import Steps

#: Rows of two longs that may be broadcast: 8 MB.
FEW = 500_000

# Shapes of credentials that are blanked, each with what stays before the mark.
REDACTED = "[REDACTED]"
SHAPES = (
    (r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;\"']+", "$1"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/\-]+=*", "$1"),
    (r"apikey_[0-9a-f_]{8,}", ""),
    (r"(?i)((?:api[_-]?key|token|secret)[\"']?\s*[:=]\s*[\"']?)[^\s,;\"'}]+", "$1"),
)


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets, longest first, and credential shapes replaced by a mark."""
    for secret in sorted({s for s in secrets if len(s) >= 6}, key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    for shape, stays in SHAPES:
        text = F.regexp_replace(text, shape, stays + REDACTED)
    return text


def secret_key(name: Column) -> Column:
    """Whether a field's name says that its value is a secret."""
    plain = F.regexp_replace(F.lower(name), "[_-]", "")
    return plain.rlike("authorization|apikey|secret|cookie|credential")


def windows(text: Column, size: int) -> Column:
    """array of md5 of each window of so many words of the whole text, white space collapsed; none if it has fewer words."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.when(
        F.size(words) >= size,
        F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.md5(F.array_join(F.slice(w, i, F.lit(size)), " "))))[0],
    ).otherwise(F.array().cast("array<string>"))


def digests(text: Column, size: int) -> Column:
    """array<struct<a,b>>: 128 bits of each window of so many words, as windows() has them; words are hashed one after another, never joined."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    both = lambda w, i: F.struct(F.xxhash64(F.slice(w, i, F.lit(size))).alias("a"), F.xxhash64(F.lit(size), F.slice(w, i, F.lit(size))).alias("b"))
    return F.when(
        F.size(words) >= size, F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: both(w, i)))[0]
    ).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def contamination(corpus: DataFrame, gated: DataFrame, size: int = 10, common: int | None = None) -> DataFrame:
    """(doc_id, hits): distinct windows of gated texts found in each document. Windows in more than ``common`` gated items are boilerplate.

    Gated windows are deduplicated and written first. Up to ``FEW`` of them go to every task, so that no window of the corpus is shuffled; more meet the corpus by a shuffle join.
    """
    wanted = gated.select("item_id", F.explode(digests(F.col("text"), size)).alias("w")).distinct().groupBy("w").agg(F.count("*").alias("items"))
    if common is not None:
        wanted = wanted.where(F.col("items") <= common)
    wanted = Steps(corpus.sparkSession, "contamination").save(wanted.select("w.a", "w.b"), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    # Repeats within a document are dropped among the windows that are met: few, and an array of pairs is compared pair by pair.
    found = corpus.select("doc_id", F.explode(digests(F.col("text"), size)).alias("w")).select("doc_id", "w.a", "w.b")
    return found.join(wanted, ["a", "b"], "left_semi").distinct().groupBy("doc_id").agg(F.count("*").alias("hits"))
