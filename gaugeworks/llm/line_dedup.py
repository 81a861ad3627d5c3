r"""Line dedup [native]: winnowing over line hashes.

Lines that aren't blank are normalised (runs of white space become one space, ends trimmed, lower case) and hashed.
In each window of ``window`` consecutive line hashes the least is selected (the rightmost of equals), so two
documents that share a run of ``window`` lines select the same fingerprint in it. Fingerprints found at one
position only are dropped. A position whose fingerprint recurs is extended both ways, one window of lines at a
time: each window that covers it is looked up by a 128-bit digest, and the windows found again, overlapping
one another, make up the repeated run. Fewer lines than a window, down to one, are looked up likewise wherever they
hold more than ``words`` words. Of each repeated window the earliest stays, by (doc_id, line); every line that a later one covers is
deleted. So exactly those lines go that lie in a run of at least ``window`` lines, or of more than ``words`` words, occurring earlier, and a
copy of each deleted line stays somewhere: the earliest.

Documents equal in doc_id and text count as one and share its result; null ids rank last. Null text counts as
empty and stays null. Blank lines are never compared or deleted. Extra columns are carried through; one named _gone is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, identity, let, text_or_empty

WINDOW = 3
WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\t\r\f\x0B]+", " ")))


def words_of(line: Column) -> Column:
    """Words of a normalised line that isn't blank."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def hashed_lines(text: Column) -> Column:
    """array<struct<i:int,h:long,w:int>> of the lines that aren't blank, w their words."""
    rows = F.transform(lines_of(text), lambda x, i: let(normal(x), lambda n: F.struct(i.alias("i"), F.when(n != "", F.xxhash64(n)).alias("h"), words_of(n).alias("w"))))
    return F.filter(rows, lambda r: r["h"].isNotNull())


def fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """docs(_id, _h, lines) to (_id, _h, p, h, first, around): one row per selected position, counted among the lines that aren't blank.

    around holds the (at most 2 * window - 1) lines that windows covering the position can reach, first the place of its first.
    """
    n = F.size("lines")
    chosen = F.transform(
        F.sequence(F.lit(0), n - window),
        lambda s: F.array_min(F.transform(F.slice("lines", s + 1, F.lit(window)), lambda r, i: F.struct(r["h"].alias("h"), (-(s + i)).alias("q"))))["q"],
    )
    placed = docs.where(n >= window).select("_id", "_h", "lines", F.explode(F.array_distinct(chosen)).alias("q"))
    p = -F.col("q")
    first = F.greatest(F.lit(0), p - (window - 1))
    return placed.select(
        "_id", "_h", p.alias("p"), F.element_at("lines", p + 1)["h"].alias("h"), first.alias("first"),
        F.slice("lines", first + 1, p + window - first).alias("around"),
    )


def wordy(lines: DataFrame, window: int, words: int) -> DataFrame:
    """Runs of fewer than ``window`` lines that hold more than ``words`` words, as rows of runs; the words are part of the digest."""

    def of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("lines") - n), lambda s: let(F.slice("lines", s + 1, F.lit(n)), lambda x: F.struct(s.alias("s"), x.alias("x"))))
        return F.when(F.size("lines") >= n, F.filter(each, lambda e: F.aggregate(e["x"], F.lit(0), lambda t, r: t + r["w"]) > words))

    none = F.array().cast("array<struct<s:int,x:array<struct<i:int,h:bigint,w:int>>>>")
    found = lines.select("_id", "_h", F.explode(F.concat(*[F.coalesce(of(n), none) for n in range(1, window)])).alias("e"))
    marks = [F.transform("e.x", lambda r: r["h"]), F.transform("e.x", lambda r: r["w"])]
    return found.select(
        "_id", "_h", F.col("e.s").alias("s"), F.xxhash64(*marks, F.size("e.x")).alias("a"), F.xxhash64(F.lit(window), *marks).alias("b"),
        F.transform("e.x", lambda r: r["i"]).alias("at"),
    )


def repeated_lines(spark: SparkSession, docs: DataFrame, window: int, words: int, scratch: Scratch) -> DataFrame:
    """(_id, _h, gone): for each document with deleted lines, their indexes in the text."""
    lines = docs.select(*identity(), hashed_lines(text_or_empty("text")).alias("lines"))
    lines = scratch.save(lines.groupBy("_id", "_h").agg(F.any_value("lines").alias("lines")), "lines")
    marks = scratch.save(fingerprints(lines, window), "marks")
    shared = scratch.save(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    starts = marks.join(shared, "h").select("_id", "_h", F.posexplode(
        F.transform(F.sequence(F.lit(0), F.size("around") - window), lambda k: F.slice("around", k + 1, F.lit(window)))
    ).alias("k", "run"), "first")
    hashes = F.transform("run", lambda r: r["h"])
    runs = scratch.save(
        wordy(lines, window, words).unionByName(starts.select(
            "_id", "_h", (F.col("first") + F.col("k")).alias("s"), F.xxhash64(hashes).alias("a"), F.xxhash64(hashes, F.lit(window)).alias("b"),
            F.transform("run", lambda r: r["i"]).alias("at"),
        ).dropDuplicates(["_id", "_h", "s"])),
        "runs",
    )
    first = runs.groupBy("a", "b").agg(F.min(F.struct("_id", "_h", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.select("a", "b", "first"), "first")
    later = runs.join(first, ["a", "b"]).where(F.struct("_id", "_h", "s") > F.col("first"))
    return later.select("_id", "_h", F.explode("at").alias("i")).groupBy("_id", "_h").agg(F.sort_array(F.collect_set("i")).alias("gone"))


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """docs with text without its repeated runs, and _gone, the deleted lines' indexes; text is null where it was null."""
    scratch = Scratch(spark, "line-dedup")
    gone = scratch.save(repeated_lines(spark, docs, window, words, scratch), "gone")
    scratch.keep("gone")
    keyed = docs.withColumns({"__gw_id": identity()[0], "__gw_h": identity()[1]})
    gone = gone.select(F.col("_id").alias("__gw_id"), F.col("_h").alias("__gw_h"), F.col("gone").alias("__gw_gone"))
    found = keyed.join(gone.hint("merge"), ["__gw_id", "__gw_h"], "left").withColumn("_gone", F.coalesce("__gw_gone", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return found.withColumn("text", F.when(F.size("_gone") > 0, kept).otherwise(F.col("text"))).drop("__gw_id", "__gw_h", "__gw_gone")


def report(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, text_sha256 of what stays."""
    done = dedup(spark, docs.select("doc_id", "text", F.size(lines_of(text_or_empty("text"))).cast("long").alias("n_lines")), window)
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.size("_gone").cast("long").alias("n_removed"),
        F.sha2(text_or_empty("text"), 256).alias("text_sha256"),
    )


#: Brute force over texts themselves: every window of lines, not only those at fingerprints.
ORACLE = rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM split
), norm AS (
  SELECT doc_id, i, lower(trim(regexp_replace(raw, '[\x20\t\r\f\x0B]+', ' ', 'g'))) AS t FROM line
), seq AS (
  SELECT doc_id, i, t, length(t) - length(replace(t, ' ', '')) + 1 AS n, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(i) OVER w AS i1, lead(i, 2) OVER w AS i2
  FROM norm WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, i, [i, i1, i2] AS spots, [t, t1, t2] AS k FROM seq WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, i, [i], [t] FROM seq WHERE n > {WORDS}
  UNION ALL SELECT doc_id, i, [i, i1], [t, t1] FROM seq WHERE n + length(t1) - length(replace(t1, ' ', '')) + 1 > {WORDS}
), ranked AS (
  SELECT doc_id, spots, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(spots) AS i FROM ranked WHERE r > 1
), kept AS (
  SELECT l.doc_id, count(*)::bigint AS n_lines, count(g.i)::bigint AS n_removed,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM kept"""
