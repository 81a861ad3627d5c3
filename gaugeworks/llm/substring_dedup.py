r"""Substring dedup: hashing of lines and of the paragraphs within them.

Words are runs of anything but space and the characters 9 to 13, A-Z lowered, so units are the same whatever stands between their words. A line of up to
``reach`` words is one unit. A longer one is cut where its words say so: of each ``reach`` consecutive pairs of neighbouring words the pair of least mark
(made of the words' lengths, first and last characters; the leftmost of equals) is chosen, and a unit ends between the two. So a passage is cut alike wherever it stands in a line, from its first ``reach`` words on
to its last, and no unit is longer.

Each two neighbouring units are one paragraph. Digests of paragraphs are grouped over the corpus; of each digest the occurrence that ranks first by (doc_id, place) is kept and every
later one is repeated. Repeated paragraphs that overlap or touch make up a stretch, which is removed if it holds ``least`` words or more: the bound is on the stretch, never on a
unit. Short units are common and a list of them may be repeated one by one without being a copy of anything; by twos they must also follow one another elsewhere.
Hence of a passage of ``least + 2 * reach`` words or more that occurred earlier, however it is placed in lines, at most ``reach`` words at either end stay; a whole
repeated line of ``least`` words goes whole.

Texts are never shuffled to find repeats, only digests and places: first digests alone are counted, in partial sums, so that a unit found
in a third of all documents costs one row per task; then occurrences of repeated digests are picked by a sort-merge join, whose large partitions Spark can split.
A digest has 64 bits; as no paragraph holds ``least`` words, a stretch takes two matches that overlap.

Documents equal in doc_id and text count as one; null ids rank last. Null and empty texts have no units. Extra columns are
carried through; one named removed is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import NO_ID, Scratch, chunks, identity, text_or_empty
from gaugeworks.llm.words import polynomial

REACH = 8
LEAST = 20
CHARS_AT_ONCE = 2_000_000
#: Multipliers of what marks a word: its first and last character, its length, and the word's place in a pair.
FIRST, LAST, SIZE, PAIR = 1540483477, 1812433253, 1103515245, 1664525525

_LOW32 = np.uint64(0xFFFFFFFF)

UNITS = "array<struct<at:int,n:int,start:int,end:int,a:bigint>>"


def cut_after(marks: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Whether a unit ends after each word, from the words' marks and lines."""
    n = len(marks)
    ends = np.ones(n, bool)
    ends[:-1] = line[1:] != line[:-1]
    if n > reach:
        pair = (marks[:-1] * np.uint64(PAIR) & _LOW32) ^ marks[1:]
        first = np.flatnonzero(line[:-reach] == line[reach:])  # windows of pairs that lie in one line
        ends[first + np.lib.stride_tricks.sliding_window_view(pair, reach)[first].argmin(axis=1)] = True
    return ends


def units(texts: list[str], reach: int) -> tuple[np.ndarray, ...]:
    """Per paragraph, two neighbouring units, of all texts: its text's number, its first word's number there, its words, its first and last character (exclusive), its digest."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    # Texts stand on lines of their own, so nothing reaches from one to the next.
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.ones(len(chars) + 2, bool)
    blank[1:-1] = (chars == 32) | ((chars >= 9) & (chars <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64))
    line = np.searchsorted(np.flatnonzero(chars == 10), start)
    letters = chars[~blank[1:-1]].astype(np.uint64)
    letters[(letters >= 65) & (letters <= 90)] += np.uint64(32)
    n = end - start
    first = np.cumsum(n) - n
    marks = letters[first] * np.uint64(FIRST) + letters[first + n - 1] * np.uint64(LAST) + n.astype(np.uint64) * np.uint64(SIZE) & _LOW32
    last = np.flatnonzero(cut_after(marks, line, reach))
    at = np.r_[0, last[:-1] + 1]
    text = np.searchsorted(begin, start[at], side="right") - 1
    own = np.searchsorted(start, begin)  # each text's first word
    digests = polynomial(polynomial(letters, n), last - at + 1)
    i = np.flatnonzero(text[1:] == text[:-1])  # units that have a next one in their text
    if not len(i):
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64))
    both = polynomial(np.stack([digests[i], digests[i + 1]], axis=1).ravel(), np.full(len(i), 2))
    small = lambda x: x.astype(np.int32)
    text, at, last = text[i], at[i], last[i + 1]
    return text, small(at - own[text]), small(last - at + 1), small(start[at] - begin[text]), small(end[last] - begin[text]), both.view(np.int64)


def listed(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(_id, _h, text) to (_id, _h, units). Texts are taken a few at a time."""
    for batch in batches:
        done, sizes = [], []
        for texts in chunks(batch.column("text"), CHARS_AT_ONCE):
            done.append(units(texts, reach))
            sizes.append(np.bincount(done[-1][0], minlength=len(texts)))
        if not done:
            continue
        made = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in done])) for k in range(1, 6)], ["at", "n", "start", "end", "a"])
        offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.ListArray.from_arrays(offsets, made)], ["_id", "_h", "units"])


def repeats(spark: SparkSession, docs: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """One row per removed stretch: _id, _h, start, end, n_words, and where its first unit was kept: keep_id, keep_start."""
    if 2 * reach >= least:
        raise ValueError("a paragraph must be shorter than the least stretch")
    scratch = Scratch(spark, "substring-dedup")
    rows = docs.select(*identity(), text_or_empty("text").alias("text"))
    listing = rows.mapInArrow(lambda b: listed(b, reach), f"_id bigint, _h bigint, units {UNITS}")
    found = scratch.save(listing, "units").select("_id", "_h", F.explode("units").alias("u")).select("_id", "_h", "u.*")
    shared = scratch.save(found.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "shared")
    # Rows equal in id and text are one document, whose units are later ones of nothing.
    common = scratch.save(found.join(shared.hint("merge"), "a", "left_semi"), "common")
    scratch.drop("units", "shared")
    first = common.groupBy("a").agg(F.min(F.struct("_id", "_h", "at", "start")).alias("first"), F.max(F.struct("_id", "_h", "at", "start")).alias("last"))
    first = scratch.save(first.where("first <> last").select("a", "first"), "first")
    scratch.keep("common", "first")
    later = common.join(first.hint("merge"), "a").where("struct(_id, _h, at) > struct(first._id, first._h, first.at)")
    later = later.select("_id", "_h", "at", "n", "start", "end", F.col("first._id").alias("keep_id"), F.col("first.start").alias("keep_start"))
    # A document's paragraphs meet in one group, which is no larger than its text.
    order = Window.partitionBy("_id", "_h").orderBy("at")
    upto = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.dropDuplicates(["_id", "_h", "at"]).withColumn("begins", (upto.isNull() | (upto < F.col("at"))).cast("int")).withColumn("stretch", F.sum("begins").over(order))
    whole = marked.groupBy("_id", "_h", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("n")) - F.min("at")).cast("long").alias("n_words"),
        F.min(F.struct("at", "keep_id", "keep_start")).alias("keep"),
    )
    return whole.where(F.col("n_words") >= least).select("_id", "_h", "start", "end", "n_words", "keep.keep_id", "keep.keep_start")


def dedup(spark: SparkSession, docs: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """docs with text without its repeated stretches, and removed: the stretches' array of (start, end) in the original text."""
    scratch = Scratch(spark, "substring-dedup-texts")
    found = repeats(spark, docs, reach, least).groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__gw_found"))
    found = scratch.save(found.withColumnsRenamed({"_id": "__gw_id", "_h": "__gw_h"}), "found")
    keyed = docs.withColumns({"__gw_id": identity()[0], "__gw_h": identity()[1]}).join(found.hint("merge"), ["__gw_id", "__gw_h"], "left")
    begin = F.concat(F.array(F.lit(0)), F.col("__gw_found.end"))
    until = F.concat(F.col("__gw_found.start"), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(begin, until, lambda x, y: F.substring(F.col("text"), x + 1, y - x)), "")
    return keyed.withColumns({
        "text": F.when(F.col("__gw_found").isNotNull(), kept).otherwise(F.col("text")),
        "removed": F.coalesce("__gw_found", F.array().cast("array<struct<start:int,end:int>>")),
    }).drop("__gw_id", "__gw_h", "__gw_found")


def report(spark: SparkSession, docs: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """One row per removed stretch: doc_id, start, end, n_words, keep_doc_id, keep_start; offsets in code points, ends exclusive."""
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return repeats(spark, docs.select("doc_id", "text"), reach, least).select(
        given("_id").alias("doc_id"), "start", "end", "n_words", given("keep_id").alias("keep_doc_id"), "keep_start",
    )


#: The same on the texts of units themselves, not on their digests.
ORACLE = rf"""
WITH line AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), placed AS (
  SELECT *, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY l) - length(raw) - 1)::int AS base FROM line
), parts AS (
  -- The words of a line, each after the white space before it.
  SELECT doc_id, l, base, regexp_extract_all(raw, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ps FROM placed
), word AS (
  SELECT doc_id, l, base, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM parts
), spelt AS (
  SELECT *, translate(ltrim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM word
), found AS (
  SELECT doc_id, l, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY l, k) - 1 AS i,
         (base + sum(length(p)) OVER (PARTITION BY doc_id, l ORDER BY k))::int AS stop, length(w) AS size,
         (unicode(w) * {FIRST}::bigint + unicode(right(w, 1)) * {LAST}::bigint + length(w) * {SIZE}) % 4294967296 AS m
  FROM spelt
), pair AS (
  SELECT doc_id, l, i, xor(m * {PAIR} % 4294967296, lead(m) OVER (PARTITION BY doc_id, l ORDER BY k)) AS h FROM found
), least AS (
  SELECT doc_id, min(h * 16777216 + i) OVER w AS best, count(h) OVER w AS n FROM pair WHERE h IS NOT NULL
  WINDOW w AS (PARTITION BY doc_id, l ORDER BY i ROWS BETWEEN CURRENT ROW AND {REACH - 1} FOLLOWING)
), cut AS (
  SELECT DISTINCT doc_id, best % 16777216 + 1 AS i FROM least WHERE n = {REACH}
), numbered AS (
  SELECT f.*, sum((k = 1 OR c.i IS NOT NULL)::int) OVER (PARTITION BY f.doc_id ORDER BY f.i) AS unit FROM found f LEFT JOIN cut c ON f.doc_id = c.doc_id AND f.i = c.i
), units AS (
  SELECT doc_id, min(i) AS i, count(*) AS n, min(stop - size) AS start, max(stop) AS stop, string_agg(w, ' ' ORDER BY i) AS t FROM numbered GROUP BY doc_id, unit
), twos AS (
  SELECT * FROM (SELECT doc_id, i, start, n + lead(n) OVER w AS n, lead(stop) OVER w AS stop, t || chr(10) || lead(t) OVER w AS t FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE t IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start FROM twos
  WINDOW w AS (PARTITION BY t ORDER BY doc_id, i)
), later AS (
  SELECT *, coalesce((max(i + n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < i)::int, 1) AS begins FROM ranked WHERE r > 1
), stretches AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM later
)
SELECT doc_id, min(start)::int AS start, max(stop)::int AS "end", (max(i + n) - min(i))::bigint AS n_words, arg_min(keep_doc_id, i) AS keep_doc_id, arg_min(keep_start, i)::int AS keep_start
FROM stretches GROUP BY doc_id, stretch HAVING max(i + n) - min(i) >= {LEAST}"""
