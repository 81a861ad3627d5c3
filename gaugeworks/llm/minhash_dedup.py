r"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of ``shingle`` words. Sets that are equal are one class and are handled once, so groups of
copies of any size cost one row. A class's signature is ``CHUNKS * WIDTH`` minimum hashes, of each the low 8 bits; two signatures are at the distance of the number of
positions that differ. By the pigeonhole principle signatures at a distance under ``CHUNKS * (ERRORS + 1)`` have a chunk with at most
``ERRORS`` = 1 differing positions: each chunk is indexed once for every position that may differ, which is left out of the key. So every pair of
signatures at a distance of at most 23 of 72 meets in a bucket; a pair of Jaccard similarity 0.8 fails to meet with chance 3e-6.

Buckets never list their pairs, nor are any paired for no more than a bucket. A bucket's hub is its member with most bucket mates over all keys (in a group of edited copies: what
they were copied from). First each member is held against the hub only, links found so are confirmed on the full sets, and connected
components are formed: a group of thousands of near copies mostly melts down to one component. Pairs within a component need no look, as
components are what is returned. Members of different components that share a bucket are left, and of them

* those near the same hub are compared by their differences from the group's core h, the elements that more than half of its sets hold. If x isn't
  as similar to h as a link asks for, a link of x and y needs more than (|y - h| + |h - y| + (|h| - |y|) * q) / 2 common elements of the differences of x
  and y, with q = (100 - percent) / (100 + percent). So of y's difference all but that many less one must hold one that x shares; an inverted index over
  the rarest of them finds every link, and as edits differ from copy to copy, it meets few pairs, however large the group. Of any two components one
  isn't the group's largest; what of that is near the core is little, and is paired with the whole group;
* all others meet through an inverted index too: of a set of n elements, taken from the rarest among those left to the commonest, a link must share one of the
  first n - ceil(n * percent / 100) + 1. A passage that many unrelated documents hold is common, so it is in the first elements of none that has enough of
  its own. Of the sets that share an element most may be near one hub; as pairs of one hub are looked for above, one set of each pair isn't of that hub.

A pair is confirmed on the full sets if its signatures are at a distance of at most ``MAX_DISTANCE`` (five standard deviations above
the mean at similarity 0.8): a link needs 100 * intersection >= percent * union.

Words are runs of anything but space and the characters 9 to 13, A-Z lowered. Shingles are compared by 64-bit hashes of their words.
Fewer words than a shingle: the whole sequence is the one shingle. No words, no text: an empty set, linked with nothing. Rows equal in id and text are one document; a null id
ranks last and shows as null. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import NO_ID, Scratch, identity, text_or_empty
from gaugeworks.llm.graph import components

CHUNKS, WIDTH, ERRORS = 12, 6, 1
POSITIONS = CHUNKS * WIDTH
MAX_DISTANCE = 34

_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        # Another length hashes differently even where words are the same.
        return np.array([xxhash.xxh64_intdigest("\x20".join(words), seed=size)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mixed(out * _STEP + np.uint64(k)) + h[k : k + n]
    return np.unique(mixed(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(least, (_FACTORS[:, None] * part[None, :] + _ADDED[:, None]).min(axis=1), out=least)
    # The high bits decide the minimum; the low ones of a mix of it are as good as random.
    return (mixed(least) & np.uint64(255)).astype(np.uint8)


def signed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """(_id, _h, text) to (_id, _h, n, c, c2, sig); c and c2 name the set, sig holds the signature's bytes in longs."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            s = shingles(text, size)
            if len(s):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                c, c2 = (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63
                rows.append((len(s), c, c2, signature(s).view("<i8")))
            else:
                rows.append((0, 0, 0, np.empty(0, np.int64)))
        frame = pd.DataFrame(rows, columns=["n", "c", "c2", "sig"])
        frame.insert(0, "_id", batch["_id"].to_numpy())
        frame.insert(1, "_h", batch["_h"].to_numpy())
        yield frame


def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, sig) to (key, c): every chunk with each of its positions left out in turn. Keys are exact, not hashes."""
    for batch in batches:
        for at in range(0, len(batch), 5000):
            some = batch.iloc[at : at + 5000]
            sigs = np.stack(some["sig"].to_list()).astype("<i8").view(np.uint8).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
            keys = np.empty((len(some), CHUNKS, WIDTH), np.int64)
            for out in range(WIDTH):
                key = np.arange(CHUNKS, dtype=np.int64)[None, :] * WIDTH + out
                for p in range(WIDTH):
                    if p != out:
                        key = (key << 8) | sigs[:, :, p]
                keys[:, :, out] = key
            yield pd.DataFrame({"key": keys.reshape(-1), "c": np.repeat(some["c"].to_numpy(), CHUNKS * WIDTH)})


def distance(a: Column, b: Column) -> Column:
    """Positions (bytes) in which two signatures differ."""

    def differing(x: Column) -> Column:
        # Each byte's bits are gathered in its lowest one.
        x = x.bitwiseOR(F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x0303030303030303))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x0101010101010101)))

    parts = [differing(a[i].bitwiseXOR(b[i])) for i in range(POSITIONS // 8)]
    return sum(parts[1:], parts[0])


def listed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """(c, text) to (c, set)."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            some = batch.iloc[at : at + 500]
            yield pd.DataFrame({"c": some["c"].to_numpy(), "set": [shingles(t, size).view(np.int64) for t in some["text"]]})


class NearDuplicates:
    """One run over a table of documents(doc_id, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int, percent: int) -> None:
        self.spark, self.shingle, self.percent = spark, shingle, percent
        self.scratch = Scratch(spark, "minhash")
        self.rows = docs.select(*identity(), text_or_empty("text").alias("text"))
        signs = self.rows.mapInPandas(lambda b: signed(b, shingle), "_id bigint, _h bigint, n bigint, c bigint, c2 bigint, sig array<bigint>")
        self.signs = self.scratch.save(signs, "signs")
        found = self.signs.where("n > 0").groupBy("c", "c2").agg(F.min(F.struct("_id", "_h", "n", "sig")).alias("r"))
        #: One row per distinct set, with the document that stands for it.
        self.classes = self.scratch.save(found.select("c", "r._id", "r._h", "r.n", "r.sig"), "classes")

    def similar(self, x: str, y: str) -> Column:
        """Whether sizes and signatures of the columns n and sig with these suffixes allow a link."""
        sizes = 100 * F.least(f"n{x}", f"n{y}") >= self.percent * F.greatest(f"n{x}", f"n{y}")
        return sizes & (distance(F.col(f"sig{x}"), F.col(f"sig{y}")) <= MAX_DISTANCE)

    def seen(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b, ...) with sizes, and only those whose signatures allow a link."""
        known = self.classes.select("c", "n", "sig")
        a, b = (known.withColumnsRenamed({"c": x, "n": f"n{x}", "sig": f"sig{x}"}) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(self.similar("a", "b")).drop("siga", "sigb")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b, na, nb) that are links by their full sets."""
        a, b = (self.sets.withColumnsRenamed({"c": x, "set": f"set{x}"}) for x in "ab")
        common = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("seta", "setb")))
        return common.where(f"100 * common >= {self.percent} * (na + nb - common)").select("a", "b")

    def buckets(self) -> None:
        """live(key, c, degree, hub, hub_degree): members of all buckets of two or more, and sets of all their classes."""
        keys = self.classes.select("c", "sig").mapInPandas(keyed, "key bigint, c bigint")
        full = self.scratch.save(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "full")
        live = self.scratch.save(keys.join(full, "key"), "members")
        degrees = self.scratch.save(live.groupBy("c").agg(F.sum("size").alias("degree")), "degrees")
        self.scratch.drop("full")
        live = self.scratch.save(live.select("key", "c").join(degrees, "c"), "ranked")
        hubs = self.scratch.save(live.groupBy("key").agg(F.max(F.struct("degree", "c")).alias("hub")), "hubs")
        self.live = self.scratch.save(live.join(hubs, "key").select("key", "c", F.col("hub.c").alias("hub"), F.col("hub.degree").alias("hub_degree")), "live")
        self.scratch.drop("members", "ranked", "hubs")
        needed = degrees.select("c").join(self.classes.select("c", "_id", "_h"), "c")
        texts = self.rows.join(needed.hint("merge"), ["_id", "_h"]).dropDuplicates(["c"]).select("c", "text")
        self.sets = self.scratch.save(texts.mapInPandas(lambda b, k=self.shingle: listed(b, k), "c bigint, set array<bigint>"), "sets")

    def roots(self) -> DataFrame:
        """(c, root) of every class that is linked with another."""
        self.buckets()
        stars = self.live.where("c <> hub").select(F.col("c").alias("a"), F.col("hub").alias("b"), "hub_degree").distinct()
        close = self.scratch.save(self.seen(stars), "close")
        links = self.scratch.save(self.confirmed(close), "star-links")
        roots = components(self.scratch, links, "star-roots")
        # What is left: members of one bucket in different components.
        rooted = self.scratch.save(self.live.select("key", "c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        left = self.scratch.save(rooted.join(self.scratch.save(apart, "apart"), "key"), "left")
        # A class's hub: of those that it is near to, the one of most bucket mates; a hub near to none is its own.
        own = close.groupBy(F.col("a").alias("c")).agg(F.max(F.struct("hub_degree", "b"))["b"].alias("h"))
        alone = close.select(F.col("b").alias("c")).distinct().join(own, "c", "left_anti").select("c", F.col("c").alias("h"))
        self.hubs = self.scratch.save(own.unionByName(alone), "own-hubs")
        pairs = self.across(left).unionByName(self.beside(left)).distinct()
        both = close.select("a", "b").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = self.scratch.save(self.confirmed(self.seen(pairs.join(both, ["a", "b"], "left_anti"))), "more-links")
        return components(self.scratch, links.unionByName(more), "roots")

    def across(self, left: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that aren't near the same hub and can be links, by an inverted index over each set's rarest elements."""
        members = left.select("c", "root").distinct().join(self.hubs, "c", "left").withColumn("h", F.coalesce("h", "c"))
        members = self.scratch.save(members.join(self.sets, "c").select("c", "root", "h", F.size("set").alias("n"), "set"), "sided")
        parts = members.select("c", "root", "h", "n", F.explode("set").alias("e"))
        common = self.scratch.save(parts.groupBy("e").agg(F.count("*").alias("f")).where("f > 1"), "frequent")
        rank = F.row_number().over(Window.partitionBy("c").orderBy("f", "e"))
        # ceil of n * percent / 100, in whole numbers.
        first = F.col("n") - F.floor((F.col("n") * self.percent + 99) / 100).cast("int") + 1
        ranked = parts.join(common, "e", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", rank)
        rare = self.scratch.save(ranked.where((F.col("r") <= first) & (F.col("f") > 1)).select("e", "c", "root", "h", "n"), "rare")
        usual = rare.groupBy("e", "h").agg(F.count("*").alias("k")).groupBy("e").agg(F.max(F.struct("k", "h"))["h"].alias("usual"))
        x = rare.join(self.scratch.save(usual, "usual"), "e").where("h <> usual").select("e", F.col("c").alias("x"), F.col("root").alias("rx"), F.col("h").alias("hx"), F.col("n").alias("nx"))
        y = rare.withColumnsRenamed({"c": "y", "root": "ry", "h": "hy", "n": "ny"})
        sized = 100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny")
        met = x.join(y, "e").where((F.col("rx") != F.col("ry")) & (F.col("hx") != F.col("hy")) & sized)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def beside(self, left: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components near the same hub that can be links, by an inverted index over differences from the group's core."""
        less, more = 100 - self.percent, 100 + self.percent
        members = left.select("c", "root").distinct().join(self.hubs, "c")
        sizes = members.groupBy("h", "root").agg(F.count("*").alias("k"))
        group = sizes.groupBy("h").agg(F.sum("k").alias("m"), F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1")
        group = self.scratch.save(group.drop("roots"), "hub-groups")
        members = members.join(group, "h").join(self.sets, "c").join(self.sets.withColumnsRenamed({"c": "h", "set": "hub_set"}), "h")
        delta = F.concat(F.array_except("set", "hub_set"), F.array_except("hub_set", "set"))
        members = self.scratch.save(members.select("h", "c", "root", "main", F.size("set").alias("n"), delta.alias("delta")), "deltas")
        # The core: what more than half of a group's sets hold. The hub differs from it in what is in most differences.
        odd = members.select("h", F.explode("delta").alias("e")).groupBy("h", "e").agg(F.count("*").alias("f")).join(group, "h").where("2 * f > m")
        odd = odd.groupBy("h").agg(F.collect_list("e").alias("odd"))
        core = group.select("h").join(odd, "h", "left").withColumn("odd", F.coalesce("odd", F.array().cast("array<bigint>")))
        core = core.join(self.sets.withColumnsRenamed({"c": "h"}), "h").select(
            "h", "odd", (F.size("set") + F.size("odd") - 2 * F.size(F.array_intersect("set", "odd"))).alias("nh")
        )
        members = members.join(self.scratch.save(core, "core"), "h").withColumn("delta", F.concat(F.array_except("delta", "odd"), F.array_except("odd", "delta"))).drop("odd")
        d = F.size("delta")
        least = F.floor((d * more + (F.col("nh") - F.col("n")) * less) / (2 * more)).cast("int") + 1
        far = d * more > (F.col("n") + F.col("nh")) * less
        members = self.scratch.save(members.withColumn("most", d - least + 1).withColumn("far", far), "cored")
        parts = members.select("h", "c", "root", "main", "far", "most", F.explode("delta").alias("e"))
        common = self.scratch.save(parts.groupBy("h", "e").agg(F.count("*").alias("f")), "common")
        rank = F.row_number().over(Window.partitionBy("h", "c").orderBy("f", "e"))
        rare = parts.join(common, ["h", "e"]).withColumn("r", rank).where("r <= most AND f > 1")
        y = rare.select("h", F.col("c").alias("y"), F.col("root").alias("ry"), "e")
        x = parts.where("far AND root <> main").select("h", F.col("c").alias("x"), F.col("root").alias("rx"), "e")
        met = x.join(y, ["h", "e"]).where("rx <> ry").select("x", "y")
        # Sets near the core that still are outside the main component are few; they are paired with the whole group.
        near = members.where("NOT far AND root <> main").select("h", F.col("c").alias("x"), F.col("root").alias("rx"))
        met = met.unionByName(near.join(members.select("h", F.col("c").alias("y"), F.col("root").alias("ry")), "h").where("rx <> ry").select("x", "y"))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """(_id, _h, n, component, root) of every document; rows equal in id and text are listed each. root is null for empty sets."""
        roots = self.scratch.save(self.classes.select("c", "_id").join(self.roots(), "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted-classes")
        # Written, so that the join back is one whose large partitions can be split.
        least = self.scratch.save(roots.groupBy("root").agg(F.min("_id").alias("component")), "least")
        named = self.scratch.save(roots.join(least, "root").select("c", "component", "root"), "named")
        self.scratch.keep("signs", "named")
        found = self.signs.select("_id", "_h", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(named.hint("merge"), "c", "left")
        return found.select("_id", "_h", "n", F.coalesce("component", "_id").alias("component"), "root")


def report(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    groups = NearDuplicates(spark, docs.select("doc_id", "text"), shingle, percent).groups()
    return groups.select(given("_id").alias("doc_id"), F.col("n").alias("n_shingles"), given("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))


def kept(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first document (by id, then text hash) of each group; of repeated rows one stays. Empty texts stay."""
    groups = NearDuplicates(spark, docs.select("doc_id", "text"), shingle, percent).groups()
    first = groups.where("n > 0").groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("k")).select("k.*")
    first = first.unionByName(groups.where("n = 0").select("_id", "_h")).withColumnsRenamed({"_id": "__gw_id", "_h": "__gw_h"})
    rows = docs.withColumns({"__gw_id": identity()[0], "__gw_h": identity()[1]})
    return rows.join(first.hint("merge"), ["__gw_id", "__gw_h"], "left_semi").dropDuplicates(["__gw_id", "__gw_h"]).drop("__gw_id", "__gw_h")


def oracle(shingle: int, percent: int) -> str:
    """All pairs that share a shingle, counted in full, and the documents that each reaches."""
    word = "string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ')"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter({word}, lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle} - 1], ' '))) END AS s
  FROM words
), rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, min(r.r) AS component_id, min(r.r) = s.doc_id AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""
