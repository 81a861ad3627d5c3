r"""Secret scans [native]: fixed patterns, plus a battery of randomness tests on long tokens.

Base kinds are fixed patterns. The method adds spans of kind ``random``: each maximal run of 20 or more
base64-like symbols gets an encoding (hex, base32, one-case letters, base64), and over its alphabet of k symbols

* a chi-squared statistic of uniformity,
* a runs test about the middle of the alphabet,
* a lag-1 serial correlation test.

Their normal scores are combined into one chi-squared statistic of three degrees; a token stays in question
only if that doesn't reject uniform randomness (p >= ``uniform_alpha``). The null hypothesis of the scan is
"written text": symbols repeat as often as in words. The chi-squared statistic's lower tail under that null, whose mean
and spread follow from the token's length, gives the p-value. Benjamini-Hochberg control at ``fdr`` is run within
each class of lengths over the whole corpus, as short tokens hold little evidence. p-values are rounded up
to tenths of a decade, so that control needs a table of fixed size only: lengths classes x 301 bins.

Defined cases: null text counts as empty; an empty text or table has no spans; null doc_id and repeated
rows are kept, each row by itself; extra columns are carried through, apart from those that the scan adds.
Positions are code points, ends exclusive. Rows never meet one another except in the table of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, let, prefix_sums, text_or_empty

#: The base patterns and least lengths (of group 2 for assign, of the match for the others).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans_of(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has the least length, as (start, kind, end) in code points.

    The pieces between matches and the matches themselves alternate, so prefix sums of their lengths are positions.
    """
    found = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("long")).alias("m"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m).cast("long")).alias("g"),
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long")).alias("p"),
    )

    def placed(rows: Column) -> Column:
        steps = F.transform(rows, lambda r: F.coalesce(r["m"], F.lit(0)) + r["p"])
        return F.transform(
            F.arrays_zip(rows.alias("r"), prefix_sums(steps).alias("b")),
            lambda x: F.struct(
                (x["b"] + x["r"]["p"]).alias("start"),
                F.lit(kind).alias("kind"),
                (x["b"] + x["r"]["p"] + x["r"]["m"]).alias("end"),
                x["r"]["g"].alias("size"),
            ),
        )

    kept = F.filter(let(found, placed), lambda s: s["size"].isNotNull() & (s["size"] >= least))
    bare = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern if group else f"(?:{pattern})"), bare).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """All base spans in order of start, then kind."""
    # A hex or access match long enough is the whole of a maximal run, so the least length can stand in the pattern.
    return F.array_sort(
        F.concat(
            spans_of(text, ASSIGN, 0, 8, 2),
            spans_of(text, r"AKIA[A-Z0-9]{12,}", 1, 16),
            spans_of(text, r"[0-9a-f]{32,}", 2, 32),
        )
    )


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-7, by the public rational approximation of the error function."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def chi2_score(stat: Column, df: Column) -> Column:
    """Normal score of a chi-squared statistic by its cube root."""
    v = 2.0 / (9.0 * df)
    return (F.cbrt(stat / df) - (1.0 - v)) / F.sqrt(v)


def battery(token: Column) -> Column:
    """struct(n, k, p_written, p_uniform) of a token."""
    t = F.translate(token, "-_", "+/")
    k = (
        F.when(t.rlike("^[0-9a-f]+$") | t.rlike("^[0-9A-F]+$"), 16)
        .when(t.rlike("^[A-Z]+$") | t.rlike("^[a-z]+$"), 26)
        .when(t.rlike("^[A-Z2-7]+$"), 32)
        .otherwise(64)
    )
    # Each symbol's place in the alphabet of its encoding, from 0.
    symbols = (
        F.when(k == 16, F.lit("0123456789abcdef"))
        .when(k == 26, F.lit("abcdefghijklmnopqrstuvwxyz"))
        .when(k == 32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .otherwise(F.lit(ALPHABET))
    )
    shown = F.when(k.isin(16, 26), F.lower(t)).otherwise(t)

    row = F.struct(F.length(t).alias("n"), k.alias("k"), symbols.alias("symbols"), shown.alias("shown"))
    return let(row, _tests)


def _tests(s: Column) -> Column:
    n, k = s["n"].cast("double"), s["k"].cast("double")
    gone = lambda c: (F.length(s["shown"]) - F.length(F.replace(s["shown"], c, F.lit("")))).cast("double")
    squares = F.aggregate(F.split(s["symbols"], ""), F.lit(0.0), lambda a, c: a + gone(c) * gone(c))
    places = F.transform(F.split(s["shown"], ""), lambda c: (F.instr(s["symbols"], c) - 1).cast("double"))
    pairs = lambda a: F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("x"), F.slice(a, F.lit(2), F.size(a) - 1).alias("y"))

    def scores(v: Column) -> Column:
        squares, places = v["squares"], v["places"]
        chi = k / n * squares - n
        middle, spread = (k - 1.0) / 2.0, (k * k - 1.0) / 12.0
        changes = F.aggregate(pairs(places), F.lit(0.0), lambda a, p: a + ((p["x"] > middle) != (p["y"] > middle)).cast("double"))
        product = F.aggregate(pairs(places), F.lit(0.0), lambda a, p: a + (p["x"] - middle) * (p["y"] - middle))
        z_chi = chi2_score(chi, k - 1.0)
        z_runs = (changes - (n - 1.0) / 2.0) / F.sqrt((n - 1.0) / 4.0)
        z_serial = product / (F.sqrt(n - 1.0) * spread)
        joint = F.pow(F.greatest(z_chi, F.lit(0.0)), 2) + F.pow(z_runs, 2) + F.pow(z_serial, 2)
        # Written text: two symbols are the same with chance match, three with chance triple.
        match = F.when(k == 16, 0.105).when(k == 64, 0.055).otherwise(0.0655)
        triple = F.when(k == 16, 0.0140).when(k == 64, 0.0045).otherwise(0.0062)
        mean = k * (n - 1.0) * match + k - n
        var = 4.0 * n * (n - 1.0) * (n - 2.0) * (triple - match * match) + 2.0 * n * (n - 1.0) * (match - match * match)
        return F.struct(
            s["n"].alias("n"),
            s["k"].alias("k"),
            normal_cdf((chi - mean) / (k / n * F.sqrt(var))).alias("p_written"),
            (1.0 - normal_cdf(chi2_score(joint, F.lit(3.0)))).alias("p_uniform"),
        )

    return let(F.struct(squares.alias("squares"), places.alias("places")), scores)


def length_class(n: Column) -> Column:
    """Lengths within a factor of two share a class."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def p_bin(p: Column) -> Column:
    """Tenths of a decade below 1, at most 300; the bin's p-value 10^(-bin/10) is never below p."""
    return F.least(F.lit(300), F.floor(-10.0 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))


def tested(df: DataFrame) -> DataFrame:
    """df(__gw_text) with __gw_tokens: candidate spans with their tests. Only tokens of the whole text, no pure numbers."""
    text = F.col("__gw_text")
    cut = F.transform(
        spans_of(text, CANDIDATE, 3, 20),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("token")),
    )
    kept = F.filter(cut, lambda s: ~s["token"].rlike("^[0-9]+$"))
    return df.withColumn("__gw_tokens", F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["token"]).alias("t"))))


def thresholds(df: DataFrame, fdr: float, uniform_alpha: float) -> dict[int, int]:
    """Least bin that is a discovery, by length class. At most 32 classes x 301 bins are counted, whatever the corpus."""
    t = F.col("s.t")
    counts = (
        df.select(F.explode("__gw_tokens").alias("s"))
        .select(length_class(t["n"]).alias("c"), F.when(t["p_uniform"] >= uniform_alpha, p_bin(t["p_written"])).otherwise(0).alias("b"))
        .groupBy("c", "b")
        .count()
    )
    falling = Window.partitionBy("c").orderBy(F.desc("b"))
    ranked = counts.withColumn("upto", F.sum("count").over(falling)).withColumn("m", F.sum("count").over(Window.partitionBy("c")))
    fit = ranked.where((F.pow(F.lit(10.0), -F.col("b") / 10.0) * F.col("m") <= fdr * F.col("upto")) & (F.col("b") > 0))
    return {r["c"]: r["b"] for r in fit.groupBy("c").agg(F.min("b").alias("b")).collect()}


def marked(df: DataFrame, text_col: str) -> DataFrame:
    """df with _base and the tested tokens of each text."""
    work = tested(df.withColumn("__gw_text", text_or_empty(text_col)))
    return work.withColumn("_base", base_spans(F.col("__gw_text"))).drop("__gw_text")


def decided(rows: DataFrame, fdr: float, uniform_alpha: float) -> DataFrame:
    """rows(_base, __gw_tokens) with _spans instead of the tokens."""
    bins = thresholds(rows, fdr, uniform_alpha)
    if not bins:
        return rows.withColumn("_spans", F.col("_base")).drop("__gw_tokens")
    least = F.create_map(*[F.lit(x) for kv in bins.items() for x in kv])

    def flagged(s: Column) -> Column:
        t = s["t"]
        bound = F.element_at(least, length_class(t["n"]))
        return bound.isNotNull() & (t["p_uniform"] >= uniform_alpha) & (p_bin(t["p_written"]) >= bound)

    random = F.transform(F.filter("__gw_tokens", flagged), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))).cast(SPAN)
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", random))).drop("__gw_tokens")


def scan(df: DataFrame, text_col: str = "text", fdr: float = 0.05, uniform_alpha: float = 0.001) -> DataFrame:
    """df with _base and _spans, arrays of (start, kind, end); kind counts from 0 in KINDS. Rows are written with their tokens, so texts are searched once."""
    return decided(Scratch(df.sparkSession, "secret-scan").save(marked(df, text_col), "rows"), fdr, uniform_alpha)


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the union of all spans of a text replaced by a mark; _base and _spans stay."""
    text = text_or_empty(text_col)
    # Spans in order of start; one that begins inside what is already covered only extends it.
    step = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(
                a["out"],
                F.when(s["start"] >= a["at"], F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit("")),
            ).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    clean = let(step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return df.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(F.col(text_col)))


def report(df: DataFrame, fdr: float = 0.05, uniform_alpha: float = 0.001) -> DataFrame:
    """One row per row of df: doc_id, counts by base kind, digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    found = marked(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").drop("text")
    return decided(Scratch(df.sparkSession, "secret-scan").save(found, "rows"), fdr, uniform_alpha).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.col("_base")), 256).alias("base_sha256"),
        shown(F.col("_spans")).alias("spans"),
    )
