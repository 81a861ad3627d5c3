"""Texts: contamination, redaction, parsing, recovery, menus, identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import recovery
from gaugeworks.functions import scalars as S
from gaugeworks.operators import text as T
from gaugeworks.plans.registry import query
from gaugeworks.tables import load

_WORDS = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


@query(
    "shingle_contamination",
    f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 9], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw WHERE len(w) >= 10)),
b AS (SELECT DISTINCT md5(array_to_string(w[i:i + 9], ' ')) AS h FROM (SELECT w, unnest(range(1, len(w) - 8)) AS i FROM bw WHERE len(w) >= 10))
SELECT doc_id, count(*)::bigint AS hits FROM d JOIN b USING (h) GROUP BY doc_id""",
)
def shingle_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten-word windows of the benchmark."""
    return T.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query(
    "boilerplate_windows",
    f"""WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark), b AS (SELECT DISTINCT item_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw WHERE len(w) >= 5))
SELECT items, count(*)::bigint AS n_windows FROM (SELECT h, count(*)::bigint AS items FROM b GROUP BY h) GROUP BY items""",
)
def boilerplate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items share a five-word window."""
    each = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.windows(F.col("text"), 5))).alias("w"))
    return each.groupBy("w").agg(F.count("*").alias("items")).groupBy("items").agg(F.count("*").alias("n_windows"))


_RE = r"regexp_replace({0}, '{1}', '{2}', 'g')"


def _redact_sql(text: str) -> str:
    for shape, stays in T.SHAPES:
        text = _RE.format(text, shape.replace("'", "''"), ("\\1" if stays else "") + T.REDACTED)
    return text


@query("redaction", f"SELECT doc_id, sha256({_redact_sql('text')}) AS text_sha256 FROM documents WHERE {_redact_sql('text')} <> text")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents changed by blanking credentials."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", T.redacted(F.col("text")).alias("clean"))
    return rows.where("clean <> text").select("doc_id", F.sha2("clean", 256).alias("text_sha256"))


@query(
    "secret_scan",
    r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}')) AS hit FROM documents)
SELECT doc_id, count(*)::bigint AS n_hits, count(DISTINCT hit)::bigint AS n_distinct FROM h WHERE NOT regexp_matches(hit, '^(0+|f+)$') GROUP BY doc_id""",
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-like strings by document, without known fakes."""
    hits = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}"), F.lit(0))).alias("hit"))
    return hits.where(~F.col("hit").rlike("^(0+|f+)$")).groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.count_distinct("hit").alias("n_distinct"))


_KEYS = ("The", "To", "La", "Die")


@query(
    "strict_parse",
    """WITH r AS (SELECT conv_id, turn, trim(regexp_extract(text, '^[^ ]*')) AS head FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN head IN ('The', 'To', 'La', 'Die') THEN head END AS key, head IN ('The', 'To', 'La', 'Die') AS valid FROM r""",
)
def strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's first word counts only if it is a key as it stands."""
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.trim(F.regexp_extract("text", "^[^ ]*", 0)).alias("head"))
    valid = F.col("head").isin(*_KEYS)
    return rows.select("conv_id", "turn", F.when(valid, F.col("head")).alias("key"), valid.alias("valid"))


@query("recover_choice")
def recover_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys recovered from free replies by stage. Tests hold the stages against hand-made replies."""
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", recovery.recovered(F.col("text"), [k.lower() for k in _KEYS]).alias("r"))
    return rows.select("conv_id", "turn", "r.key", "r.stage")


@query(
    "prefix_mass",
    """WITH w AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[ \n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word),
p AS (SELECT left(word, 2) AS prefix, sum(freq)::bigint AS mass, count(*)::bigint AS n_words, arg_max(word, (freq, word)) AS top FROM w GROUP BY 1) SELECT * FROM p""",
)
def prefix_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of all words by their first two letters, and the most frequent completion."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[ \n]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("freq"))
    return words.groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.sum("freq").alias("mass"), F.count("*").alias("n_words"), F.max(F.struct("freq", "word"))["word"].alias("top"))


@query(
    "option_block_parse",
    r"""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)">', 1))::bigint AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), ' ') AS links,
  len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)">', 1)))::bigint AS n_distinct, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""",
)
def option_block_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options (links) read from pages in order; repeats show in the counts."""
    rows = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)).alias("l"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return rows.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), "title")


@query(
    "leakage_predicate",
    """SELECT b.item_id, count(d.doc_id)::bigint AS n_leaks, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""",
)
def leakage_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found word for word, as a whole, in documents.

    Only documents that share an item's first five whole words are searched, so the texts meet by an equi join; words at an item's ends may go on in a
    document and don't count as whole. Items of fewer whole words are searched in all documents.
    """
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    whole = F.regexp_replace("item", r"^\S*\s|\s\S*$", "")
    keys = items.select("item_id", "item", F.get(T.windows(whole, 5), F.lit(0)).alias("w"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    met = docs.select("doc_id", F.explode(F.array_distinct(T.windows(F.col("text"), 5))).alias("w")).join(keys.where("w IS NOT NULL"), "w").select("item_id", "item", "doc_id").distinct()
    held = F.contains(F.col("text"), F.col("item"))
    short = docs.join(F.broadcast(keys.where("w IS NULL").drop("w")), held).select("item_id", "doc_id")
    found = met.join(docs, "doc_id").where(held).select("item_id", "doc_id").unionByName(short)
    leaks = found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(leaks, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_leaks"), "first_doc")


@query("nfc_variants", "SELECT lang, count(*)::bigint AS n, count_if(nfc_normalize(text) <> text)::bigint AS n_changed FROM documents GROUP BY lang")
def nfc_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether composing changes a text. Spark has no function for it."""

    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and not unicodedata.is_normalized("NFC", t))

    rows = load(spark, sf_dir, "documents").select("lang", F.pandas_udf(changed, "boolean")("text").alias("changed"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


@query(
    "slug_digit_date_backoff",
    r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9._-]+', '-', 'g') AS slug, lpad(floor(p_retailprice * 100 + 0.5)::bigint::varchar, 8, '0') AS digits, least(60.0, 0.5 * power(2.0, p_partkey % 9)) AS backoff,
  list_transform([1, -1, 2, 10], lambda d: p_partkey + d) AS distractors FROM part""",
)
def slug_digit_date_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar forms of a part: slug, fixed-width digits, retry delay, numeric distractors."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").cast("string")
    near = F.transform(F.array(*[F.lit(d) for d in (1, -1, 2, 10)]), lambda d: F.col("p_partkey") + d)
    return load(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"), F.lpad(cents, 8, "0").alias("digits"), S.backoff(F.col("p_partkey") % 9, 0.5, 60.0).alias("backoff"), near.alias("distractors"))


@query("days_360_window", "SELECT o_orderstatus, o_orderkey, (year(o_orderdate) * 360 + month(o_orderdate) * 30 + day(o_orderdate))::bigint AS day FROM orders")
def days_360_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in months of thirty days."""
    return load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", S.days_360(F.col("o_orderdate")).cast("long").alias("day"))


@query(
    "json_extract",
    """SELECT event_type, count(*)::bigint AS n, count_if(json_extract_string(props, '$.k') IS NULL)::bigint AS n_missing, sum(json_extract_string(props, '$.k')::bigint)::bigint AS sum_k, max(json_extract_string(props, '$.k')::bigint) AS max_k FROM events GROUP BY 1""",
)
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON strings by a declared schema; what isn't there is counted."""
    rows = load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("n_missing"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


@query(
    "fingerprints",
    """SELECT o_custkey, sha256(string_agg(o_orderkey::varchar || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS plan, sha256(string_agg(o_orderstatus, '' ORDER BY o_orderkey)) AS order_signature, count(*)::bigint AS n FROM orders GROUP BY o_custkey""",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's plan by content, and by the order of its states alone."""
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    plan = F.array_join(F.transform("o", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ",")
    states = F.array_join(F.transform("o", lambda x: x["o_orderstatus"]), "")
    return rows.select("o_custkey", F.sha2(plan, 256).alias("plan"), F.sha2(states, 256).alias("order_signature"), F.size("o").cast("long").alias("n"))


@query(
    "field_strip_split",
    "SELECT md5(doc_id::varchar) AS key, md5(text) AS question, NULL::int AS gold FROM documents UNION ALL SELECT md5(doc_id::varchar), NULL, quality FROM labels",
)
def field_strip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all documents without answers, and answers without questions, under a shared key."""
    key = F.md5(F.col("doc_id").cast("string")).alias("key")
    asked = load(spark, sf_dir, "documents").select(key, F.md5("text").alias("question"))
    return asked.unionByName(load(spark, sf_dir, "labels").select(key, F.col("quality").alias("gold")), allowMissingColumns=True)


@query(
    "ordered_menus",
    """WITH s AS (SELECT p_brand, p_name, p_size, p_partkey, p_type LIKE '%STEEL%' AS is_tail FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY is_tail, p_size DESC, p_name, p_partkey) AS place,
  row_number() OVER (PARTITION BY p_brand ORDER BY md5('menu:' || p_partkey::varchar)) AS shuffled FROM s)
SELECT p_brand, p_partkey, place, shuffled FROM r WHERE place <= 8""",
)
def ordered_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's menu: by size, a fixed tail last, eight places; and where a seeded shuffle puts the same parts."""
    w = Window.partitionBy("p_brand")
    place = F.row_number().over(w.orderBy(F.col("p_type").like("%STEEL%"), F.desc("p_size"), "p_name", "p_partkey"))
    shuffled = F.row_number().over(w.orderBy(S.hash_order(F.lit("menu"), F.col("p_partkey"))))
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", place.cast("long").alias("place"), shuffled.cast("long").alias("shuffled")).where("place <= 8")


@query(
    "candidate_filter",
    r"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents), f AS (SELECT word, count(*)::bigint AS freq FROM w GROUP BY word)
SELECT word, freq FROM f WHERE word <> '' AND NOT regexp_matches(word, '[\x00-\x1F\x7F]') AND word NOT IN ('the', 'of', 'and')
  AND len(list_filter(range(1, length(word) // 3 + 1), lambda n: repeat(right(word, n), 3) = right(word, 3 * n))) = 0 ORDER BY freq DESC, word LIMIT 254""",
)
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that may be offered: no control characters, none banned, and none that ends in a unit three times over."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    fit = words.where((F.col("word") != "") & ~F.col("word").rlike(r"\p{Cntrl}") & ~F.col("word").isin("the", "of", "and"))
    again = F.exists(F.sequence(F.lit(1), F.floor(F.length("word") / 3).cast("int")), lambda n: F.repeat(F.right("word", n), F.lit(3)) == F.right("word", n * 3))
    return fit.where((F.length("word") < 3) | ~again).orderBy(F.desc("freq"), "word").limit(254)


@query(
    "payload_diff",
    """WITH p AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 0))) AS a, list_sort(list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 1))) AS b FROM events GROUP BY user_id)
SELECT user_id, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_a, list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS only_b, coalesce(a, []) = coalesce(b, []) AS same FROM p""",
)
def payload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of two payloads against each other."""
    e, even = F.col("event_type"), F.col("event_id") % 2 == 0
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(even, e))).alias("a"), F.sort_array(F.collect_set(F.when(~even, e))).alias("b"))
    return rows.select("user_id", F.sort_array(F.array_except("a", "b")).alias("only_a"), F.sort_array(F.array_except("b", "a")).alias("only_b"), (F.col("a") == F.col("b")).alias("same"))
