"""Regressions, holdouts and residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import regression
from gaugeworks.plans.registry import query
from gaugeworks.tables import load


@query(
    "ols_simple",
    """SELECT l_returnflag, count(*)::bigint AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2,
  round(corr(l_extendedprice, l_quantity), 9) AS pearson FROM lineitem GROUP BY 1""",
)
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity by flag."""
    fit = regression.simple("l_quantity", "l_extendedprice")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(fit["slope"], 6).alias("slope"), F.round(fit["intercept"], 6).alias("intercept"), F.round(fit["r2"], 9).alias("r2"), F.round(F.corr("l_extendedprice", "l_quantity"), 9).alias("pearson")
    )


@query(
    "ols_holdout",
    """WITH f AS (SELECT l_linestatus, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS m FROM lineitem WHERE l_orderkey % 4 <> 3 GROUP BY 1)
SELECT l_linestatus, count(*)::bigint AS n, round(avg(abs(l_extendedprice - (a + b * l_quantity))), 4) AS mae, round(avg(abs(l_extendedprice - m)), 4) AS naive_mae, round(sqrt(avg(power(l_extendedprice - (a + b * l_quantity), 2))), 4) AS rmse
FROM lineitem JOIN f USING (l_linestatus) WHERE l_orderkey % 4 = 3 GROUP BY 1""",
)
def ols_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on three quarters of the orders, errors on the rest, against the mean as a baseline. Fits are one row per status."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity", "l_extendedprice")
    fit = regression.simple("l_quantity", "l_extendedprice")
    fits = rows.where("l_orderkey % 4 <> 3").groupBy("l_linestatus").agg(fit["slope"].alias("b"), fit["intercept"].alias("a"), F.avg("l_extendedprice").alias("m"))
    y = F.col("l_extendedprice")
    off = y - (F.col("a") + F.col("b") * F.col("l_quantity"))
    return rows.where("l_orderkey % 4 = 3").join(fits, "l_linestatus").groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(off)), 4).alias("mae"), F.round(F.avg(F.abs(y - F.col("m"))), 4).alias("naive_mae"), F.round(F.sqrt(F.avg(F.pow(off, 2))), 4).alias("rmse")
    )


@query(
    "loo_residuals",
    """WITH t AS (SELECT p_brand, p_partkey, p_retailprice, sum(p_retailprice) OVER (PARTITION BY p_brand) AS s, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, round(p_retailprice - (s - p_retailprice) / (n - 1), 6) AS residual FROM t WHERE n > 1""",
)
def loo_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the mean of the others of its brand, from the total less its own."""
    w = Window.partitionBy("p_brand")
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.sum("p_retailprice").over(w).alias("s"), F.count("*").over(w).alias("n")).where("n > 1")
    return rows.select("p_brand", "p_partkey", F.round(F.col("p_retailprice") - (F.col("s") - F.col("p_retailprice")) / (F.col("n") - 1), 6).alias("residual"))


@query(
    "block_dummy_fit",
    """WITH d AS (SELECT l_returnflag, l_quantity - avg(l_quantity) OVER w AS x, l_extendedprice - avg(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_linenumber))
SELECT l_returnflag, count(*)::bigint AS n, round(sum(x * y) / sum(x * x), 6) AS slope, round(sqrt(avg(power(y - x * (SELECT sum(x * y) / sum(x * x) FROM d), 2))), 4) AS pooled_rmse FROM d GROUP BY 1""",
)
def block_dummy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes after taking out line-number blocks; block means are a small aggregate that is joined back."""
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    means = rows.groupBy("l_linenumber").agg(F.avg("l_quantity").alias("mx"), F.avg("l_extendedprice").alias("my"))
    d = rows.join(means, "l_linenumber").select("l_returnflag", (F.col("l_quantity") - F.col("mx")).alias("x"), (F.col("l_extendedprice") - F.col("my")).alias("y"))
    xy, xx, yy = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    sums = d.groupBy("l_returnflag").agg(F.count("*").alias("n"), xy.alias("xy"), xx.alias("xx"), yy.alias("yy"))
    pooled = F.broadcast(sums.agg((F.sum("xy") / F.sum("xx")).alias("b")))
    b = F.col("b")
    rmse = F.sqrt((F.col("yy") - 2 * b * F.col("xy") + b * b * F.col("xx")) / F.col("n"))
    return sums.join(pooled, F.lit(True)).select("l_returnflag", "n", F.round(F.col("xy") / F.col("xx"), 6).alias("slope"), F.round(rmse, 4).alias("pooled_rmse"))


@query(
    "quadratic_fit",
    """WITH r AS (SELECT l_linenumber, l_quantity AS a, l_quantity * l_quantity AS b, l_extendedprice AS y FROM lineitem),
s AS (SELECT l_linenumber, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bby FROM r GROUP BY 1)
SELECT l_linenumber, n::bigint AS n, round((ay * bb - bby * ab) / (aa * bb - ab * ab), 3) AS beta_a, round((bby * aa - ay * ab) / (aa * bb - ab * ab), 4) AS beta_b FROM s""",
)
def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity and its square."""
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") * F.col("l_quantity")).alias("b"), F.col("l_extendedprice").alias("y"))
    fit = regression.two_features(rows, ["l_linenumber"], "a", "b", "y")
    return fit.select("l_linenumber", "n", F.round("beta_a", 3).alias("beta_a"), F.round("beta_b", 4).alias("beta_b"))


@query(
    "local_slope",
    """WITH m AS (SELECT p_brand, min(p_retailprice) AS lo FROM part GROUP BY 1)
SELECT p_brand, count(*)::bigint AS n, round(regr_slope(p_size, p_retailprice), 9) AS slope FROM part JOIN m USING (p_brand) WHERE p_retailprice <= 1.5 * lo GROUP BY 1""",
)
def local_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope near the cheapest part of each brand."""
    parts = load(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    low = parts.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"))
    near = parts.join(low, "p_brand").where("p_retailprice <= 1.5 * lo")
    return near.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.regr_slope("p_size", "p_retailprice"), 9).alias("slope"))


@query(
    "group_holdout_contest",
    """WITH s AS (SELECT p_brand, count(*) AS n, sum(p_size) AS sx, sum(p_partkey % 50) AS sz, sum(p_retailprice) AS sy, sum(p_size * p_size) AS xx, sum((p_partkey % 50) * (p_partkey % 50)) AS zz, sum(p_size * p_retailprice) AS xy, sum((p_partkey % 50) * p_retailprice) AS zy FROM part GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sz) AS sz, sum(sy) AS sy, sum(xx) AS xx, sum(zz) AS zz, sum(xy) AS xy, sum(zy) AS zy FROM s),
f AS (SELECT s.p_brand, ((t.n - s.n) * (t.xy - s.xy) - (t.sx - s.sx) * (t.sy - s.sy)) / ((t.n - s.n) * (t.xx - s.xx) - (t.sx - s.sx) * (t.sx - s.sx))::double AS bx, ((t.n - s.n) * (t.zy - s.zy) - (t.sz - s.sz) * (t.sy - s.sy)) / ((t.n - s.n) * (t.zz - s.zz) - (t.sz - s.sz) * (t.sz - s.sz))::double AS bz,
  (t.sy - s.sy) / (t.n - s.n) AS my, (t.sx - s.sx) / (t.n - s.n)::double AS mx, (t.sz - s.sz) / (t.n - s.n)::double AS mz FROM s CROSS JOIN t)
SELECT p_brand, round(sqrt(avg(power(p_retailprice - my - bx * (p_size - mx), 2))), 3) AS rmse_size, round(sqrt(avg(power(p_retailprice - my - bz * (p_partkey % 50 - mz), 2))), 3) AS rmse_key FROM part JOIN f USING (p_brand) GROUP BY 1""",
)
def group_holdout_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors, each fitted on all other brands (from totals less a brand's own sums), contested on the one left out."""
    parts = load(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("z"), F.col("p_retailprice").alias("y"))
    c = F.col
    terms = {"n": F.lit(1.0), "sx": c("x"), "sz": c("z"), "sy": c("y"), "xx": c("x") * c("x"), "zz": c("z") * c("z"), "xy": c("x") * c("y"), "zy": c("z") * c("y")}
    own = parts.groupBy("p_brand").agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    whole = F.broadcast(own.agg(*[F.sum(k).alias(f"t_{k}") for k in terms]))
    rest = own.join(whole, F.lit(True)).select("p_brand", *[(c(f"t_{k}") - c(k)).alias(k) for k in terms])
    slope = lambda s, q, w: (c("n") * c(w) - c(s) * c("sy")) / (c("n") * c(q) - c(s) * c(s))
    fits = rest.select("p_brand", slope("sx", "xx", "xy").alias("bx"), slope("sz", "zz", "zy").alias("bz"), (c("sy") / c("n")).alias("my"), (c("sx") / c("n")).alias("mx"), (c("sz") / c("n")).alias("mz"))
    err = lambda b, v, m: F.round(F.sqrt(F.avg(F.pow(c("y") - c("my") - c(b) * (c(v) - c(m)), 2))), 3)
    return parts.join(fits, "p_brand").groupBy("p_brand").agg(err("bx", "x", "mx").alias("rmse_size"), err("bz", "z", "mz").alias("rmse_key"))


@query(
    "affine_worst_residuals",
    """WITH f AS (SELECT regr_slope(n_chars, length(text) - length(replace(text, ' ', ''))) AS b, regr_intercept(n_chars, length(text) - length(replace(text, ' ', ''))) AS a, lang FROM documents GROUP BY lang),
r AS (SELECT lang, doc_id, n_chars - (a + b * (length(text) - length(replace(text, ' ', '')))) AS e FROM documents JOIN f USING (lang))
SELECT lang, doc_id, round(e, 4) AS residual, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(abs(e), 4) DESC, doc_id) AS rank FROM r) WHERE rank <= 5""",
)
def affine_worst_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters on spaces by language, with the five worst fits of each."""
    rows = load(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("x"))
    fit = regression.simple("x", "n_chars")
    fits = rows.groupBy("lang").agg(fit["slope"].alias("b"), fit["intercept"].alias("a"))
    e = F.col("n_chars") - (F.col("a") + F.col("b") * F.col("x"))
    w = Window.partitionBy("lang").orderBy(F.desc(F.round(F.abs(F.col("e")), 4)), "doc_id")
    ranked = rows.join(fits, "lang").select("lang", "doc_id", e.alias("e")).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
    return ranked.select("lang", "doc_id", F.round("e", 4).alias("residual"), "rank")


@query(
    "token_rates",
    """SELECT lang, count(*)::bigint AS n, round(sum(strlen(text))::double / sum(length(text)), 9) AS bytes_per_char, round(sum(length(text))::double / sum(len(string_split(text, ' '))), 9) AS chars_per_word,
  round(regr_slope(strlen(text), length(text)), 9) AS slope, sum(length(text) + 1)::bigint AS conservative_tokens FROM documents GROUP BY lang""",
)
def token_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, characters and words against each other."""
    rows = load(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("b"), F.length("text").alias("c"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("w"))
    total = lambda k: F.sum(F.col(k))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(S.ratio(total("b"), total("c")), 9).alias("bytes_per_char"), F.round(S.ratio(total("c"), total("w")), 9).alias("chars_per_word"),
        F.round(F.regr_slope("b", "c"), 9).alias("slope"), F.sum(F.col("c").cast("long") + 1).alias("conservative_tokens"),
    )
