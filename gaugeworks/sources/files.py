"""File sources and sinks of ledgers: JSON lines, documents, CSV, archives, checked and write-once files."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from gaugeworks.sources.folders import Steps


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped, a bad line or a missing file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The lines that can be read, and one row with the number (n_bad) of those that can't."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return parsed.where("_bad IS NULL").drop("_bad"), parsed.agg(F.count("_bad").alias("n_bad"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, keys: list[str], order: str | None = None) -> tuple[int, int]:
    """Append rows whose key is new to the ledger; (appended, refused). Of repeats among the rows the first is taken: by the column ``order``, or as they are read."""
    spark = rows.sparkSession
    numbered = rows.withColumn("__at", F.monotonically_increasing_id())
    first = Window.partitionBy(*keys).orderBy(*([F.col(order)] if order else []), "__at")
    once = numbered.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__at", "__rank")
    new = once.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if _exists(spark, path) else once
    # Written aside first, so that what is counted is what is appended.
    staged = Steps(spark, "append").save(new.select(*rows.columns), "rows")
    n = staged.count()
    staged.write.mode("append").parquet(path)
    return n, rows.count() - n


def write_once(rows: DataFrame, path: str) -> int:
    """Write (key, content) once: the same again is nothing new; other content under a known key, or two contents under one key, are an error, and nothing is written.
    Returns how many were written."""
    spark = rows.sparkSession
    hashed = rows.select("key", "content", F.sha2("content", 256).alias("sha256"))
    once = hashed.groupBy("key").agg(F.min_by("content", "sha256").alias("content"), F.min("sha256").alias("sha256"), F.max("sha256").alias("__other"))
    if _exists(spark, path):
        once = once.join(spark.read.parquet(path).select("key", F.col("sha256").alias("__known")).distinct(), "key", "left")
    else:
        once = once.withColumn("__known", F.lit(None).cast("string"))
    met = Steps(spark, "write-once").save(once, "rows")
    if met.where("sha256 <> __other").limit(1).count():
        raise ValueError("one key comes with two contents")
    if met.where("__known <> sha256").limit(1).count():
        raise ValueError(f"content differs from what {path} holds")
    new = met.where("__known IS NULL").select("key", "content", "sha256")
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def csv_with_reasons(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV rows that have every required field, and counts of rows by the reason that keeps them out."""
    rows = spark.read.csv(path, header=True, multiLine=True)
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required], F.lit("admitted"))
    judged = rows.withColumn("reason", reason)
    return judged.where("reason = 'admitted'").drop("reason"), judged.groupBy("reason").agg(F.count("*").alias("n"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON value."""
    return spark.read.option("multiLine", True).json(path)


def tar_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(member, body, problem) of the JSON members of archives, each archive in one task. Names that leave the archive are refused."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    for m in t:
                        if not m.isfile() or not m.name.endswith(".json"):
                            continue
                        if m.name.startswith("/") or ".." in m.name.split("/"):
                            rows.append((m.name, None, "unsafe name"))
                            continue
                        body = t.extractfile(m).read().decode("utf-8", "replace")
                        try:
                            json.loads(body)
                        except ValueError:
                            rows.append((m.name, body, "not JSON"))
                        else:
                            rows.append((m.name, body, None))
                yield pd.DataFrame(rows, columns=["member", "body", "problem"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "member string, body string, problem string")


def verified(spark: SparkSession, glob: str, wanted: DataFrame) -> DataFrame:
    """(name, state) of wanted(name, sha256): ok, changed or missing."""
    found = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return wanted.join(found, "name", "left").select("name", state.alias("state"))


def exactly_one(spark: SparkSession, glob: str) -> str:
    """The one file that a pattern finds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    if len(found) != 1:
        raise ValueError(f"{len(found)} files match {glob}")
    return found[0].getPath().toString()


def strict_json(rows: DataFrame) -> DataFrame:
    """One column json of standard JSON: numbers that JSON has no form for become the strings NaN, Infinity and -Infinity."""
    columns = []
    for f in StructType(rows.schema.fields):
        c = F.col(f.name)
        if isinstance(f.dataType, DoubleType | FloatType):
            odd = F.isnan(c) | (F.abs(c) == float("inf"))
            name = F.when(F.isnan(c), "NaN").when(c > 0, "Infinity").otherwise("-Infinity")
            shown = F.when(c.isNull(), "null").when(odd, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(c.cast("string"))
            columns.append(F.concat(F.lit(json.dumps(f.name) + ":"), shown))
        else:
            columns.append(F.regexp_replace(F.to_json(F.struct(c.alias(f.name)), {"ignoreNullFields": "false"}), r"^\{|\}$", ""))
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *columns), F.lit("}")).alias("json"))


def replayed(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the stored response of their hash, where there is one."""
    hashed = asked.withColumn("request_sha256", F.sha2("request", 256))
    return hashed.join(cache, "request_sha256", "left").withColumn("replayed", F.col("response").isNotNull())


def derived_set(tables: dict[str, DataFrame], run: str) -> dict[str, DataFrame]:
    """The derived tables of a run, each written once under run/derived and read back; a run that has one already is an error and keeps it."""
    found = {}
    for name, rows in tables.items():
        path = f"{run}/derived/{name}"
        rows.write.mode("error").parquet(path)
        found[name] = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return found


def markdown(rows: DataFrame) -> DataFrame:
    """(place, line): a table as Markdown: the head, the rule, and a line for each row, in order of place. Bars in values are escaped, line breaks become blanks, nulls are empty."""
    shown = [F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "), F.lit("")) for c in rows.columns]
    body = rows.select((F.monotonically_increasing_id() + 2).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))]
    return rows.sparkSession.createDataFrame(head, "place bigint, line string").unionByName(body)
