"""Ledgers as streams: refusal of repeats, hourly counts and budgets, each run until what is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.sources.files import append_new
from gaugeworks.sources.folders import shared_folder


def _events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream, with ts as an instant."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # A stream reads folders: one that is a single file is found by its name.
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")) if _single(spark, path) else (
        spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    )


def _single(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _settled(rows: DataFrame, mode: str, name: str) -> DataFrame:
    """Run the stream to its end and read what its sink holds. The checkpoint lies in the shared folder."""
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:
        # Each run of a batch writes its own folder; the last holds the whole result.
        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/rows")

        q = rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def appended(rows: DataFrame, keys: list[str], root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The ledger that a stream is appended to, and how many rows each batch (batch, n_appended, n_refused) brought; run until what is there has been read.

    A key that the ledger holds is refused for good, however long ago it came: the ledger itself is what is remembered, not the stream's state. A batch that is run again
    finds its own rows there, so nothing is appended twice."""
    spark = rows.sparkSession
    root = root or f"{shared_folder(spark)}/streams/ledger-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        counts = append_new(batch, f"{root}/rows", keys)
        batch.sparkSession.createDataFrame([(n, *counts)], "batch bigint, n_appended bigint, n_refused bigint").write.mode("append").parquet(f"{root}/counts")

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows"), spark.read.parquet(f"{root}/counts")


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """Every event id once, though the stream holds each twice."""
    once = _events(spark, path)
    return appended(once.unionByName(once), ["event_id"])[0]


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """start, event_type, n, total of hours."""
    w = F.window("ts", "1 hour")
    counts = _events(spark, path).withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _settled(counts.select(F.col("window.start").alias("start"), "event_type", "n", "total"), "complete", "hourly")


def budgets(spark: SparkSession, path: str, most: float) -> DataFrame:
    """user_id, n, reserved, exhausted: running reservations as the stream's state."""
    held = _events(spark, path).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("reserved"))
    return _settled(held.withColumn("exhausted", F.col("reserved") > most), "complete", "budgets")


BUDGET = "owner bigint, n_requests bigint, n_denied bigint, n_unknown bigint, n_open bigint, billed double, reserved double"
_BUDGET_STATE = "n_requests bigint, n_denied bigint, n_unknown bigint, billed double, reserved double, tickets array<bigint>, amounts array<double>"


def settled(owner: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, most: float, most_requests: int | None) -> Iterator[pd.DataFrame]:
    """An owner's operations (seq, op, ticket, amount) in order of seq, upon what the state holds of earlier batches.

    A reservation is refused if what is billed and reserved would pass ``most`` with it, or requests their number. Release undoes an open one. Reconcile puts the
    reported amount in its place; without a report the estimate stays reserved for ever. Operations on tickets that aren't open change nothing."""
    n, denied, unknown, billed, reserved, tickets, amounts = state.get if state.exists else (0, 0, 0, 0.0, 0.0, [], [])
    held = dict(zip(tickets, amounts, strict=True))
    for op, ticket, amount in pd.concat(list(chunks)).sort_values("seq", kind="stable")[["op", "ticket", "amount"]].itertuples(index=False):
        if op == "reserve":
            if ticket in held or billed + reserved + amount > most or most_requests is not None and n + 1 > most_requests:
                denied += 1
                continue
            held[ticket] = amount
            n, reserved = n + 1, reserved + amount
        elif ticket in held:
            estimate = held.pop(ticket)
            if op == "release":
                n, reserved = n - 1, max(0.0, reserved - estimate)
            elif pd.isna(amount):
                unknown += 1
            else:
                billed, reserved = billed + amount, max(0.0, reserved - estimate)
    state.update((n, denied, unknown, billed, reserved, list(held), list(held.values())))
    yield pd.DataFrame([(owner[0], n, denied, unknown, len(held), billed, reserved)], columns=["owner", "n_requests", "n_denied", "n_unknown", "n_open", "billed", "reserved"])


def budget_ledger(ops: DataFrame, most: float = float("inf"), most_requests: int | None = None, root: str | None = None) -> DataFrame:
    """Budgets by owner from a stream of ops(owner, seq, op, ticket, amount), run until what is there has been read.

    What is held is the stream's state, in the checkpoint under root: a run over the same root goes on where the last one ended. An owner's operations must
    come in batches in order of seq; within a batch they are sorted."""
    spark = ops.sparkSession
    root = root or f"{shared_folder(spark)}/streams/budget-{uuid.uuid4().hex}"
    ops = ops.select("owner", "seq", "op", "ticket", "amount")
    rows = ops.groupBy("owner").applyInPandasWithState(lambda k, c, s: settled(k, c, s, most, most_requests), BUDGET, _BUDGET_STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, n: int) -> None:
        # A batch that is run again overwrites its own rows.
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")

    q = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    each = spark.read.schema(f"{BUDGET}, batch int").option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    last = [F.max_by(c, "batch").alias(c) for c in each.columns if c not in ("owner", "batch")]
    return each.groupBy("owner").agg(*last)


def budget_operations(events: DataFrame) -> DataFrame:
    """Events as operations: each reserves its value; views and purchases report four fifths and all of it, errors report nothing, clicks are released, the rest stay open."""
    value, kind = F.col("value"), F.col("event_type")
    then = F.when(kind == "view", F.struct(F.lit("reconcile").alias("op"), (value * 0.8).alias("amount"))).when(
        kind == "purchase", F.struct(F.lit("reconcile").alias("op"), value.alias("amount"))
    ).when(kind == "error", F.struct(F.lit("reconcile").alias("op"), F.lit(None).cast("double").alias("amount"))).when(
        kind == "click", F.struct(F.lit("release").alias("op"), F.lit(None).cast("double").alias("amount"))
    )
    both = F.filter(F.array(F.struct(F.lit("reserve").alias("op"), value.alias("amount")), then), lambda x: x.isNotNull())
    each = events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("ticket"), F.posexplode(both).alias("k", "x"))
    return each.select("owner", (F.col("ticket") * 2 + F.col("k")).alias("seq"), "x.op", "ticket", "x.amount")


def event_budgets(spark: SparkSession, path: str) -> DataFrame:
    """Budgets of users over the events."""
    return budget_ledger(budget_operations(_events(spark, path)))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(message): each event as the lines of a server-sent message, written by a stream as they come."""
    line = F.concat(F.lit("id: "), "event_id", F.lit("\nevent: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct("user_id")))
    return _settled(_events(spark, path).select(line.alias("message")), "append", "messages")
