"""Where derived tables go."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside = threading.Lock(), []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/gaugeworks"


class Steps:
    """Tables of the steps of one run, in the shared folder: a cut of the lineage that survives executors. They are kept under the application's id."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{_own(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them again. The shuffle files that this took go when it is done."""
        with _cleaning(self.spark):
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which are all that a result reads."""
        self.drop(*(x for x in _names(self.spark, self.root) if x not in names))


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread is inside, and as it was after the last has left."""
    with _lock:
        if not _inside:
            _inside.append(spark.conf.get(CLEANUP, "false"))
            spark.conf.set(CLEANUP, "true")
        _inside.append("")
    try:
        yield
    finally:
        with _lock:
            _inside.pop()
            if len(_inside) == 1:
                spark.conf.set(CLEANUP, _inside.pop())


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of steps of this application, once no result that reads them is needed."""
    delete(spark, _own(spark))


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
