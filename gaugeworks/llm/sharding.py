"""Sharding [native]: size-tiered compaction with versioned manifests.

A store is a folder of immutable shards (Parquet files) and of manifests, one folder per version, that list the live
shards. ``append`` writes arrivals as small shards; ``compact`` merges shards of like size, tier by tier, into files of about the
target size: a tier holds sizes within a factor of ``fanout``, and one with ``fanout`` shards or more is merged.
Merging moves no row between tasks: whole shards are read side by side and written as one file, so it costs no shuffle and
a hot source or key can't skew it. Shards of half the target or more are finished and are never rewritten.

Every change ends with a commit: the manifest of the next version is written beside the others and renamed to
its number, which fails if another writer has taken it; an append then lists its shards upon that writer's version and tries again, a compaction leaves
its tiers for the next. Until then readers see the old version whole; a lost executor or
driver leaves at most unlisted files, which ``vacuum`` deletes once they are older than a writer may take (``grace``).

Rows are kept as they are: nulls, empty and long texts, repeated rows and extra columns. An empty table
gives a version with no shards, and reads as no rows of its schema.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.llm.common import Scratch

MANIFEST = "path string, bytes bigint, n_rows bigint, tier int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 128 << 20, fanout: int = 4) -> None:
        self.spark, self.root, self.schema, self.target, self.fanout = spark, root, schema, target_bytes, fanout
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        top = self._path(f"{self.root}/manifests")
        if not self._fs.exists(top):
            return []
        return sorted(int(n[1:]) for s in self._fs.listStatus(top) if (n := s.getPath().getName()).startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, by default the last."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version if version is not None else found[-1]:08d}")

    def commit(self, base: int, shards: DataFrame) -> int:
        """Make shards the version after base; fails if that one exists."""
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        # The context's rename is atomic and, without an option to overwrite, refuses a target that exists.
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        context.rename(self._path(staged), self._path(f"{self.root}/manifests/v{base + 1:08d}"), options)
        return base + 1

    def _listed(self, folder: str) -> DataFrame:
        """Manifest rows of the files in a folder just written; sizes and counts are partial aggregates."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")
        found = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("n_rows"))
        return found.select(F.concat(F.lit(f"{folder}/"), F.element_at(F.split("path", "/"), -1)).alias("path"), "bytes", "n_rows", self._tier(F.col("bytes")))

    def _tier(self, size):
        """0 for finished shards, else how many times the fanout fits between the shard and the target, from 1."""
        steps = F.ceil(F.log(float(self.fanout), self.target / size.cast("double")))
        return F.when(size >= self.target / 2, 0).otherwise(F.greatest(F.lit(1), steps)).cast("int").alias("tier")

    def append(self, rows: DataFrame) -> int:
        """Write arrivals as small shards and commit them, upon whatever version is the last by then."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        listed = Scratch(self.spark, "listed").save(self._listed(folder), "shards")
        while True:
            base = (self.versions() or [0])[-1]
            try:
                return self.commit(base, (self.manifest(base) if base else self.manifest()).unionByName(listed))
            except Exception:
                if (self.versions() or [0])[-1] == base:  # no other writer was first: another fault
                    raise

    def compact(self) -> int:
        """Merge each tier that holds enough shards, side by side; one commit for all tiers. Returns the last version."""
        base = (self.versions() or [0])[-1]
        live = self.manifest()
        tiers = live.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).collect()
        if not tiers:
            return base

        def merge(t) -> str:
            folder = f"data/{uuid.uuid4().hex}"
            # Driver-side work is by shard, as in Spark's own listing of files: the manifest, never rows.
            paths = [f"{self.root}/{r['path']}" for r in live.where(F.col("tier") == t["tier"]).orderBy("path").toLocalIterator()]
            files = max(1, round(t["bytes"] / self.target))
            self.spark.read.schema(self.schema).parquet(*paths).coalesce(files).write.parquet(f"{self.root}/{folder}")
            return folder

        with ThreadPoolExecutor(len(tiers)) as pool:
            folders = list(pool.map(merge, tiers))
        rest = live.where(~F.col("tier").isin([t["tier"] for t in tiers]))
        for folder in folders:
            rest = rest.unionByName(self._listed(folder))
        try:
            return self.commit(base, rest)
        except Exception:
            last = self.versions()[-1]
            if last == base:
                raise
            return last

    def vacuum(self, grace: float = 86_400.0) -> None:
        """Delete data folders that the last version doesn't name and that are older than so many seconds, and older manifests. For when no reader holds an older version.

        A writer has its folder before it commits, so grace must be longer than an append or a compaction takes; 0 is for a store that no one else writes to."""
        found = self.versions()
        before = (time.time() - grace) * 1000
        named = {r["f"] for r in self.manifest().select(F.element_at(F.split("path", "/"), 2).alias("f")).distinct().toLocalIterator()}
        for s in self._fs.listStatus(self._path(f"{self.root}/data")):
            if s.getPath().getName() not in named and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), True)
        for v in found[:-1]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, through its manifest."""
        paths = [f"{self.root}/{r['path']}" for r in self.manifest(version).toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


def arrivals(docs: DataFrame, waves: int) -> list[DataFrame]:
    """The rows in waves of falling size: each document arrives once, by its hash."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**waves - 1)) + 1
    return [docs.where((share >= 2**k) & (share < 2 ** (k + 1))) for k in reversed(range(waves))]


def shard(spark: SparkSession, docs: DataFrame, waves: int = 3, target_bytes: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """Append the waves one after another, compacting after each."""
    store = ShardStore(spark, Scratch(spark, "shards").root, docs.schema, target_bytes, fanout)
    for wave in arrivals(docs, waves):
        store.append(wave)
        store.compact()
        store.vacuum(grace=0)  # the store is this run's own
    return store


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row as read back through the last manifest: doc_id, lang, source, n_chars, text_sha256."""
    rows = shard(spark, docs).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
