"""The stored tables of a corpus.

Every table is parquet below one root, partitioned by ``client_id`` and ``run_id``. A run
writes only its own partitions, so repeating a failed run replaces what it wrote and touches nothing else. Run ids
sort by time: the current version of a document is the one of its latest run.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import WIDE_ROWS, release, remove, scratch_path, stage

PARTITIONS = ("client_id", "run_id", "is_native", "version")
DOCUMENT_KEY = ["client_id", "rel_path"]

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

# Several runs may write at a time, each from a thread of its own. What they set in the session they share holds until the
# last of them is done; rows are appended by one at a time, as its commit clears the folder that others would write in.
_LOCK, _APPENDING = threading.Lock(), threading.Lock()
_WRITING: WeakKeyDictionary = WeakKeyDictionary()

# Tables that hold rows of documents, and change when one is deleted.
DOCUMENT_TABLES = ("raw_files", "raw_parts", "documents", "document_lines", "chunks", "vectors", "document_meta")

# What a later embedding of a chunk puts in place of the stored one, by table.
CHUNK_KEY = [*DOCUMENT_KEY, "run_id", "chunk_id"]
RENEWABLE = {"chunks": ("embedding", "model"), "vectors": ("embedding",)}
RENEWED = "renewed"
_RENEWED = "rel_path string, chunk_id string, embedding array<float>, model string, client_id string, run_id string, version string"


@contextmanager
def _open_writers(spark: SparkSession):
    """The session with a few open files per task, for as long as any thread writes."""
    with _LOCK:
        count, kept = _WRITING.get(spark, (0, None))
        if not count:
            kept = spark.conf.get(_WRITERS)
            spark.conf.set(_WRITERS, "8")
        _WRITING[spark] = count + 1, kept
    try:
        yield
    finally:
        with _LOCK:
            count, kept = _WRITING[spark]
            _WRITING[spark] = count - 1, kept
            if count == 1:
                spark.conf.set(_WRITERS, kept)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def exists(self, table: str) -> bool:
        """Whether the table has rows: writing none makes a folder without partitions."""
        return self._has_folders(self.path(table))

    def run_exists(self, table: str, client_id: str, run_id: str) -> bool:
        path = self._jpath(self._run_path(table, client_id, run_id))
        return path.getFileSystem(self._hadoop()).exists(path)

    def read(self, table: str) -> DataFrame:
        """The table, with its partition values as the strings they were written as: a client may be named 007."""
        return self._load(table, self.path(table))

    def read_run(self, table: str, client_id: str, run_id: str) -> DataFrame:
        """The rows of one run. Only its own folder is listed, however many runs there are."""
        return self._load(table, self._run_path(table, client_id, run_id))

    def read_client(self, table: str, client_id: str) -> DataFrame | None:
        """The rows of one client, whose own folder is all that is listed; nothing where it has none."""
        path = f"{self.path(table)}/{self._folder({'client_id': client_id})}"
        return self._load(table, path) if self._has_folders(path) else None

    def _load(self, table: str, path: str) -> DataFrame:
        reader = self.spark.read.option("basePath", self.path(table))
        fields = [
            T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in reader.parquet(path).schema
        ]
        return reader.schema(T.StructType(fields)).parquet(path)

    def _run_path(self, table: str, client_id: str, run_id: str) -> str:
        return f"{self.path(table)}/{self._folder({'client_id': client_id, 'run_id': run_id})}"

    def _folder(self, values: dict[str, str]) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{name}={escape(value)}" for name, value in values.items())

    def _jpath(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _hadoop(self):
        return self.spark._jsc.hadoopConfiguration()

    def _has_folders(self, folder: str) -> bool:
        path = self._jpath(folder)
        fs = path.getFileSystem(self._hadoop())
        return fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path))

    def write(self, table: str, rows: DataFrame, partitions: tuple[str, ...] = ("client_id", "run_id")) -> None:
        """Replaces the partitions that ``rows`` falls into; others stay.

        A run writes a handful of partitions, so that each can have its open file, and rows that may hold whole files
        need not be sorted by partition first.
        """
        with _open_writers(self.spark):
            (
                rows.write.mode("overwrite")
                .options(partitionOverwriteMode="dynamic", **WIDE_ROWS)
                .partitionBy(*partitions)
                .parquet(self.path(table))
            )

    def drop_run(self, table: str, client_id: str, run_id: str) -> None:
        """Removes what a run has written to a table, if anything."""
        self.remove(self._run_path(table, client_id, run_id))

    def append(self, table: str, rows: DataFrame) -> None:
        with _APPENDING:
            rows.write.mode("append").parquet(self.path(table))

    def current(self, table: str) -> DataFrame:
        """Rows of finished runs that no later run of their document supersedes and that have not been deleted, with their
        newest vectors.

        The run list is short and prunes partitions. What is superseded is worked out on ``documents``, where every file
        of a run has a row, with text or without: a file that turned blank leaves nothing current. Those rows are small
        and few unless much was ingested again; either way the table itself need not move.
        """
        finished = self.read("runs").select("client_id", "run_id")
        seen = self.read("documents").select(*DOCUMENT_KEY, "run_id").join(finished, ["client_id", "run_id"], "left_semi")
        latest = seen.groupBy(*DOCUMENT_KEY).agg(F.max("run_id").alias("_latest"), F.count("*").alias("_runs"))
        old = seen.join(latest.filter("_runs > 1"), DOCUMENT_KEY).filter("run_id < _latest")
        gone = old.select(*DOCUMENT_KEY, "run_id")
        deleted = self.deleted().select(*DOCUMENT_KEY, F.col("deleted_run").alias("run_id"))
        # Stored, so that the optimizer sees how few they are: a join by version would put a whole file in one task.
        gone = stage(scratch_path(self.spark, "gone"), gone.union(deleted).distinct())
        rows = (
            self.read(table)
            .join(finished, ["client_id", "run_id"], "left_semi")
            .join(gone, [*DOCUMENT_KEY, "run_id"], "left_anti")
        )
        return self.renewed(table, rows)

    def renewed(self, table: str, rows: DataFrame, touched: DataFrame | None = None) -> DataFrame:
        """``rows`` of ``table`` with the vectors that later embeddings have put in place of the stored ones.

        Those lie in a table of their own, a row per chunk embedded again; the newest version of a chunk holds. Few of
        them travel to the rows; many are joined, until ``compact`` has folded them in. ``touched`` names the versions of
        documents that have such vectors, where these are few: rows of others then stay where they are.
        """
        fields = RENEWABLE.get(table, ())
        if not fields or not self.exists(RENEWED):
            return rows
        newest = self.renewals().groupBy(*CHUNK_KEY).agg(F.max(F.struct("version", *fields)).alias("_new"))
        shown = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
        if touched is None:
            return rows.join(newest, CHUNK_KEY, "left").select(*shown)
        version = [*DOCUMENT_KEY, "run_id"]
        met = rows.join(touched, version, "left_semi").join(newest, CHUNK_KEY, "left").select(*shown)
        return met.unionByName(rows.join(touched, version, "left_anti"))

    def deleted(self) -> DataFrame:
        """Versions of documents that have been deleted and not yet compacted away; none where nothing ever was."""
        schema = "rel_path string, deleted_run string, client_id string, run_id string"
        path = self.path("deleted")
        if not self.exists("deleted"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def renewals(self) -> DataFrame:
        """The vectors that later embeddings have made and that have not been folded in yet, by version."""
        path = self.path(RENEWED)
        return self.spark.read.schema(_RENEWED).option("basePath", path).parquet(path)

    def rewrite(self, table: str, affected: DataFrame, kept: DataFrame, partitions: tuple[str, ...]) -> None:
        """Puts ``kept`` in place of the partitions listed in ``affected``; those left without rows are removed.

        Both may read the table they change: the partitions to remove are worked out before, and a write puts its files in
        their places only when all rows have been read.
        """
        names = scratch_path(self.spark, f"affected-{table}")
        left = kept.select(*partitions).distinct()
        emptied = stage(names, affected.select(*partitions).distinct().join(left, list(partitions), "left_anti"))
        self.write(table, kept, partitions)
        self.drop_partitions(table, emptied)
        self.remove(names)
        release(self.spark)

    def remove(self, path: str) -> None:
        remove(self.spark, path)

    def drop_partitions(self, table: str, listed: DataFrame) -> None:
        """Removes the folders of the partitions in ``listed``, a row for each."""
        for row in listed.toLocalIterator():
            path = self._jpath(f"{self.path(table)}/{self._folder(row.asDict())}")
            path.getFileSystem(self._hadoop()).delete(path, True)
