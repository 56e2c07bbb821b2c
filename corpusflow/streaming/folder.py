"""Ingestion of files as they arrive in a folder, or change in it."""

from __future__ import annotations

from dataclasses import replace
from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.plans.ingest import Run, ingest_files, largest_file
from corpusflow.plans.store import Store
from corpusflow.session import truncate_lineage
from corpusflow.sources.files import (
    FOLDER_EXTENSIONS,
    describe_files,
    describe_tree,
    file_reader,
    list_files,
    locate,
    read_files,
)
from corpusflow.sources.tree import open_files, stream_tree

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_folder(
    store: Store,
    root: str,
    checkpoint: str,
    run: Run,
    extensions: Iterable[str] = FOLDER_EXTENSIONS,
    files_per_batch: int = 10_000,
    continuous: str | None = None,
) -> StreamingQuery:
    """Starts a stream that ingests each new file below ``root`` once, a run per micro-batch.

    Run ids come from the run's start time and the batch number, so a batch that is replayed replaces its own
    partitions. Give the same ``run.started`` whenever the stream is restarted on a checkpoint. The vector index is kept
    cumulative. By default the stream stops when all present files are done; ``continuous`` names a trigger interval.
    """
    full, _, _ = locate(store.spark, root)
    reader = file_reader(store.spark.readStream, extensions).schema(BINARY_FILE)
    arriving = reader.option("maxFilesPerTrigger", files_per_batch).load(full)

    def one_batch(files: DataFrame, number: int) -> None:
        batch = replace(run, suffix=f"{number:09d}", replace_index=False)
        ingest_files(store, describe_files(files, full), batch)

    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one_batch)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


_LISTED = "path string, rel_path string, source_file string, ext string, length long, modified timestamp"
_KEPT = "length long, modified timestamp"


def _newer(key: tuple, listings: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The listed row of a path, if its file is not as the state has it."""
    row = pd.concat(list(listings)).sort_values("modified").tail(1)
    now = (int(row["length"].iloc[0]), row["modified"].iloc[0].to_pydatetime())
    if not state.exists or tuple(state.get) != now:
        state.update(now)
        yield row


def stream_changes(
    store: Store,
    root: str,
    checkpoint: str,
    run: Run,
    extensions: Iterable[str] = FOLDER_EXTENSIONS,
    continuous: str | None = None,
) -> StreamingQuery:
    """Starts a stream that ingests every version of each file below ``root``: new files and rewritten ones.

    Every trigger lists the tree, hidden and empty files included. Length and time of each path as last seen are the
    state of the stream, keyed by path, and only what differs goes on to be opened and ingested, a run per
    micro-batch. A batch that is replayed replaces its own partitions. Give the same ``run.started`` whenever the
    stream is restarted on a checkpoint. By default the stream stops after one listing; ``continuous`` names a trigger interval.
    """
    full, _, _ = locate(store.spark, root)
    listed = describe_tree(stream_tree(store.spark, full), full, tuple(extensions))
    changed = listed.groupBy("path").applyInPandasWithState(
        _newer, _LISTED, _KEPT, "update", GroupStateTimeout.NoTimeout
    )

    def one_batch(files: DataFrame, number: int) -> None:
        due = truncate_lineage(files)
        if not due.isEmpty():
            batch = replace(run, suffix=f"{number:09d}", replace_index=False)
            ingest_files(store, due, batch, lambda files: open_files(files, full, largest_file(store.spark)))

    writer = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(one_batch)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def changed_files(store: Store, root: str, client_id: str) -> DataFrame:
    """Files below ``root`` that are not archived as they are now; a stream does not see a file rewritten in place.

    Give the result to ``ingest_files``. What is due is worked out on the listing. Its earliest time and its sizes then
    limit the read: the source skips files outside them unopened, and of the rest only the due ones are kept.
    """
    files = read_files(store.spark, root)
    if not store.exists("raw_files"):
        return files
    key = ["path", "length", "modified"]
    known = store.read("raw_files").filter(F.col("client_id") == client_id).select(*key)
    if store.exists("raw_parts"):
        known = known.union(store.read("raw_parts").filter((F.col("client_id") == client_id) & (F.col("part") == 0)).select(*key))
    # Of a time the two listings tell milliseconds and microseconds.
    listed = list_files(store.spark, root).select("path", "length", F.date_trunc("millisecond", "modified").alias("modified"))
    known = known.select("path", "length", F.date_trunc("millisecond", "modified").alias("modified"))
    due = truncate_lineage(listed.join(known, key, "left_anti"))
    since, shortest, longest = due.agg(F.min("modified"), F.min("length"), F.max("length")).first()
    if since is None:
        return files.filter(F.lit(False))
    window = (F.col("modified") >= F.lit(since)) & F.col("length").between(shortest, longest)
    return files.filter(window).join(due.select("path"), "path", "left_semi")
