"""Deleting and re-embedding stored documents."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import catalog
from corpusflow.operators.embedding import EmbedderFactory, HashingEmbedder, embed
from corpusflow.plans.ingest import model_name
from corpusflow.plans.store import CHUNK_KEY, DOCUMENT_KEY, DOCUMENT_TABLES, RENEWABLE, RENEWED, Store
from corpusflow.session import scratch_path, stage

# Documents whose names are sure to be few enough to travel to every task.
FEW = 10_000


def stored_objects(store: Store) -> DataFrame:
    """The object keys a client sees (``name``), from the current documents."""
    meta = store.current("document_meta")
    return meta.select(F.explode(F.map_values("blob_urls")).alias("name"))


def delete_documents(store: Store, targets: DataFrame) -> DataFrame:
    """Deletes the documents of ``targets`` (``client_id, doc_id``); returns the report per document.

    What is deleted is listed in ``deleted``, a row per stored version, and leaves ``Store.current`` at once. No other table
    is touched until ``compact``. A later ingestion of the same file is a new version and current again.
    """
    rows = store.read("documents").join(targets.distinct(), ["client_id", "doc_id"], "left_semi")
    keys = scratch_path(store.spark, "delete")
    rows.select(*DOCUMENT_KEY, "doc_id", "source_file", "run_id").distinct().write.parquet(keys)
    gone = store.spark.read.parquet(keys)
    named = gone.select("client_id", "doc_id", "source_file").distinct()
    wanted = targets.join(named, ["client_id", "doc_id"], "left").select("client_id", "doc_id", "source_file")
    report_path = scratch_path(store.spark, "delete-report")
    catalog.delete_report(wanted, stored_objects(store).distinct()).write.parquet(report_path)
    listed = gone.select(*DOCUMENT_KEY, F.col("run_id").alias("deleted_run"))
    store.write("deleted", listed.withColumn("run_id", F.lit(_now())))
    return store.spark.read.parquet(report_path)


def _now() -> str:
    """The time as an id that sorts by it."""
    return f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"


def compact(store: Store) -> None:
    """Rewrites the partitions that hold deleted versions without them, and those with chunks embedded again with their
    newest vectors; then empties ``deleted`` and ``renewed``.

    Repeating it after a failure is safe: rows that are gone already are not missed, and vectors folded in are folded in
    once more. What is embedded again meanwhile stays in ``renewed``.
    """
    _drop_deleted(store)
    if store.exists(RENEWED):
        _fold_renewed(store)


def _fold_renewed(store: Store) -> None:
    path, names = scratch_path(store.spark, "fold"), scratch_path(store.spark, "fold-names")
    store.renewals().select("client_id", "run_id", "version").distinct().write.parquet(path)
    done = store.spark.read.parquet(path)
    runs = done.select("client_id", "run_id").distinct()
    touched = stage(names, store.renewals().select(*DOCUMENT_KEY, "run_id").distinct())
    few = touched if touched.count() <= FEW else None
    for table in RENEWABLE:
        rows = store.read(table).join(runs, ["client_id", "run_id"], "left_semi")
        store.rewrite(table, runs, store.renewed(table, rows, few), ("client_id", "run_id"))
    store.drop_partitions(RENEWED, done)
    store.remove(path)
    store.remove(names)


def _drop_deleted(store: Store) -> None:
    if not store.exists("deleted"):
        return
    path = scratch_path(store.spark, "compact")
    store.deleted().write.parquet(path)
    done = store.spark.read.parquet(path)
    gone = done.select(*DOCUMENT_KEY, F.col("deleted_run").alias("run_id")).distinct()
    for table in DOCUMENT_TABLES:
        if store.exists(table):
            _drop_versions(store, table, gone)
    store.drop_partitions("deleted", done.select("client_id", "run_id").distinct())
    store.remove(path)


def _drop_versions(store: Store, table: str, gone: DataFrame) -> None:
    partitions = ("client_id", "run_id", "is_native") if table == "raw_files" else ("client_id", "run_id")
    key = [*DOCUMENT_KEY, "run_id"]
    rows = store.read(table)
    names = scratch_path(store.spark, "drop")
    affected = stage(names, rows.join(gone, key, "left_semi").select(*partitions).distinct())
    if not affected.isEmpty():
        touched = rows.join(affected, list(partitions), "left_semi")
        store.rewrite(table, affected, catalog.without_documents(touched, gone, key), partitions)
    store.remove(names)


def rebuild(
    store: Store,
    client_id: str,
    doc_id: str | None = None,
    factory: EmbedderFactory = HashingEmbedder,
    force: bool = False,
    model: str | None = None,
) -> DataFrame:
    """Embeds a document's chunks, or all of a client's, again. Returns ``doc_id, action`` per document.

    Writes a row per chunk embedded again into ``renewed`` and touches nothing else; ``Store.current`` shows the newest
    vectors from then on. ``action`` is ``rebuilt``, ``skipped`` (no chunks) or ``error`` (asked for, but without chunks). Chunks that
    already bear the model's name are left as they are, unless ``force``.
    """
    model = model_name(factory, model)
    meta = store.current("document_meta").filter(F.col("client_id") == client_id)
    chunks = store.current("chunks").filter(F.col("client_id") == client_id)
    if doc_id is not None:
        meta, chunks = meta.filter(F.col("doc_id") == doc_id), chunks.filter(F.col("doc_id") == doc_id)
    classes = catalog.rebuild_classes(meta, chunks, ["client_id", "doc_id"])
    missing = "skipped" if doc_id is None else "error"
    outcome = classes.select("doc_id", F.when(F.col("action") == "rebuild", "rebuilt").otherwise(missing).alias("action"))
    if doc_id is not None:
        asked = store.spark.createDataFrame([(doc_id,)], "doc_id string")
        outcome = asked.join(outcome, "doc_id", "left").withColumn("action", F.coalesce("action", F.lit("error")))
    report = scratch_path(store.spark, "rebuild-report")
    outcome.write.parquet(report)

    stale = chunks if force else chunks.filter(F.col("model") != model)
    renewed = embed(stale.select(*CHUNK_KEY, "text"), factory=factory).withColumn("model", F.lit(model))
    rows = renewed.select(*CHUNK_KEY, "embedding", "model").withColumn("version", F.lit(_now()))
    store.write(RENEWED, rows, ("client_id", "run_id", "version"))
    return store.spark.read.parquet(report)
