"""Ingestion: files or tables to stored chunks, vectors and metadata.

A run reads its files once, into the archive. Each later stage reads the table the stage before wrote, so nothing is
extracted or embedded twice, and a lost executor costs the tasks it ran. Archiving, extraction, chunking and embedding
are narrow; only per-document totals are shuffled.
"""

from __future__ import annotations

import time
from functools import reduce
from typing import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow import schemas
from corpusflow.functions.paths import client_object_key, make_doc_id, path_parts, sha256_hex
from corpusflow.operators import metadata
from corpusflow.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, as_pages, chunk_documents, with_chunk_ids
from corpusflow.operators.embedding import EmbedderFactory, HashingEmbedder, embed
from corpusflow.operators.tabular import row_line
from corpusflow.operators.vectors import assign_vector_ids
from corpusflow.plans.store import DOCUMENT_KEY, RENEWED, Store
from corpusflow.session import release, scratch_path, spread, stage
from corpusflow.sources.extract import NATIVE, NO_TEXT, extract, is_native
from corpusflow.sources.files import UPLOAD_EXTENSIONS, locate, not_loaded, read_file, read_files, upload_gate
from corpusflow.sources.formats import READERS, Reader
from corpusflow.sources.long_text import SPLITTABLE, chunk_long_text, long_lines
from corpusflow.sources.manifest import plan_drive, plan_sharepoint
from corpusflow.sources.tree import file_sha256, open_files, open_parts, passed_over

RUN = T.StructType(
    [
        T.StructField("client_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_timestamp", T.StringType()),
        T.StructField("documents_processed", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("uploads_succeeded", T.LongType()),
        T.StructField("uploads_failed", T.LongType()),
        T.StructField("next_vec_id", T.LongType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
# The messages of a run's summary.
SUCCEEDED = "Pipeline completed successfully"
FAILED = "Pipeline execution failed"
NO_CLIENT = "client_id is required inside extra_metadata"
NO_PATH = "source_path is required"
BAD_FOLDER = "Invalid directory path: {}"
NO_FILE = "File not found: {}"
NO_DOCUMENTS = "No supported documents found"
NO_REMOTE_FILES = "No supported files found in {} folder"
TOO_LARGE = "File is too large to read"
NOT_ARCHIVED = "File is too large to archive"
NO_CHUNKS = "Chunk creation failed — no chunks produced"

# Where stored objects are addressed.
ACCOUNT, CONTAINER = "account", "container"

# Bytes above which text is read in splits though a row could hold it, and of a piece that such a file is archived in.
SPLIT_BYTES = 32 << 20
PART_BYTES = 8 << 20

JOB = "request_id string, seq long, status string, detail string, at string"


@dataclass(frozen=True)
class Run:
    """The settings of one ingestion run."""

    client_id: str
    source_type: str = "local"
    label: str | None = None
    extra_metadata: dict[str, str] = field(default_factory=dict)
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    suffix: str = "0"
    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    factory: EmbedderFactory = HashingEmbedder
    model: str | None = None
    readers: dict[str, Reader] | None = None
    replace_index: bool = True
    # Bytes above which no row holds a file: text is read in splits and not archived. By default, what a row can hold.
    split_above: int | None = None

    @property
    def model_key(self) -> str:
        return model_name(self.factory, self.model)

    @property
    def client(self) -> str:
        return (self.client_id or "").strip().lower()

    @property
    def run_id(self) -> str:
        return f"{self.started:%Y%m%d_%H%M%S_%f}_{self.suffix}"

    def stamp(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("client_id", F.lit(self.client)).withColumn("run_id", F.lit(self.run_id))


def _run_row(store: Store, run: Run, **values) -> DataFrame:
    row = {
        "client_id": run.client,
        "run_id": run.run_id,
        "run_timestamp": metadata.iso_utc(run.started),
        "documents_processed": 0,
        "total_chunks": 0,
        "uploads_succeeded": 0,
        "uploads_failed": 0,
        "next_vec_id": 0,
        "elapsed_seconds": 0.0,
        "message": None,
        "error": None,
        **values,
    }
    return _short_rows(store, [row], RUN)


def _short_rows(store: Store, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A few rows that the driver holds, which no worker is needed to read."""
    return store.spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)


def _failed(store: Store, run: Run, error: str) -> DataFrame:
    """The summary of a run that came to nothing, listed in ``failed_runs``: ``runs`` has those whose rows count."""
    row = _run_row(store, run, status="failed", message=FAILED, error=error)
    store.append("failed_runs", row)
    return row


def ingest_files(
    store: Store, files: DataFrame, run: Run, opened: Callable[[DataFrame], DataFrame] = lambda files: files
) -> DataFrame:
    """Ingests ``read_files`` rows and returns the run's summary row, as stored in ``runs``.

    ``opened`` adds the ``content`` to rows that come without; only those of files that are read whole are given to it.
    """
    began = time.monotonic()
    if not run.client:
        return _failed(store, run, NO_CLIENT)
    largest = min(largest_file(store.spark), run.split_above or 2**31)
    facts = files.drop("content")
    too_large = long = None
    if facts.filter(F.col("length") > min(largest, SPLIT_BYTES)).isEmpty():
        archive(store, opened(files), run)
    else:
        whole, parted = _read_whole(files, run, largest)
        archive(store, opened(whole), run)
        large = facts.filter(F.col("length") > largest)
        split = large.filter(_splittable(run))
        if parted:
            parted_files = facts.filter(F.col("path").isin(parted))
            archive_parts(store, parted_files, run)
            split = split.unionByName(parted_files)
        long = _read_long(store, split, run)
        too_large = large.filter(~_splittable(run))
    extract_archive(store, run, facts.limit(0) if too_large is None else too_large, long)
    if not store.run_exists("documents", run.client, run.run_id):
        return _failed(store, run, NO_DOCUMENTS)
    documents = store.read_run("documents", run.client, run.run_id).filter(F.col("pages").isNotNull())
    if documents.isEmpty():
        return _failed(store, run, NO_DOCUMENTS)
    chunk_and_embed(store, documents, run, long)
    return finish(store, run, began)


def _read_whole(files: DataFrame, run: Run, largest: int) -> tuple[DataFrame, list[str]]:
    """The files a row shall hold, and the paths of text files that one could hold but that are better read in splits.

    Text that cannot be read in splits is left whole: UTF-16, and files that Spark's own reader passes over. What is read
    whole is picked by length, which the source goes by without opening a file.
    """
    within = files.filter(F.col("length") <= largest)
    if largest <= SPLIT_BYTES:
        return within, []
    over = files.drop("content").filter(F.col("length").between(SPLIT_BYTES + 1, largest)).select("path", "rel_path", "ext", "length")
    over = over.withColumn("text", F.col("ext").isin(*[e for e in NATIVE if e not in (run.readers or {})]) & ~passed_over(F.col("rel_path"), F.col("length")))
    text = over.filter("text").select("path", "rel_path")
    first = text.head()
    if first is None:
        return within, []
    marks = open_files(text, first.path[: -len(first.rel_path)], start=2)
    parted = [r.path for r in marks.filter(~F.hex("content").isin("FFFE", "FEFF")).select("path").toLocalIterator()]  # large each
    rest = [r.length for r in over.filter(~F.col("path").isin(parted)).select("length").distinct().toLocalIterator()]
    small = within.filter(F.col("length") <= SPLIT_BYTES)
    if not rest:
        return small, parted
    picked = reduce(lambda a, b: a | b, [F.col("length") == n for n in rest])
    return small.unionByName(files.filter(picked).filter(~F.col("path").isin(parted))), parted


def _splittable(run: Run) -> Column:
    """Files that can be read in splits: no reader of the run's own takes them whole."""
    return F.col("ext").isin(*[e for e in SPLITTABLE if e not in (run.readers or {})])


@dataclass(frozen=True)
class LongText:
    """Files read in splits, whose lines are stored: ``files`` with the ``error`` of those without text. ``work`` is a scratch
    folder that is removed when their chunks are written."""

    files: DataFrame
    work: str


def _read_long(store: Store, files: DataFrame, run: Run) -> LongText | None:
    """Stores the lines of files too large for a row; records that cannot be shown go to ``line_errors``.

    What is staged on the way is removed as soon as the next table is written: each copy is as large as the files.
    """
    first = files.select("path", "rel_path").head()
    if first is None:
        return None
    root = first.path[: -len(first.rel_path)]
    work = scratch_path(store.spark, "long")
    read = stage(f"{work}/read", long_lines(files, root, f"{work}/split"))
    store.remove(f"{work}/split")
    release(store.spark)
    faults = read.filter(F.col("error").isNotNull())
    store.write("line_errors", run.stamp(faults.select("rel_path", "pos", "error")))
    store.write("document_lines", run.stamp(read.filter("line is not null").select("rel_path", "pos", "line")))
    texts = read.groupBy("rel_path").agg(
        F.bool_or(F.col("line").isNotNull() & (F.trim("line") != "")).alias("filled"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("fault"),
    )
    told = files.join(texts, "rel_path", "left").withColumn(
        "error", F.when(F.coalesce("filled", F.lit(False)), None).otherwise(F.coalesce("fault", F.lit(NO_TEXT)))
    )
    told = stage(f"{work}/files", told.drop("filled", "fault"))
    store.remove(f"{work}/read")
    return LongText(told, work)


def ingest_directory(store: Store, root: str, run: Run) -> DataFrame:
    """All supported files below ``root``."""
    if not root:
        return _failed(store, run, NO_PATH)
    _, _, is_folder = locate(store.spark, root)
    if not is_folder:
        return _failed(store, run, BAD_FOLDER.format(root))
    plain = [e for e in NATIVE if e not in (run.readers or {})]
    table = {**READERS, **(run.readers or {})}
    files = read_files(store.spark, root, [*plain, *table])
    return ingest_files(store, files, run)


def ingest_file(store: Store, path: str, run: Run) -> DataFrame:
    """One uploaded file, if the gate lets it pass: file name, size, doc id, and the run's summary columns."""
    full, exists, is_folder = locate(store.spark, path)
    if not exists or is_folder:
        return _failed(store, run, NO_FILE.format(path))
    file = read_file(store.spark, path)
    gated = upload_gate(
        file.select(F.lit(run.client_id).alias("client_id"), F.col("source_file").alias("filename"),
                    F.col("length").alias("size_bytes"))
    ).first()
    summary = ingest_files(store, file, run) if gated.accepted else _failed(store, run, gated.reject_reason)
    name = F.lit(gated.filename)
    return summary.select(
        name.alias("filename"), F.lit(gated.size_bytes).alias("size_bytes"), make_doc_id(name).alias("doc_id"), "*"
    )


def _with_job(store: Store, request_id: str, run: Run, work) -> DataFrame:
    """Runs ``work`` between job events: pending, running, then done or error."""

    def event(seq: int, status: str, detail: str | None = None):
        now = metadata.iso_utc(datetime.now(timezone.utc))
        store.append("jobs", store.spark.createDataFrame([(request_id, seq, status, detail, now)], JOB))

    event(0, "pending")
    event(1, "running")
    try:
        summary = work()
        error = summary.first().error
    except Exception as fault:
        event(2, "error", str(fault))
        raise
    event(2, "error" if error else "done", error)
    return summary


def ingest_drive(
    store: Store, request_id: str, items: DataFrame, folder_id: str, landed: str, run: Run, recursive: bool = True
) -> DataFrame:
    """A remote drive folder whose planned files have been fetched to ``landed``, with job states.

    ``items`` is the drive listing. Planned files that did not arrive are stored as ``missing_files``.
    """
    plan = plan_drive(items, folder_id, recursive).filter(F.col("action") != "skip")
    return _with_job(store, request_id, run, lambda: _ingest_planned(store, plan, landed, run, "Google Drive"))


def ingest_sharepoint(
    store: Store, request_id: str, items: DataFrame, folder_id: str, landed: str, run: Run
) -> DataFrame:
    """A document library folder whose planned files have been fetched to ``landed``, with job states."""
    plan = plan_sharepoint(items, folder_id).filter(F.col("action") == "download")
    return _with_job(store, request_id, run, lambda: _ingest_planned(store, plan, landed, run, "SharePoint"))


def _ingest_planned(store: Store, plan: DataFrame, landed: str, run: Run, place: str) -> DataFrame:
    if plan.isEmpty():
        return _failed(store, run, NO_REMOTE_FILES.format(place))
    # Of what has landed, only what was planned; the folder may hold other files.
    wanted = plan.select(F.col("target").alias("rel_path")).distinct()
    arrived = read_files(store.spark, landed, UPLOAD_EXTENSIONS).join(wanted, "rel_path", "left_semi")
    summary = ingest_files(store, arrived, run)
    missing = not_loaded(plan.select(F.col("target").alias("rel_path")), arrived, ["rel_path"])
    store.write("missing_files", run.stamp(missing))
    return summary


# ---- stages ---------------------------------------------------------------------------------------------


def archive(store: Store, files: DataFrame, run: Run) -> None:
    """Copies the files into ``raw_files`` with their keys and fingerprints: the only read of the source."""
    rows = run.stamp(files).select(
        "*",
        sha256_hex(F.col("content")).alias("sha256"),
        client_object_key(F.lit("raw"), F.col("client_id"), F.col("source_file")).alias("object_name"),
        is_native(F.col("ext"), run.readers).alias("is_native"),
    )
    store.write("raw_files", rows, ("client_id", "run_id", "is_native"))


def archive_parts(store: Store, files: DataFrame, run: Run) -> None:
    """Copies files that are read in splits into ``raw_parts``, a row per piece, in order of ``part``."""
    first = files.select("path", "rel_path").head()
    root = first.path[: -len(first.rel_path)]
    told = files.join(file_sha256(files, root), "rel_path").select(*files.columns, "sha256")
    rows = run.stamp(open_parts(told, root, PART_BYTES))
    name = client_object_key(F.lit("raw"), F.col("client_id"), F.col("source_file"))
    store.write("raw_parts", rows.withColumn("object_name", name))


def largest_file(spark: SparkSession) -> int:
    """Bytes of the largest file that a row can hold. Larger ones are listed but never opened."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))


def extract_archive(store: Store, run: Run, too_large: DataFrame, long: LongText | None = None) -> None:
    """Page text of the archived files into ``documents``; files without text, and those too large to read, keep a row
    with the reason. One read in splits has a page without text, which only its chunks hold."""
    extra = F.lit(None) if not run.extra_metadata else _literal_map(run.extra_metadata)
    rows = run.stamp(too_large).withColumns({"pages": F.lit(None).cast(schemas.PAGES), "error": F.lit(TOO_LARGE)})
    if store.run_exists("raw_files", run.client, run.run_id):
        raw = store.read_run("raw_files", run.client, run.run_id).drop("sha256", "object_name")
        read = extract(raw, run.readers).select(
            *[c for c in raw.columns if c not in ("content", "is_native")], "pages", "error"
        )
        rows = read.unionByName(rows)
    if long:
        page = F.array(F.struct(F.lit(1), F.lit(None), F.lit(None))).cast(schemas.PAGES)
        shown = F.when(F.col("error").isNull(), page).alias("pages")
        rows = rows.unionByName(run.stamp(long.files).select(*[c for c in rows.columns if c not in ("pages", "error")], shown, "error"))
    rows = rows.select(
        "*",
        make_doc_id(F.col("rel_path")).alias("doc_id"),
        F.coalesce(F.size("pages"), F.lit(0)).alias("total_pages"),
        F.lit(run.source_type).alias("source_type"),
        extra.cast(schemas.EXTRA).alias("extra_metadata"),
    )
    store.write("documents", rows)


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def chunk_and_embed(store: Store, documents: DataFrame, run: Run, long: LongText | None = None) -> None:
    """Chunks of the run's documents with their vectors. No shuffle, as pages of a document share a row, but for those
    of files read in splits, which have been packed before."""
    source = documents.select(
        "client_id", "run_id", "rel_path", "doc_id", "source_file", "source_type", "extra_metadata", "pages"
    )
    chunks = chunk_documents(spread(source), run.size, run.overlap)
    if long and store.run_exists("document_lines", run.client, run.run_id):
        lines = store.read_run("document_lines", run.client, run.run_id)
        packed = chunk_long_text(lines, run.size, run.overlap, work=f"{long.work}/rows").withColumn("page", F.lit(1).cast("long"))
        about = documents.select([c for c in source.columns if c != "pages"])
        chunks = chunks.unionByName(packed.join(about, "rel_path"))
    chunks = with_chunk_ids(chunks)
    stamped = chunks.withColumn("uploaded_at", F.lit(metadata.iso_utc(run.started)))
    vectors = embed(stamped, factory=run.factory).withColumn("model", F.lit(run.model_key))
    store.write("chunks", vectors)
    if long:
        store.remove(long.work)
        release(store.spark)
    # A run that is repeated writes its chunks anew: what was embedded again before then is void.
    store.drop_run(RENEWED, run.client, run.run_id)


def model_name(factory: EmbedderFactory, name: str | None = None) -> str:
    """The name vectors are stored under, which a rebuild compares: given, or the factory's own ``model_name``.

    A name made up from a function would be the same for two of its closures, and other in the next process.
    """
    name = name or getattr(factory, "model_name", None) or (factory is HashingEmbedder and "hashing")
    if not name:
        raise ValueError("name the model")
    return name


def write_vectors(store: Store, chunks: DataFrame, run: Run) -> int:
    """The vector table of a run: ids follow path parts, then chunk order. Returns the first id.

    By default the run becomes the client's index, from id 0. Otherwise it is added behind earlier runs: its ids start
    where the run table says theirs end, and nothing already written is read or touched.
    """
    rows = chunks.select("client_id", "run_id", "rel_path", "doc_id", "chunk_id", "chunk_index", "embedding")
    numbered = assign_vector_ids(rows, ["client_id"], "rel_path", [path_parts(F.col("rel_path"))])
    base = 0 if run.replace_index else _next_vector_id(store, run)
    store.write("vectors", numbered.withColumn("vec_id", F.col("vec_id") + base))
    return base


def _next_vector_id(store: Store, run: Run) -> int:
    """The first id no earlier run has used; the run table has a short row per run."""
    runs = store.read_client("runs", run.client)
    if runs is None:
        return 0
    return runs.filter(F.col("run_id") != run.run_id).agg(F.max("next_vec_id")).first()[0] or 0


def retire_vectors(store: Store, run: Run) -> None:
    """Drop the client's earlier indices, once the run that replaces them is in ``runs``."""
    if run.replace_index:
        mine = (F.col("client_id") == run.client) & (F.col("run_id") != run.run_id)
        store.drop_partitions("vectors", store.read("vectors").filter(mine).select("client_id", "run_id").distinct())


def finish(store: Store, run: Run, began: float) -> DataFrame:
    """Vectors, document metadata, log and summary of a run whose chunks are written.

    ``began`` is the monotonic clock at the run's start.
    """
    if not store.run_exists("chunks", run.client, run.run_id):
        return _failed(store, run, NO_CHUNKS)
    chunks = store.read_run("chunks", run.client, run.run_id)
    base = write_vectors(store, chunks, run)
    documents = store.read_run("documents", run.client, run.run_id).filter(F.col("pages").isNotNull())
    described = documents.select(
        *DOCUMENT_KEY, "run_id", "doc_id", "source_file", "source_type", "total_pages", "extra_metadata",
        metadata.object_keys(F.col("client_id"), F.col("source_file"), F.col("doc_id")).alias("blob_urls"),
    )
    store.write(
        "document_meta",
        metadata.document_meta(described, chunks, [*DOCUMENT_KEY, "run_id"], F.lit(metadata.iso_utc(run.started))),
    )
    meta = store.read_run("document_meta", run.client, run.run_id)
    totals = meta.agg(F.count(F.lit(1)).alias("documents"), F.sum("total_chunks").alias("chunks")).first()
    sent, failed = _record_uploads(store, run)
    summary = _run_row(
        store, run, documents_processed=totals.documents, total_chunks=totals.chunks, uploads_succeeded=sent,
        uploads_failed=failed, next_vec_id=base + totals.chunks, elapsed_seconds=round(time.monotonic() - began, 2), status="partial" if failed else "success", message=SUCCEEDED,
    )
    store.write("runs", summary)
    retire_vectors(store, run)
    named = {"client_id": run.client, "run_id": run.run_id, "label": run.label}
    log = _short_rows(store, [named], T.StructType([T.StructField(name, T.StringType()) for name in named]))
    created = F.to_utc_timestamp(F.lit(run.started), F.current_timezone())
    store.write(
        "ingestion_log",
        log.select(
            "client_id", "run_id",
            metadata.run_label(F.col("label"), F.col("client_id")).alias("label"),
            metadata.log_key(F.col("client_id"), created).alias("object_name"),
            F.lit(totals.documents).alias("files_processed"), F.lit(totals.chunks).alias("chunks_created"),
            F.lit(metadata.iso_utc(run.started)).alias("created_at"), F.lit("success").alias("status"),
            (_literal_map(run.extra_metadata) if run.extra_metadata else F.lit(None)).cast(schemas.EXTRA).alias("extra_metadata"),
        ),
    )
    return summary


def _record_uploads(store: Store, run: Run) -> tuple[int, int]:
    """The result of storing each file in ``uploads``, and how many were stored and not.

    A file whose client or name is blank has no key to store it under; one too large for a row was not archived.
    """
    key = [*DOCUMENT_KEY, "run_id"]
    lost = store.read_run("documents", run.client, run.run_id)
    results = stored = None
    if store.run_exists("raw_files", run.client, run.run_id):
        stored = store.read_run("raw_files", run.client, run.run_id).select(*key, "object_name")
    if store.run_exists("raw_parts", run.client, run.run_id):
        parted = store.read_run("raw_parts", run.client, run.run_id).filter("part = 0").select(*key, "object_name")
        stored = parted if stored is None else stored.unionByName(parted)
    if stored is not None:
        results = metadata.upload_results(stored, ACCOUNT, CONTAINER)
        lost = lost.join(stored.select(*key), key, "left_anti")
    reason = F.when(F.col("error") == TOO_LARGE, TOO_LARGE).otherwise(NOT_ARCHIVED)
    missing = lost.select(
        *key, F.lit(False).alias("success"), F.lit("").alias("blob_name"),
        F.lit(None).cast("string").alias("blob_url"), reason.alias("error"),
    )
    store.write("uploads", missing if results is None else results.unionByName(missing))
    totals = store.read_run("uploads", run.client, run.run_id).agg(
        F.count_if("success").alias("sent"), F.count_if(~F.col("success")).alias("failed")
    ).first()
    return totals.sent, totals.failed


# ---- tables ---------------------------------------------------------------------------------------------


def chunk_table(
    df: DataFrame,
    doc_id: Column,
    text: Column | None = None,
    columns: dict[str, Column] | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of a table whose rows are documents: a text column, or the row's ``name: value`` line."""
    body = text if text is not None else row_line(columns)
    docs = df.select(doc_id.cast("string").alias("doc_id"), as_pages(body).alias("pages"))
    return with_chunk_ids(chunk_documents(spread(docs), size, overlap))
