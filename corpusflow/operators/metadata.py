"""Chunk records as JSON, document metadata and run reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.functions.paths import client_key, client_object_key, make_chunk_id, public_url
from corpusflow.functions.text import only_present

# ---- chunk records --------------------------------------------------------------------------------------

_CORE = [f.name for f in schemas.CHUNK]


def _members(json: Column) -> Column:
    """A JSON object's text without its braces; null where it is empty."""
    return F.nullif(F.substr(json, F.lit(2), F.length(json) - 2), F.lit(""))


def chunk_json(extra: str | None = "extra_metadata") -> Column:
    """A chunk row as one JSON object: the record's fields, then the extra keys, then the embedding.

    An extra key that bears a field's name takes that field's place.
    """
    options = {"ignoreNullFields": "false"}
    fields = [c for c in _CORE if c != "embedding"]
    if extra is None:
        return F.to_json(F.struct(*_CORE), options)
    extras = F.coalesce(F.col(extra), F.create_map().cast(schemas.EXTRA))
    added = _members(F.to_json(F.map_filter(extras, lambda k, v: ~k.isin(*_CORE)), options))
    vector = _members(F.to_json(F.struct("embedding"), options))

    def own_or_extra(field: str) -> Column:
        given = F.to_json(F.map_filter(extras, lambda k, v: k == field), options)
        return F.coalesce(_members(given), _members(F.to_json(F.struct(field), options)))

    head = F.when(
        F.exists(F.map_keys(extras), lambda k: k.isin(*fields)), F.concat_ws(",", *map(own_or_extra, fields))
    ).otherwise(_members(F.to_json(F.struct(*fields), options)))
    return F.concat(F.lit("{"), F.concat_ws(",", head, added, vector), F.lit("}"))


def parse_chunk_lines(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Chunk rows from JSONL lines: blank and malformed lines are skipped, absent fields get their defaults.

    Keys that are no field of the record are collected in ``extra_metadata``. ``uploaded_at`` is null where absent;
    ``with_upload_time`` fills it. A line is parsed once, into a map of texts; a malformed one gives none.
    """
    keep = keep or []
    record = F.from_json(F.col(line), "map<string,string>")
    parsed = lines.select(*keep, only_present(record).alias("_r"))

    def given(name: str) -> Column:
        return F.try_element_at("_r", F.lit(name))

    doc_id = F.coalesce(given("doc_id"), F.lit("unknown"))
    index = F.coalesce(given("chunk_index").try_cast("long"), F.lit(0).cast("long"))
    text = F.coalesce(given("text"), F.lit(""))
    return parsed.select(
        *keep,
        doc_id.alias("doc_id"),
        F.coalesce(F.nullif(given("chunk_id"), F.lit("")), make_chunk_id(doc_id, index)).alias("chunk_id"),
        index.alias("chunk_index"),
        F.coalesce(given("page").try_cast("long"), F.lit(0).cast("long")).alias("page"),
        text.alias("text"),
        F.coalesce(given("source_file"), F.lit("")).alias("source_file"),
        F.coalesce(given("source_type"), F.lit("local")).alias("source_type"),
        F.nullif(given("uploaded_at"), F.lit("")).alias("uploaded_at"),
        F.length(text).alias("char_count"),
        F.map_filter("_r", lambda k, v: ~k.isin(*_CORE)).alias("extra_metadata"),
        F.from_json(given("embedding"), schemas.VECTOR).alias("embedding"),
    )


def with_upload_time(chunks: DataFrame, run_ts: datetime) -> DataFrame:
    """``uploaded_at`` filled with the run's time where absent."""
    return chunks.withColumn("uploaded_at", F.coalesce("uploaded_at", F.lit(iso_utc(run_ts))))


def iso_utc(moment: datetime) -> str:
    return moment.isoformat()


# ---- documents ------------------------------------------------------------------------------------------


def document_meta(documents: DataFrame, chunks: DataFrame, keys: list[str], processed_at: Column) -> DataFrame:
    """One row per document: its own columns plus chunk and character totals and the processing time.

    Totals combine before the shuffle, and read no text.
    """
    totals = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("char_count").alias("total_chars")
    )
    return documents.join(totals, keys, "left").select(
        *documents.columns,
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
        processed_at.alias("processed_at"),
    )


def count_pages(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents given as page rows: ``total_pages`` counts the non-empty ones."""
    return pages.groupBy(*keys).agg(F.count_if(F.col(text) != "").alias("total_pages"))


def full_text(pages: Column) -> Column:
    """The full text of a document whose pages share a row: non-empty texts in page order, joined by newlines."""
    ordered = F.array_sort(pages, lambda a, b: a["page"] - b["page"])
    return F.array_join(F.transform(F.filter(ordered, lambda p: p["text"] != ""), lambda p: p["text"]), "\n")


def full_text_pages(pages: DataFrame, keys: list[str], page: str = "page", text: str = "text") -> DataFrame:
    """The full text of documents given as page rows, a row per non-empty page: in the order of ``page`` and joined by
    newlines they are the text. However long a document is, none of its pages has to meet another.
    """
    return pages.filter(F.col(text) != "").select(*keys, F.col(page).alias("page"), F.col(text).alias("full_text"))


def object_keys(client_id: Column, source_file: Column, doc_id: Column) -> Column:
    """The keys of a document's stored objects: raw file, chunks and metadata."""
    return F.create_map(
        F.lit("raw"), client_object_key(F.lit("raw"), client_id, source_file),
        F.lit("chunks"), client_object_key(F.lit("chunks"), client_id, F.concat(doc_id, F.lit("_chunks.jsonl"))),
        F.lit("meta"), client_object_key(F.lit("meta"), client_id, F.concat(doc_id, F.lit("_meta.json"))),
    )


def object_urls(keys: Column, account: str, container: str) -> Column:
    return F.transform_values(keys, lambda _, key: public_url(F.lit(account), F.lit(container), key))


# ---- runs -----------------------------------------------------------------------------------------------


def per_document(documents: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``documents`` with their ``chunk_count``; a document without chunks has 0. Counts combine before the shuffle."""
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, keys, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def upload_results(files: DataFrame, account: str, container: str) -> DataFrame:
    """A result per archived file (``object_name``, null where its client or name is blank) with its address."""
    stored = F.col("object_name").isNotNull()
    return files.select(
        *[c for c in files.columns if c != "object_name"],
        stored.alias("success"),
        F.coalesce("object_name", F.lit("")).alias("blob_name"),
        public_url(F.lit(account), F.lit(container), F.col("object_name")).alias("blob_url"),
        F.when(~stored, "client_id and filename are required").alias("error"),
    )


def upload_errors(uploads: DataFrame) -> DataFrame:
    """The uploads that did not succeed, as rows."""
    return uploads.filter(~F.coalesce("success", F.lit(False)))


def run_summary(documents: DataFrame, uploads: DataFrame, groups: list[str], elapsed: float = 0.0) -> DataFrame:
    """Totals of each run: documents and chunks from ``documents`` (with ``chunk_count``), results from ``uploads``.

    The per-document counts and failed uploads of a run are as many as its files; they stay tables
    (``per_document``, ``upload_errors``) instead of lists in this row.
    """
    loaded = documents.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("documents_processed"), F.sum("chunk_count").alias("total_chunks")
    )
    sent = uploads.groupBy(*groups).agg(
        F.count_if("success").alias("uploads_succeeded"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("uploads_failed"),
    )
    none = F.lit(0).cast("long")
    joined = loaded.join(sent, groups, "full")
    counts = ("documents_processed", "total_chunks", "uploads_succeeded", "uploads_failed")
    filled = joined.select(*groups, *[F.coalesce(c, none).alias(c) for c in counts])
    return filled.withColumn("elapsed_seconds", F.bround(F.lit(float(elapsed)), 2)).withColumn(
        "status", run_status(F.lit(False), F.col("uploads_failed"))
    )


def run_status(failed: Column, uploads_failed: Column) -> Column:
    return F.when(failed, "failed").when(uploads_failed > 0, "partial").otherwise("success")


def run_label(label: Column, client_id: Column) -> Column:
    return F.coalesce(label, F.concat(client_key(client_id), F.lit("-ingestion")))


def log_key(client_id: Column, created_at: Column) -> Column:
    stamp = F.date_format(created_at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit("meta/"), client_key(client_id), F.lit("/ingestion_"), stamp, F.lit(".json"))
