"""Questions about, and changes to, what is stored: objects, documents, chunks and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import preview
from corpusflow.sources.objects import with_prefix

# The key prefixes of stored objects, in report order.
PREFIXES = ("raw/", "chunks/", "meta/", "faiss/")


def storage_status(objects: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """Object count and total bytes per prefix (``name``, ``size_bytes``), zeros for an empty one.

    The objects shrink to a row per prefix before they meet the prefix list.
    """
    matched = F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("name"), p))
    sums = (
        objects.select(F.explode(matched).alias("prefix"), "size_bytes")
        .groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))
    )
    listed = objects.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return listed.join(sums, "prefix", "left").select(
        "prefix",
        F.coalesce("n", F.lit(0)).alias("blob_count"),
        F.coalesce("bytes", F.lit(0)).alias("total_bytes"),
    )


def list_documents(meta: DataFrame, url: Column) -> DataFrame:
    """The listing of documents; ``total`` of the response is this table's row count."""
    return meta.select(
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.coalesce("source_file", F.lit("")).alias("source_file"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("processed_at", F.lit("")).alias("processed_at"),
        url.alias("blob_url_meta"),
    )


def get_document(meta: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Document metadata with chunk previews, one row per chunk.

    A document without chunks has one row with null chunk columns; one without metadata has none (not found).
    Filter either input by document first: the filter reaches the scan. An outer join could not split the chunks of a
    document that holds most of them, so the two cases stand apart: chunks with metadata, joined so that they can be
    split, and metadata that counts no chunks, which needs none of them.
    """
    details = ["chunk_id", "chunk_index", "page", "char_count"]
    summaries = chunks.select(*keys, *details, preview(F.col("text")).alias("text_preview"))
    described = summaries.join(meta, keys).select(*meta.columns, *details, "text_preview")
    bare = meta.filter(F.coalesce("total_chunks", F.lit(0)) == 0)
    return described.unionByName(bare, allowMissingColumns=True)


def get_chunks(chunks: DataFrame, doc_id=None, page: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Chunks with full text, by document and page where given; ``total`` is the row count after the filters."""
    if doc_id is not None:
        chunks = chunks.filter(F.col("doc_id") == doc_id)
    if page is not None:
        chunks = chunks.filter(F.col("page") == page)
    return chunks.select(
        *(columns or ["chunk_id", "chunk_index", "page", "char_count", "source_file", "uploaded_at", "text"])
    )


def document_objects(targets: DataFrame) -> DataFrame:
    """The keys a deletion looks for (``doc_id, client_id, source_file``): chunks and metadata, and the raw file if known."""
    folder = F.concat(F.lit("/"), "client_id", F.lit("/"))
    return targets.select(
        "client_id",
        "doc_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("chunks"), folder, "doc_id", F.lit("_chunks.jsonl")),
                    F.concat(F.lit("meta"), folder, "doc_id", F.lit("_meta.json")),
                    F.concat(F.lit("raw"), folder, F.nullif("source_file", F.lit(""))),
                )
            )
        ).alias("name"),
    )


def delete_report(targets: DataFrame, objects: DataFrame) -> DataFrame:
    """Per document to delete: how many of its objects exist, and the outcome. Object names are unique."""
    found = document_objects(targets).distinct().join(objects.select("name"), "name")
    counts = found.groupBy("client_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    deleted = F.coalesce("n", F.lit(0))
    return (
        targets.select("client_id", "doc_id")
        .distinct()
        .join(counts, ["client_id", "doc_id"], "left")
        .select(
            "client_id",
            "doc_id",
            deleted.alias("blobs_deleted"),
            F.when(deleted == 0, "not_found").otherwise("success").alias("status"),
            # The two messages.
            F.when(deleted == 0, F.concat(F.lit("No blobs found for doc_id '"), "doc_id", F.lit("'.")))
            .otherwise(
                F.concat(F.lit("Deleted "), deleted.cast("string"), F.lit(" blob(s) for '"), "doc_id", F.lit("'."))
            )
            .alias("message"),
        )
    )


def without_documents(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that stay once the target documents are deleted."""
    return rows.join(targets.select(*keys), keys, "left_anti")


def without_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.filter(~F.startswith(F.col("name"), F.lit(prefix)))


def delete_prefix_count(objects: DataFrame, prefix: str) -> DataFrame:
    return with_prefix(objects, prefix).agg(F.count(F.lit(1)).alias("deleted"))


def rebuild_classes(meta: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """What a rebuild does with each document: ``rebuild`` where it has chunks, else ``skipped``.

    Documents with a blank id are left out. ``chunks`` shrinks to one row per document before the shuffle.
    """
    present = chunks.select(*keys).distinct().withColumn("_has", F.lit(True))
    named = meta.filter(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) != "")
    return named.select(*keys).join(present, keys, "left").select(
        *keys, F.when(F.col("_has"), "rebuild").otherwise("skipped").alias("action")
    )


def rebuild_status(outcomes: DataFrame) -> DataFrame:
    """Totals and overall status of a rebuild from one row per document with ``action`` rebuilt, skipped or error."""
    counted = outcomes.agg(
        *[F.count_if(F.col("action") == a).alias(n) for a, n in
          (("rebuilt", "rebuilt"), ("skipped", "skipped"), ("error", "errors"))]
    )
    return counted.withColumn(
        "status",
        F.when(F.col("errors") == 0, "success").when(F.col("rebuilt") > 0, "partial").otherwise("error"),
    )


def exact_duplicates(rows: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """``order`` columns, ``kept`` and ``first``: whether a row is the first with its content by ``order``, and which is.

    Only fingerprints and ``order`` travel, and the first of each fingerprint combines before the shuffle. Rows without
    content have the fingerprint of the empty text.
    """
    bytes_ = F.coalesce(content, F.lit("")).cast("binary")
    printed = rows.select(*order, F.sha2(bytes_, 256).alias("_print"))
    firsts = printed.groupBy("_print").agg(F.min(F.struct(*order)).alias("first"))
    return printed.join(firsts, "_print").select(*order, (F.struct(*order) == F.col("first")).alias("kept"), "first")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key. An aggregate, so all but one row per key and task stay off the network."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (*order, *others)])


def job_status(events: DataFrame) -> DataFrame:
    """The current state of each job from its events: ``request_id, seq, status, detail``.

    ``seq`` grows with each event of a job.
    """
    return latest(events.select("request_id", "seq", "status", "detail"), ["request_id"], ["seq"]).drop("seq")


def lookup_jobs(asked: DataFrame, events: DataFrame) -> DataFrame:
    """The state of the asked jobs; an unknown one is ``not_found``."""
    return asked.join(job_status(events), "request_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("not_found"))
    )


def doc_id_collisions(documents: DataFrame, groups: list[str]) -> DataFrame:
    """Ids shared by several files of a client, with the first and last path."""
    return (
        documents.groupBy(*groups, "doc_id")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min("rel_path").alias("first_path"),
            F.max("rel_path").alias("last_path"),
        )
        .filter("files > 1")
    )
