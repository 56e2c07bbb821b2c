"""Chunk records, document metadata, run reports and catalogue questions."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from corpusflow.functions import text
from corpusflow.operators import catalog, metadata
from corpusflow.sources import records

CHUNK = (
    "doc_id string, chunk_id string, chunk_index long, page long, text string, source_file string, source_type string, "
    "uploaded_at string, char_count int, embedding array<float>, extra_metadata map<string,string>"
)


def chunk(**changes):
    base = dict(
        doc_id="d", chunk_id="d_chunk_0001", chunk_index=1, page=2, text='é "q"\n', source_file="d.txt",
        source_type="local", uploaded_at="2024", char_count=6, embedding=None, extra_metadata=None,
    )
    return tuple({**base, **changes}.values())


def test_json_record(spark):
    rows = [
        chunk(),
        chunk(embedding=[0.5, 1.0], extra_metadata={"k": "v", "embedding": "no"}),
        chunk(extra_metadata={"page": "seven", "k": "v"}),
    ]
    lines = [r.j for r in spark.createDataFrame(rows, CHUNK).select(metadata.chunk_json().alias("j")).collect()]
    first, second, third = map(json.loads, lines)
    assert list(first) == ["doc_id", "chunk_id", "chunk_index", "page", "text", "source_file", "source_type", "uploaded_at", "char_count", "embedding"]
    assert first["text"] == 'é "q"\n' and first["embedding"] is None and "é" in lines[0]
    assert second["k"] == "v" and second["embedding"] == [0.5, 1.0] and list(second)[-1] == "embedding"
    assert third["page"] == "seven" and third["chunk_index"] == 1 and list(third)[3] == "page"


def test_reading_skips_bad_lines_and_keeps_unknown_keys(spark):
    lines = ["", "  ", "{bad", "[1]", "{}", '{"doc_id":"a","chunk_index":12,"k":{"x":1},"char_count":99,"text":"abc"}']
    rows = metadata.parse_chunk_lines(spark.createDataFrame([(v,) for v in lines], "value string")).orderBy("doc_id").collect()
    assert len(rows) == 2
    assert rows[0].chunk_id == "a_chunk_0012" and rows[0].char_count == 3 and json.loads(rows[0].extra_metadata["k"]) == {"x": 1}
    assert rows[1].chunk_id == "unknown_chunk_0000" and rows[1].source_type == "local" and rows[1].uploaded_at is None


def test_round_trip(spark):
    source = spark.createDataFrame([chunk(embedding=[0.1, 0.25], extra_metadata={"a": "b"})], CHUNK)
    read = metadata.parse_chunk_lines(source.select(metadata.chunk_json().alias("value")))
    assert read.select(*source.columns).collect() == source.collect()


def test_full_text(spark):
    pages = spark.createDataFrame([("d", p, f"t{p}" if p % 3 else "") for p in range(1, 11)], "doc string, page int, text string")
    rows = metadata.full_text_pages(pages.repartition(4), ["doc"]).orderBy("page").collect()
    assert [r.full_text for r in rows] == ["t1", "t2", "t4", "t5", "t7", "t8", "t10"]
    gathered = pages.repartition(4).groupBy("doc").agg(F.collect_list(F.struct("page", "text")).alias("pages"))
    assert gathered.select(metadata.full_text(F.col("pages"))).first()[0] == "t1\nt2\nt4\nt5\nt7\nt8\nt10"
    many = spark.range(1, 3001).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.lit("x").alias("text"))
    assert metadata.full_text_pages(many, ["doc"]).count() == 3000


def test_documents_without_chunks_are_counted(spark):
    docs = spark.createDataFrame([("r", "a"), ("r", "b")], "run string, doc string")
    counts = metadata.per_document(docs, spark.createDataFrame([("a",), ("a",)], "doc string"), ["doc"])
    assert {(r.doc, r.chunk_count) for r in counts.collect()} == {("a", 2), ("b", 0)}


def test_run_summary_without_uploads_or_documents(spark):
    docs = spark.createDataFrame([("a", 2), ("a", 3)], "run string, chunk_count long")
    sent = spark.createDataFrame([("b", True), ("b", None)], "run string, success boolean")
    got = {r.run: r for r in metadata.run_summary(docs, sent, ["run"], 2.345).collect()}
    assert (got["a"].documents_processed, got["a"].total_chunks, got["a"].uploads_failed, got["a"].status) == (2, 5, 0, "success")
    assert (got["b"].documents_processed, got["b"].uploads_succeeded, got["b"].uploads_failed, got["b"].status) == (0, 1, 1, "partial")


def test_document_without_chunks(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    chunks = spark.createDataFrame([("a", "a_chunk_0000", 0, 1, 40, "x" * 300)], "doc_id string, chunk_id string, chunk_index int, page int, char_count int, text string")
    meta = metadata.document_meta(docs, chunks, ["doc_id"], F.lit("now"))
    assert {r.doc_id: (r.total_chunks, r.total_chars) for r in meta.collect()} == {"a": (1, 40), "b": (0, 0)}
    got = {r.doc_id: r for r in catalog.get_document(meta, chunks, ["doc_id"]).collect()}
    assert len(got["a"].text_preview) == 200 and got["b"].chunk_id is None


def test_status_keeps_empty_prefixes(spark):
    stored = spark.createDataFrame([("raw/a", 5), ("raw/b", None), ("other/c", 9)], "name string, size_bytes long")
    got = {r.prefix: (r.blob_count, r.total_bytes) for r in catalog.storage_status(stored).collect()}
    assert got == {"raw/": (2, 5), "chunks/": (0, 0), "meta/": (0, 0), "faiss/": (0, 0)}


def test_latest_breaks_ties_by_the_last_order_column(spark):
    rows = spark.createDataFrame([("k", 1, 1, "a"), ("k", 1, 2, "b"), ("k", 0, 9, "c")], "k string, t int, n int, v string")
    assert catalog.latest(rows, ["k"], ["t", "n"]).first().v == "b"


def test_rebuild_outcomes(spark):
    meta = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "doc_id string")
    chunks = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    got = {r.doc_id: r.action for r in catalog.rebuild_classes(meta, chunks, ["doc_id"]).collect()}
    assert got == {"a": "rebuild", "b": "skipped"}
    for actions, status in ((["rebuilt", "skipped"], "success"), (["rebuilt", "error"], "partial"), (["error"], "error"), ([], "success")):
        outcomes = spark.createDataFrame([(a,) for a in actions], "action string")
        assert catalog.rebuild_status(outcomes).first().status == status


def test_record_files(spark, tmp_path):
    source = spark.createDataFrame([("c1", *chunk(embedding=[0.5])), ("c2", *chunk(doc_id="e"))], "client_id string, " + CHUNK)
    records.write_chunks(source, str(tmp_path / "chunks"))
    read = records.read_chunks(spark, str(tmp_path / "chunks"))
    assert {(r.doc_id, r.text, r.embedding and tuple(r.embedding)) for r in read.collect()} == {("d", 'é "q"\n', (0.5,)), ("e", 'é "q"\n', None)}

    folder = tmp_path / "meta" / "acme"
    folder.mkdir(parents=True)
    (folder / "a_meta.json").write_text('{\n "doc_id": "a", "total_chunks": 3,\n "blob_urls": {"raw": "u"}, "other": 1}')
    (folder / "b_meta.json").write_text("{broken")
    (folder / "ingestion_1.json").write_text('{"doc_id": "no"}')
    meta = records.read_document_meta(spark, str(tmp_path / "meta")).collect()
    assert [(r.doc_id, r.total_chunks, r.blob_urls) for r in meta] == [("a", 3, {"raw": "u"})]


def test_iso_time_is_utc_in_any_session_zone(spark):
    moments = [datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 7, 1, 12, 0, 0, 250, tzinfo=timezone.utc)]
    times = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        frame = times.select(text.utc_iso(F.col("t")).alias("s"))
        assert [r.s for r in frame.collect()] == [m.isoformat() for m in moments]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
