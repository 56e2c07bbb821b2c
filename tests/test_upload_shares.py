"""Uploads that together are larger than the gate lets one file be."""

from __future__ import annotations

from functools import partial
from hashlib import sha256

from corpusflow.plans import ingest, queries


def test_every_upload_passes_the_gate(spark, tmp_path, monkeypatch):
    texts = {i: f"text {i} " + "x" * 200 for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    gate = partial(ingest.upload_gate, limit_mb=0.011)  # about 50 documents are 13.5 KB
    monkeypatch.setattr(ingest, "upload_gate", gate)
    monkeypatch.setattr(queries, "_UPLOAD_BYTES", 8000, raising=False)
    got = sorted(tuple(r) for r in queries.QUERIES["ingest_file"](spark, str(tmp_path)).select("doc_id", "sha256", "filename", "status").collect())
    assert got == [(i, sha256(t.encode()).hexdigest(), f"part{i % 4}.txt", "success") for i, t in texts.items()]
