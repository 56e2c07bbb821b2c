"""Text that a row could hold, but that is read in splits and archived in pieces."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import partial
from hashlib import sha256

import pytest

from corpusflow.operators.embedding import HashingEmbedder
from corpusflow.plans import ingest, maintenance
from corpusflow.plans.store import Store
from corpusflow.streaming.folder import changed_files, stream_changes

TEXT = "\n".join("word " * (i % 23) + f"é{i}" for i in range(600)).encode()


def at(day):
    started = datetime(2024, 1, day, tzinfo=timezone.utc)
    return ingest.Run("a", started=started, factory=partial(HashingEmbedder, 4), model="four")


def chunks(store):
    rows = store.current("chunks").select("rel_path", "chunk_id", "page", "text", "char_count").collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, content in {
        "big.txt": TEXT, "other.md": TEXT, "_big.txt": TEXT, "wide.txt": TEXT.decode().encode("utf-16"),
        "big.json": b'{"a": "' + b"x" * 5000 + b'"}', "small.txt": b"y" * 50,
    }.items():
        (root / name).write_bytes(content)
    return root


def test_large_text_is_archived_in_pieces(spark, root, tmp_path, monkeypatch):
    whole, parted = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "parted"))
    assert ingest.ingest_directory(whole, str(root), at(1)).first().status == "success"
    monkeypatch.setattr(ingest, "SPLIT_BYTES", 4000)
    monkeypatch.setattr(ingest, "PART_BYTES", 1000)
    done = ingest.ingest_directory(parted, str(root), at(1)).first()
    assert done.status == "success" and done.uploads_succeeded == 6 and done.uploads_failed == 0
    assert chunks(parted) == chunks(whole) and {c[0] for c in chunks(whole)} == {p.name for p in root.iterdir()}
    assert not parted.read("documents").filter("pages is null").count()
    pieces = {}
    for r in parted.read("raw_parts").orderBy("rel_path", "part").collect():
        assert len(r.content) <= 1000 and r.sha256 == sha256(TEXT).hexdigest()
        pieces[r.rel_path] = pieces.get(r.rel_path, b"") + r.content
    assert pieces == {"big.txt": TEXT, "other.md": TEXT}
    kept = {r.rel_path for r in parted.read("raw_files").select("rel_path").collect()}
    assert kept == {"_big.txt", "wide.txt", "big.json", "small.txt"}
    lines = parted.read("document_lines").filter("rel_path = 'big.txt'").orderBy("pos").collect()
    assert "\n".join(r.line for r in lines) == TEXT.decode()
    assert changed_files(parted, str(root), "a").count() == 0
    maintenance.delete_documents(parted, spark.createDataFrame([("a", "big")], "client_id string, doc_id string"))
    maintenance.compact(parted)
    assert not parted.read("raw_parts").filter("source_file = 'big.txt'").count() and parted.read("raw_parts").count()


def test_streams_do_not_open_what_is_read_in_splits(spark, root, tmp_path, monkeypatch):
    whole, parted = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "parted"))
    stream_changes(whole, str(root), str(tmp_path / "cp1"), at(1)).awaitTermination()
    monkeypatch.setattr(ingest, "SPLIT_BYTES", 4000)
    stream_changes(parted, str(root), str(tmp_path / "cp2"), at(1)).awaitTermination()
    assert chunks(parted) == chunks(whole)
    assert {r.rel_path for r in parted.read("raw_parts").collect()} == {"big.txt", "other.md"}
