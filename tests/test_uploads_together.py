"""Uploads of several clients at a time."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256

from corpusflow.plans import ingest, queries
from corpusflow.plans.store import _WRITERS, Store


def test_clients_upload_side_by_side(spark, tmp_path, monkeypatch):
    texts = {i: f"text {i} " + "x" * 200 for i in range(120)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "_UPLOAD_BYTES", 4000)
    met, plain = threading.Barrier(2, timeout=100), ingest.ingest_file
    order: dict = {}

    def watched(store, path, run):
        if run.suffix == "0" and run.client in ("acme0", "acme1"):
            met.wait()  # broken, if the second client starts when the first is done
        order.setdefault(run.client, []).append(run.suffix)
        return plain(store, path, run)

    monkeypatch.setattr(ingest, "ingest_file", watched)
    before = spark.conf.get(_WRITERS)
    found = queries.QUERIES["ingest_file"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.select("doc_id", "sha256", "filename", "status").collect())
    assert got == [(i, sha256(t.encode()).hexdigest(), f"part{i % 4}.txt", "success") for i, t in texts.items()]
    assert len(order) > 1 and all(o == ["0", "1", "2", "3"] for o in order.values())
    assert spark.conf.get(_WRITERS) == before


def test_vector_ids_go_on_within_a_client(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(f"line {i} of {name} with some words" for i in range(100)))

    def uploads(client):
        for k, name in enumerate(("a.txt", "b.txt")):
            run = ingest.Run(client, started=queries._RUN_TIME, suffix=str(k), replace_index=False)
            assert ingest.ingest_file(store, str(tmp_path / name), run).first().status == "success"

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(uploads, ("x", "y", "z")))
    ids = {}
    for r in store.current("vectors").select("client_id", "vec_id").collect():
        ids.setdefault(r.client_id, []).append(r.vec_id)
    assert set(ids) == {"x", "y", "z"} and all(sorted(v) == list(range(len(v))) for v in ids.values())


def test_appends_from_threads_all_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: store.append("jobs", spark.range(i, i + 1)), range(12)))
    assert sorted(r.id for r in spark.read.parquet(store.path("jobs")).collect()) == list(range(12))
