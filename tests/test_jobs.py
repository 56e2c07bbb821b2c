"""Whole jobs: ingestion, re-ingestion, deletion, rebuilding and streaming."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timezone
from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.embedding import HashingEmbedder
from corpusflow.plans import ingest, maintenance
from corpusflow.plans.ingest import Run
from corpusflow.plans.store import Store
from corpusflow.sources import long_text, manifest, sample_files
from corpusflow.streaming.folder import changed_files, stream_changes, stream_folder


def small_model():
    return HashingEmbedder(8)


small_model.model_name = "hash-8"


def other_model():
    return HashingEmbedder(4)


other_model.model_name = "hash-4"


def at(day: int, **changes) -> Run:
    values = dict(client_id=" 007 ", started=datetime(2024, 1, day, tzinfo=timezone.utc), factory=small_model)
    return Run(**{**values, **changes})


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    files = {
        "b.txt": b"\n".join(b"line %d " % i + b"x" * 80 for i in range(20)),
        "a/b.docx": sample_files.docx(["y" * 50]),
        "a/deck.pptx": sample_files.pptx([["one " * 10], [], ["two " * 10]]),
        "short.md": b"tiny",
        "blank.txt": b" \n",
        "broken.xlsx": b"?",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def chunk_keys(df):
    return sorted((r.rel_path, r.chunk_index) for r in df.collect())


def test_directory_life_cycle(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run = at(1, label="first", extra_metadata={"team": "x"})
    summary = ingest.ingest_directory(store, str(folder), run).first()
    assert (summary.status, summary.documents_processed, summary.total_chunks, summary.uploads_failed) == ("success", 4, 9, 0)
    assert summary.client_id == "007" and store.read("runs").first().run_id == run.run_id

    chunks = store.current("chunks")
    first = chunks.filter("rel_path = 'a/deck.pptx'").orderBy("chunk_index").collect()
    assert [(r.page, r.chunk_id, r.extra_metadata["team"], len(r.embedding)) for r in first] == [
        (1, "deck_chunk_0000", "x", 8),
        (3, "deck_chunk_0001", "x", 8),
    ]
    ordered = [r.rel_path for r in store.read("vectors").orderBy("vec_id").collect()]
    assert ordered == ["a/b.docx", "a/deck.pptx", "a/deck.pptx"] + ["b.txt"] * 6
    meta = {r.rel_path: r for r in store.read("document_meta").collect()}
    assert meta["a/deck.pptx"].total_pages == 2 and meta["short.md"].total_chunks == 0
    assert meta["b.txt"].blob_urls["raw"] == "raw/007/b.txt"
    log = store.read("ingestion_log").first()
    assert log.label == "first" and log.object_name == "meta/007/ingestion_20240101_000000.json"
    reasons = {r.rel_path: r.error for r in store.read("documents").filter("pages IS NULL").collect()}
    assert set(reasons) == {"blank.txt", "broken.xlsx"}

    # The same run again replaces itself; a later run of a changed file supersedes it.
    before = chunk_keys(chunks)
    ingest.ingest_directory(store, str(folder), run)
    assert chunk_keys(store.read("chunks")) == before
    (folder / "short.md").write_bytes(b"z" * 40)
    changed = changed_files(store, str(folder), "007")
    assert [r.rel_path for r in changed.select("rel_path").collect()] == ["short.md"]
    ingest.ingest_files(store, changed, at(2, replace_index=False))
    assert ("short.md", 0) in chunk_keys(store.current("chunks"))
    assert store.read("vectors").count() == 10 == store.read("vectors").select("vec_id").distinct().count()

    # Another client is untouched by what follows.
    ingest.ingest_directory(store, str(folder), at(3, client_id="other"))

    # Ids collide across folders: both files of id b go.
    targets = spark.createDataFrame([("007", "b"), ("007", "ghost")], "client_id string, doc_id string")
    report = {r.doc_id: (r.blobs_deleted, r.status) for r in maintenance.delete_documents(store, targets).collect()}
    assert report["ghost"] == (0, "not_found") and report["b"][1] == "success" and report["b"][0] == 4
    mine = F.col("client_id") == "007"
    assert not {"b.txt", "a/b.docx"} & {r.rel_path for r in store.current("chunks").filter(mine).collect()}
    maintenance.compact(store)
    assert store.deleted().count() == 0
    for table in ("raw_files", "documents", "chunks", "vectors", "document_meta"):
        left = store.read(table)
        assert left.filter(mine & F.col("rel_path").isin("b.txt", "a/b.docx")).count() == 0
        assert left.filter(mine).count() > 0 and left.filter(~mine & F.col("rel_path").isin("b.txt")).count() > 0

    # Rebuilding with another model replaces vectors, skips what has none to replace, and spares the other client.
    actions = {r.doc_id: r.action for r in maintenance.rebuild(store, "007", factory=other_model).collect()}
    assert actions == {"deck": "rebuilt", "short": "rebuilt"}
    sizes = {(r.client_id, len(r.embedding)) for r in store.current("chunks").collect()}
    assert sizes == {("007", 4), ("other", 8)}
    assert {len(r.embedding) for r in store.current("vectors").filter(mine).collect()} == {4}
    missing = maintenance.rebuild(store, "007", doc_id="ghost", factory=other_model).collect()
    assert [(r.doc_id, r.action) for r in missing] == [("ghost", "error")]


def stored_files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_rebuilding_one_document_writes_its_rows_only(spark, folder, tmp_path):
    root = tmp_path / "store"
    store = Store(spark, str(root))
    ingest.ingest_directory(store, str(folder), at(1))
    before = stored_files(root)
    maintenance.rebuild(store, "007", doc_id="deck", factory=other_model)
    after = stored_files(root)
    assert before.items() <= after.items() and {p.parts[len(root.parts)] for p in after.keys() - before.keys()} == {"renewed"}
    renewed = spark.read.parquet(store.path("renewed"))
    assert {(r.rel_path, r.chunk_id) for r in renewed.collect()} == {("a/deck.pptx", f"deck_chunk_000{i}") for i in range(2)}

    def sizes(table):
        return {(r.rel_path, len(r.embedding)) for r in table.collect()}

    others = {("a/b.docx", 8), ("b.txt", 8)}
    for table in ("chunks", "vectors"):
        assert sizes(store.current(table)) == others | {("a/deck.pptx", 4)}
        assert sizes(store.read(table)) == others | {("a/deck.pptx", 8)}
    # A model that chunks bear already is not run again; the newest version holds; compaction folds it in.
    maintenance.rebuild(store, "007", doc_id="deck", factory=other_model)
    assert stored_files(root) == after
    maintenance.rebuild(store, "007", doc_id="deck", factory=small_model)
    assert sizes(store.current("vectors")) == others | {("a/deck.pptx", 8)}
    maintenance.rebuild(store, "007", doc_id="b", factory=other_model)
    whole = {t: sorted(map(str, store.current(t).collect())) for t in ("chunks", "vectors")}
    maintenance.compact(store)
    assert store.renewals().count() == 0
    for table, rows in whole.items():
        assert sorted(map(str, store.current(table).collect())) == rows == sorted(map(str, store.read(table).select(*store.current(table).columns).collect()))
    # A run that is repeated makes its chunks anew, and what was embedded again before is void.
    maintenance.rebuild(store, "007", factory=other_model)
    ingest.ingest_directory(store, str(folder), at(1))
    assert sizes(store.current("chunks")) == others | {("a/deck.pptx", 8)}


def test_failed_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "e").mkdir()
    assert ingest.ingest_directory(store, str(tmp_path / "none"), at(1)).first().status == "failed"
    assert "No supported" in ingest.ingest_directory(store, str(tmp_path / "e"), at(1)).first().error
    assert "client_id" in ingest.ingest_directory(store, str(tmp_path / "e"), at(1, client_id=" ")).first().error
    assert ingest.ingest_directory(store, "", at(1)).first().error == "source_path is required"
    (tmp_path / "e" / "a.txt").write_text("tiny")
    assert "no chunks" in ingest.ingest_directory(store, str(tmp_path / "e"), at(1)).first().error


def test_single_file(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = ingest.ingest_file(store, str(folder / "b.txt"), at(1, source_type="upload")).first()
    assert (row.filename, row.doc_id, row.status, row.total_chunks) == ("b.txt", "b", "success", 6)
    assert ingest.ingest_file(store, str(folder / "short.md"), at(2, client_id="")).first().error == "client_id is required"
    (folder / "x.py").write_text("x")
    assert "Unsupported" in ingest.ingest_file(store, str(folder / "x.py"), at(2)).first().error
    assert "not found" in ingest.ingest_file(store, str(folder / "no.txt"), at(2)).first().error


def test_drive_and_sharepoint_jobs(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    items = spark.createDataFrame(
        [("f", "root", "a", manifest.FOLDER_MIME), ("1", "f", "b.docx", "x"), ("2", "root", "lost.pdf", "x"), ("3", "root", "pic.png", "x")],
        "id string, parent_id string, name string, mime string",
    )
    done = ingest.ingest_drive(store, "job1", items, "root", str(folder), at(1, source_type="google_drive")).first()
    assert done.status == "success"
    assert [r.rel_path for r in store.read("missing_files").collect()] == ["lost.pdf"]
    empty = items.filter("id = '3'")
    failed = ingest.ingest_drive(store, "job2", empty, "root", str(folder), at(2)).first()
    assert "No supported files" in failed.error
    library = spark.createDataFrame(
        [("1", "root", "b.txt", False, "u")], "id string, parent_id string, name string, is_folder boolean, download_url string"
    )
    ingest.ingest_sharepoint(store, "job3", library, "root", str(folder), at(3))
    from corpusflow.operators.catalog import job_status, lookup_jobs

    jobs = spark.read.parquet(store.path("jobs"))
    assert {r.request_id: r.status for r in job_status(jobs).collect()} == {"job1": "done", "job2": "error", "job3": "done"}
    asked = spark.createDataFrame([("job9",)], "request_id string")
    assert lookup_jobs(asked, jobs).first().status == "not_found"


@contextmanager
def setting(spark, **values):
    kept = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_large_file_stops_nothing(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (folder / "big.json").write_text(str(list(range(3000))))
    (folder / "big.txt").write_text("big words here\n" * 400)
    with setting(spark, spark__sql__sources__binaryFile__maxLength=3000):
        done = ingest.ingest_directory(store, str(folder), at(1)).first()
    assert done.status == "partial" and done.total_chunks > 0
    reasons = {r.rel_path: r.error for r in store.read("documents").filter("pages IS NULL").collect()}
    assert reasons["big.json"] == ingest.TOO_LARGE and "big.txt" not in reasons
    failed = {r.rel_path: r.error for r in store.read("uploads").filter("NOT success").collect()}
    assert failed["big.json"] == ingest.TOO_LARGE and failed["big.txt"] == ingest.NOT_ARCHIVED
    assert len(failed) == done.uploads_failed
    text = "\n".join(r.text for r in store.current("chunks").filter("rel_path = 'big.txt'").orderBy("chunk_index").collect())
    assert text.count("big words here") >= 400


def test_folder_of_files_too_large_only(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    root.mkdir()
    (root / "big.json").write_text(str(list(range(3000))))
    with setting(spark, spark__sql__sources__binaryFile__maxLength=3000):
        row = ingest.ingest_directory(store, str(root), at(1)).first()
    assert (row.status, row.error) == ("failed", ingest.NO_DOCUMENTS)
    assert [(r.rel_path, r.error) for r in store.read("documents").collect()] == [("big.json", ingest.TOO_LARGE)]
    ingest.ingest_directory(store, str(tmp_path / "none"), at(2, client_id=" "))
    listed = spark.read.parquet(store.path("failed_runs")).orderBy("run_id").collect()
    assert [(r.client_id, r.error) for r in listed] == [("007", ingest.NO_DOCUMENTS), ("", ingest.BAD_FOLDER.format(tmp_path / "none"))]


def test_text_read_in_splits_gives_the_chunks_of_one_pass(spark, tmp_path):
    root = tmp_path / "in"
    lines = ["word " * (i % 23) + f"é{i}" for i in range(600)]
    contents = {
        "plain.txt": "\n".join(lines).encode(),
        "sub/a [1].txt": ("\ufeff" + "\r\n".join(lines)).encode(),
        "latin.rst": "\r".join(lines).encode("latin-1"),
        "notes.md": b"\n".join(x.encode() + b"\xe2\x82" for x in lines),
        "code+1.PY": ("\n\n" + "\n".join(lines)).encode(),
        "blank.txt": b" \n" * 500,
        "blank.py": b" \n" * 500,
        "table.csv": ("name,note\n" + "".join(f'{x},"{i}\nof"\n' for i, x in enumerate(lines))).encode(),
        "table.tsv": ("name\tnote\n" + "".join(f"{x}\t{i}\n" for i, x in enumerate(lines))).encode(),
        "small.txt": b"y" * 50,
    }
    for name, content in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "wide.txt").write_bytes(("x" * 700).encode("utf-16"))
    (root / "ragged.csv").write_text("a,b\n" + "1,2,3\n" * 200 + "fine enough to make a chunk of more than thirty,2\n")
    stores = []
    for k, above in enumerate((None, 1000)):
        store = Store(spark, str(tmp_path / f"store{k}"))
        with setting(spark, spark__sql__files__maxPartitionBytes=2000, spark__sql__files__openCostInBytes=0):
            summary = ingest.ingest_directory(store, str(root), at(1, split_above=above)).first()
        stores.append((store, summary))

    def chunks(store):
        rows = store.current("chunks").select("rel_path", "chunk_id", "page", "text", "char_count", "embedding").collect()
        return sorted((r.rel_path, r.chunk_id, r.page, r.text, r.char_count, tuple(r.embedding)) for r in rows)

    whole, split = ([c for c in chunks(s) if c[0] not in ("wide.txt", "ragged.csv")] for s, _ in stores)
    assert whole == split and len({c[0] for c in whole}) == len(contents) - 2
    store, summary = stores[1]
    reasons = {r.rel_path: r.error for r in store.read("documents").filter("pages IS NULL").collect()}
    assert reasons == {"blank.txt": "no text", "blank.py": "no text", "wide.txt": long_text.UTF16}
    errors = store.read("line_errors").filter("rel_path = 'ragged.csv'").collect()
    assert sorted(r.pos for r in errors) == list(range(200)) and {r.error for r in errors} == {"2 columns expected, 3 found"}
    assert [c[3] for c in chunks(store) if c[0] == "ragged.csv"] == ["a: fine enough to make a chunk of more than thirty | b: 2"]
    assert summary.total_chunks == len(chunks(store)) and summary.status == "partial"
    assert [r.vec_id for r in store.current("vectors").orderBy("vec_id").collect()] == list(range(summary.total_chunks))


def test_a_model_needs_a_name(spark):
    with pytest.raises(ValueError, match="name the model"):
        at(1, factory=lambda: HashingEmbedder(2)).model_key
    assert at(1, factory=lambda: HashingEmbedder(2), model="two").model_key == "two"


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    start = partial(stream_folder, store, str(folder), str(tmp_path / "cp"), at(1), files_per_batch=2)
    start().awaitTermination()
    first = chunk_keys(store.current("chunks"))
    assert len(first) == 9 and store.read("vectors").count() == 9
    (folder / "new.txt").write_text("n" * 50)
    start().awaitTermination()
    assert chunk_keys(store.current("chunks")) == sorted([*first, ("new.txt", 0)])
    assert sorted(r.vec_id for r in store.read("vectors").collect()) == list(range(10))


def test_stream_of_versions(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    start = partial(stream_changes, store, str(folder), str(tmp_path / "cp"), at(1))
    (folder / "_hidden.txt").write_text("h" * 40)
    start().awaitTermination()
    first = chunk_keys(store.current("chunks"))
    assert len(first) == 10 and ("_hidden.txt", 0) in first
    seen = store.read("documents").count()
    # Nothing new: no run. Then one file is rewritten, one turns blank and one is new.
    start().awaitTermination()
    assert store.read("documents").count() == seen
    (folder / "b.txt").write_text("rewritten " * 5)
    (folder / "_hidden.txt").write_text("")
    (folder / "new.txt").write_text("n" * 50)
    start().awaitTermination()
    assert store.read("documents").count() == seen + 3
    rest = [k for k in first if k[0] not in ("b.txt", "_hidden.txt")]
    assert chunk_keys(store.current("chunks")) == sorted([*rest, ("b.txt", 0), ("new.txt", 0)])
    assert store.current("chunks").filter("rel_path = 'b.txt'").first().text == ("rewritten " * 5).strip()
