"""Copies of large text that a run makes on the way, and rows that need not move."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.embedding import HashingEmbedder
from corpusflow.operators.ordinals import running_total, running_total_of_runs
from corpusflow.operators.tabular import chunk_lines
from corpusflow.plans import ingest, maintenance
from corpusflow.plans.store import Store
from corpusflow.session import scratch_path
from corpusflow.sources import delimited

TEXT = "\n".join("word " * (i % 23) + f"line {i}" for i in range(800)).encode()


def at(day):
    started = datetime(2024, 1, day, tzinfo=timezone.utc)
    return ingest.Run("a", started=started, factory=partial(HashingEmbedder, 4), model="four")


def scratch(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "SPLIT_BYTES", 4000)
    root = tmp_path / "in"
    root.mkdir()
    for name in ("big.txt", "other.txt"):
        (root / name).write_bytes(TEXT)
    made = Store(spark, str(tmp_path / "store"))
    spark_scratch = scratch(spark)
    assert ingest.ingest_directory(made, str(root), at(1)).first().status == "success"
    made_here = {n.rsplit("-", 1)[0] for n in scratch(spark) - spark_scratch}
    # No copy of the text is left beside the tables; checkpoints hold short rows only.
    assert not made_here & {"long", "long-lines", "long-chunks", "lines", "split", "text"}
    return made


def test_no_copy_of_the_text_outlives_its_use(spark, store):
    lines = store.read("document_lines").filter("rel_path = 'big.txt'").orderBy("pos").collect()
    assert "\n".join(r.line for r in lines) == TEXT.decode()
    files = [f for _, _, names in os.walk(store.path("chunks")) for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)


def test_what_is_gone_travels_to_the_rows(spark, store):
    maintenance.delete_documents(store, spark.createDataFrame([("a", "big")], "client_id string, doc_id string"))
    current = store.current("chunks")
    assert "SortMergeJoin" not in plan(current) and {r.rel_path for r in current.collect()} == {"other.txt"}


def test_vectors_are_folded_into_their_own_documents_only(spark, store):
    before = {r.chunk_id: tuple(r.embedding) for r in store.current("chunks").collect()}
    held = scratch(spark)
    maintenance.rebuild(store, "a", doc_id="big", factory=partial(HashingEmbedder, 8), model="eight")
    shown = {r.chunk_id: tuple(r.embedding) for r in store.current("chunks").collect()}
    maintenance.compact(store)
    rows = store.read("chunks").collect()
    assert {r.chunk_id: tuple(r.embedding) for r in rows} == shown
    assert all(len(r.embedding) == (8 if r.rel_path == "big.txt" else 4) for r in rows)
    assert {c: v for c, v in shown.items() if c.startswith("other")} == {c: v for c, v in before.items() if c.startswith("other")}
    assert not {n.rsplit("-", 1)[0] for n in scratch(spark) - held} & {"fold", "fold-names", "rewrite-chunks", "affected-chunks"}


def test_many_documents_are_folded_alike(spark, store, monkeypatch):
    monkeypatch.setattr(maintenance, "FEW", 0)
    maintenance.rebuild(store, "a", doc_id="big", factory=partial(HashingEmbedder, 8), model="eight")
    maintenance.compact(store)
    assert all(len(r.embedding) == (8 if r.rel_path == "big.txt" else 4) for r in store.read("chunks").collect())


@pytest.mark.parametrize("order", ["pos", "-pos", "rand(3)", "pos % 7, pos"])
def test_totals_of_runs_equal_plain_totals(spark, order):
    rows = spark.range(600).select(
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("g"), (F.col("id") + F.when(F.col("id") > 300, 5).otherwise(0)).alias("pos"),
        (F.col("id") % 4).alias("n"),
    )
    rows = rows.union(spark.sql("select 'f0', null, 9L union all select null, 3L, 9L")).repartition(3).sortWithinPartitions("g", *[F.expr(o) for o in order.split(", ")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = running_total_of_runs(rows, "g", "pos", "n", "sum", scratch_path(spark, "runs")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    want = running_total(rows, ["g"], "pos", "n", "sum").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 600


def test_lines_in_runs_pack_as_others(spark):
    lines = spark.range(900).select(F.lit("f").alias("g"), F.col("id").alias("pos"), F.expr("if(id % 5 = 0, ' ', repeat('ab ', int(id % 11)))").alias("line"))
    want = {(r.chunk_index, r.text) for r in chunk_lines(lines, ["g"], size=90, block_lines=100).collect()}
    got = chunk_lines(lines, ["g"], size=90, block_lines=100, runs=scratch_path(spark, "runs"))
    assert {(r.chunk_index, r.text) for r in got.collect()} == want


def test_lines_of_splits_keep_their_places_without_moving(spark, tmp_path):
    content = b"\n".join([b"\xef\xbb\xbfone", b"", b"caf\xe9", b"x" * 300] * 50)
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_bytes(content)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        read = delimited.split_lines(spark, str(tmp_path / "in"), extensions=("txt",))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert "Exchange hashpartitioning" not in plan(read) and "Exchange rangepartitioning" not in plan(read)
    rows = read.select("rel_path", "pos", "part", F.hex("value").alias("h")).orderBy("rel_path", "pos").collect()
    for name in ("a.txt", "b.txt"):
        mine = [r for r in rows if r.rel_path == name]
        lines = content.split(b"\n")
        lines[0] = lines[0][3:]  # the reader takes the mark away
        assert [r.pos for r in mine] == list(range(200)) and [bytes.fromhex(r.h) for r in mine] == lines
        parts = [r.part for r in mine]
        assert parts == sorted(parts) and len(set(parts)) > 1
