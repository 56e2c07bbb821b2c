"""What a Python worker holds at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.operators import tabular
from corpusflow.operators.chunking import chunk_texts
from corpusflow.operators.embedding import HashingEmbedder
from corpusflow.session import bound_batches


def test_batches_of_a_session_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for given in (str(64 << 20), str(256 << 20)):
            spark.conf.set(key, given)
            bound_batches(spark)
            rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
            assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 9 << 20
        spark.conf.set(key, "1000")
        bound_batches(spark)
        assert spark.conf.get(key).rstrip("b") == "1000"
    finally:
        spark.conf.set(key, before)


def test_long_lines_make_short_blocks(spark, monkeypatch):
    lines = [f"{i} " + "word " * 700 for i in range(2000)]
    rows = spark.createDataFrame([("a", i, line) for i, line in enumerate(lines)], "g string, pos long, line string")
    blocks, explore = [], tabular._explore

    def noted(rows, groups, keys, block, size, overlap):
        blocks.append(block)
        return explore(rows, groups, keys, block, size, overlap)

    monkeypatch.setattr(tabular, "_explore", noted)
    got = tabular.chunk_lines(rows, ["g"]).orderBy("chunk_index").collect()
    assert [r.text for r in got] == chunk_texts("\n".join(lines), 500, 2)
    assert blocks[0] * 3500 < 6 << 20


def test_a_worker_remembers_a_bounded_number_of_tokens():
    model = HashingEmbedder(8)
    for at in range(0, 300_000, 1000):
        model.encode([" ".join(map(str, range(at, at + 1000)))])
    assert len(model._slots) <= 100_000
