"""Searches whose queries come in many blocks."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import vectors


def table(spark, count, dim=4):
    parts = [((F.xxhash64("id", F.lit(i)) % 1000) / 1000).cast("float") for i in range(dim)]
    return spark.range(count).select(F.col("id").alias("vec_id"), F.array(*parts).alias("embedding"))


@pytest.mark.parametrize("pivots", [False, True])
def test_jobs_do_not_grow_with_blocks_of_queries(spark, pivots):
    corpus = table(spark, 300)
    asked = corpus.withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in vectors.search(corpus, asked, 3).collect()}
    index = vectors.build_pivot_index(corpus) if pivots else None
    spark.sparkContext.setJobGroup(f"blocks-{pivots}", "a block per query")
    try:
        found = vectors.search_pivots(index, asked, 3, 1) if pivots else vectors.search(corpus, asked, 3, 1)
        got = {tuple(r) for r in found.select("query_id", "vec_id", "distance", "rank").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == whole and len(got) == 900
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{pivots}")) < 30


def test_a_task_holds_a_piece_of_the_distances():
    rng = np.random.default_rng(5)
    queries, rows = rng.normal(size=(20_000, 8)), rng.normal(size=(4096, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float32()))], names=["vec_id", "embedding"]
    )
    held = SimpleNamespace(value=(np.arange(len(queries)), queries))
    tracemalloc.start()
    try:
        hits = sum(b.num_rows for b in vectors._scan(held, 5)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert hits == 100_000 and peak < 200 << 20
