"""Embedding, vector ids and search."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import vectors
from corpusflow.operators.embedding import HashingEmbedder, embed, unit_rows, unit_vector


class LengthModel:
    name = "lengths"

    def __init__(self):
        self.calls = []

    def encode(self, texts):
        assert 0 < len(texts) <= 4
        return np.array([[len(t), 1.0] for t in texts])


def test_any_model_gives_unit_rows_in_place(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(50)] + [(50, None)], "id int, text string").repartition(3)
    for r in embed(rows, factory=LengthModel, batch_size=4).collect():
        n = math.hypot(len(r.text or ""), 1)
        assert r.embedding == pytest.approx([len(r.text or "") / n, 1 / n], abs=1e-6)


def test_hashing_embedder_is_deterministic_and_normalised(spark):
    model = HashingEmbedder(16)
    first = model.encode(["a b a", "", "A  B a"])
    assert (first[0] == first[2]).all() and not first[1].any() and np.abs(first[0]).sum() in (1.0, 3.0)
    unit = unit_rows(first)
    assert unit.dtype == np.float32 and np.linalg.norm(unit[0]) == pytest.approx(1) and not unit[1].any()


def test_unit_vector_column(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>")
    got = {r.id: r.u for r in rows.select("id", unit_vector(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def brute(corpus, queries, k):
    out = set()
    for q, v in queries:
        ranked = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 9), i) for i, w in corpus)
        out |= {(q, i, rank) for rank, (_, i) in enumerate(ranked[:k], start=1)}
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 1000])
def test_search_is_exact_with_copies(spark, block_bytes):
    rng = np.random.default_rng(3)
    corpus = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(200)]  # many equal vectors
    corpus += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(100)]
    queries = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(40)]
    left = spark.createDataFrame(corpus, "vec_id long, embedding array<float>").repartition(5)
    right = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.search(left, right, 7, block_bytes).collect()}
    assert got == brute(corpus, queries, 7)


def test_search_with_fewer_vectors_than_asked_for(spark):
    left = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>")
    right = spark.createDataFrame([(7, [2.0])], "query_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.search(left, right, 3).collect()] == [(7, 1, 4.0, 1)]
    assert vectors.search(left, right.filter("false"), 3).count() == 0


def test_vector_ids_follow_path_parts_and_chunk_order(spark):
    files = ["a/b.txt", "a.txt", "b", "a/z"]
    rows = [(c, f, i) for c in ("x", "y") for f in files for i in range(len(f))]
    df = spark.createDataFrame(rows, "client_id string, rel_path string, chunk_index int").repartition(4)
    out = vectors.assign_vector_ids(df, ["client_id"], "rel_path", [F.split("rel_path", "/")])
    got = [(r.rel_path, r.chunk_index) for r in out.filter("client_id = 'y'").orderBy("vec_id").collect()]
    assert got == sorted(((f, i) for c, f, i in rows if c == "y"), key=lambda r: (r[0].split("/"), r[1]))
    assert sorted(r.vec_id for r in out.filter("client_id = 'x'").collect()) == list(range(len(rows) // 2))


def test_stats_see_mixed_dimensions(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0]), ("b", [1.0])], "g string, embedding array<float>")
    got = {r.g: (r.ntotal, r.dim, r.same_dim) for r in vectors.vector_stats(df, ["g"]).collect()}
    assert got == {"a": (1, 1, True), "b": (2, 2, False)}


def clustered(n, dim=8, clusters=12):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, dim)) * 20
    points = centres[np.arange(n) % clusters] + rng.normal(size=(n, dim))
    points[::50] = points[0]  # many equal vectors
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(points)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 20 * 8 * 8])
def test_search_by_pivots_equals_search(spark, block_bytes):
    rows = clustered(900)
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, [x + 0.1 for x in v]) for i, v in rows[::13]], "query_id long, embedding array<float>")
    index = vectors.build_pivot_index(corpus)
    assert len(index.pivots) == 30 and index.counts.sum() == 900
    key = ["query_id", "rank", "vec_id", "distance"]
    for k in (1, 7, 60):
        got = {tuple(r) for r in vectors.search_pivots(index, queries, k, block_bytes).select(*key).collect()}
        assert got == {tuple(r) for r in vectors.search(corpus, queries, k, block_bytes).select(*key).collect()}


def test_far_blocks_are_not_read(spark, monkeypatch):
    rows = clustered(900)
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.build_pivot_index(corpus)
    queries = spark.createDataFrame([(i, v) for i, v in rows[1:4]], "query_id long, embedding array<float>")
    read, scan = [], vectors._search_admitted

    def counted(index, ids, given, admitted, k):
        read.append(admitted)
        return scan(index, ids, given, admitted, k)

    monkeypatch.setattr(vectors, "_search_admitted", counted)
    assert vectors.search_pivots(index, queries, 5).count() == 15
    near, rest = read
    # Three queries in three of twelve clusters: most of the 30 blocks admit none of them.
    assert not (near & rest).any() and (near | rest).any(0).sum() <= 15 and (near | rest).sum(1).max() <= 8


def test_pivots_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<float>")
    few = vectors.build_pivot_index(spark.createDataFrame([(5, [1.0, 1.0]), (None, [0.0, 0.0]), (6, None)], schema))
    assert [(r.vec_id, r.distance) for r in vectors.search_pivots(few, queries, 3).collect()] == [(5, 1.0)]
    assert vectors.search_pivots(few, queries.limit(0), 3).count() == 0
    none = vectors.build_pivot_index(spark.createDataFrame([], schema))
    assert vectors.search_pivots(none, queries, 3).count() == 0
