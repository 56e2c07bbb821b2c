import numpy as np
import pyarrow as pa

from corpusflow.llm import hilbert_ann
from corpusflow.llm.hilbert_ann import hilbert_keys, nearest
from llm_helpers import FOLDER, needs_tables

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in rows if j != i)
            out[i] = near[:k]
    return out


def recall(got, want):
    hits = sum(len({j for _, j in want[i]} & {r.vec_id for r in got if r.query_id == i}) for i in want)
    return hits / sum(len(x) for x in want.values())


@needs_tables
def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = nearest(df, every=10).collect()
    want = exact(rows, 10, 10)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in got:
        assert abs(r.score - np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())) < 1e-12
    for i in want:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == i)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_copies_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(10, rows[10][1]), (100, rows[3][1])]
    bad = [(200, None), (300, [0.0] * 8), (400, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (700, [1.0]), (800, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).selectExpr("*", "1 as uid", "2 as v", "3 as cell")
    got = nearest(df, every=10, reach=1.0).collect()
    want = exact(list(dict(rows).items()), 10, 10)
    mine = {i: [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] for i in want}
    assert {r.query_id for r in got} == set(want)
    for i, near in want.items():
        assert [j for _, j in mine[i]] == [j for _, j in near]
        assert np.allclose([d for d, _ in mine[i]], [d for d, _ in near])


def test_many_vectors_at_the_same_distance(spark):
    """128 vectors one unit from the query, in a table of 6,000 far ones: the smallest ids win."""
    near = np.eye(64)
    rows = [(0, np.zeros(64) + 0.0)] + [(1 + i, v) for i, v in enumerate([*near, *-near])]
    rng = np.random.default_rng(4)
    rows += [(1000 + i, v) for i, v in enumerate(rng.normal(size=(6000, 64)) * 9)]
    rows = [(i, (v + 3).tolist()) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted((r["rank"], r.vec_id, r.score) for r in nearest(df, every=10**6, reach=1.0).collect())
    assert got == [(i, i, 1.0) for i in range(1, 11)]


def test_a_vector_travels_once_per_ordering(spark):
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(size=(3000, 8)), np.arange(3000)
    found = hilbert_ann.fit_orderings(vectors, ids, 3, 50, 1)
    batch = pa.RecordBatch.from_pydict({"uid": ids, "least": ids, "v": list(vectors), "asks": ids % 2 == 0})
    sent = pa.Table.from_batches(hilbert_ann._placed(found, 2)([batch])).to_pandas()
    standing = sent[sent.side == 0]
    assert len(standing) == 3 * 3000 and set(standing.groupby("uid").size()) == {3}
    assert len(sent[sent.side == 1]) <= 3 * 1500 * 5


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(df).collect()] == [(0, 1, 1)]
    assert nearest(df.filter("vec_id = 0")).count() == 0
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.filter("vec_id = 1")).count() == 0


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(1 << (bits * dims)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
