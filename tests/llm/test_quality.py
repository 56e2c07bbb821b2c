import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm.quality import STATISTICS, keep_quality, pool_adjacent, quality_scores, statistics
from llm_helpers import documents

GOOD = ["The {} went over the {} hill, and rested by a {} river.", "Nobody {} knew why the {} door was {} open."]


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [rng.choice(GOOD).format(word(), word(), word()) for _ in range(rng.randrange(3, 20))]
        texts.append("\n".join(lines if good else [x.upper().replace(" ", "!! ") for x in lines]))
        labels.append((i, int(good), 0))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got.values() if r.held_out]
    assert 80 < len(held) < 160
    assert np.mean([(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows teach nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = documents(spark, [(None, None), (7, ""), (900, None), (901, "  \n"), (902, "z" * 300_000), (3, "twice"), (3, "twice")])
    both = docs.unionByName(odd).selectExpr("*", "1 as y", "2 as x", "0.5 as score", "true as held_out")
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 1, 0), (6, 0, 0)], labels.schema))
    got = quality_scores(both, marks)
    assert got.count() == 307 and got.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    kept = keep_quality(both, marks)
    assert kept.columns == both.columns
    want = {r.doc_id for r in got.filter("score >= 0.3").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_pool_adjacent_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
        # The minimax formula of isotonic regression.
        mean = lambda i, j: (v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(pool_adjacent(v, w), want)


def test_statistics():
    assert statistics("") == statistics(" \n") == [0.0] * len(STATISTICS)
    assert len(statistics("One two.\nThree!")) == len(STATISTICS)


def plain_scores(texts, marks, features=256, ridge=1e-3, bins=512, seed=7):
    """Scores by one design matrix of all labelled rows, a least-squares solver and the minimax formula."""
    x = np.array([statistics(t or "") for _, t in texts])
    crc = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in texts])
    y = np.array([marks.get(i, np.nan) for i, _ in texts])
    known = (crc != 0) & ~np.isnan(y)
    mean, scale = x[known].mean(0), x[known].std(0)
    scale[scale == 0] = 1.0
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(x.shape[1], features)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, features)
    wave = np.sqrt(2 / features) * np.cos(np.clip((x - mean) / scale, -8, 8) @ directions + phases)
    a = np.column_stack([np.ones(len(x)), wave])
    fit, held = known & (crc != 1), known & (crc == 1)
    # Ridge as least squares with a row per weight.
    root = np.sqrt(np.r_[1e-9, np.full(features, ridge * max(fit.sum(), 1) / features)])
    weights = np.linalg.lstsq(np.vstack([a[fit], np.diag(root)]), np.r_[y[fit], np.zeros(features + 1)], rcond=None)[0]
    raw = a @ weights
    b = np.floor(raw[held] * bins).astype(int)
    knots = np.unique(b)
    n = np.array([(b == k).sum() for k in knots], float)
    v = np.array([y[held][b == k].mean() for k in knots])
    total, weight = np.r_[0, np.cumsum(v * n)], np.r_[0, np.cumsum(n)]
    means = (total[None, 1:] - total[:-1, None]) / np.where(weight[None, 1:] > weight[:-1, None], weight[None, 1:] - weight[:-1, None], 1)
    levels = [max(means[i, k:].min() for i in range(k + 1)) for k in range(len(knots))]
    return raw, np.interp(raw, (knots + 0.5) / bins, levels)


def test_scores_equal_the_plain_version(spark):
    docs, labels = corpus(spark)
    # Some labels are turned, so that the two classes overlap and the rising steps have to pool.
    labels = labels.withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    raw, want = plain_scores(texts, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in quality_scores(docs.repartition(7), labels).collect()}
    # A raw score at the border of a bin may fall to either side of it by the last digit.
    clear = np.abs(raw * 512 - np.round(raw * 512)) > 1e-4
    assert clear.mean() > 0.98 and len(set(np.round(want, 6))) > 20
    assert np.allclose(np.array([got[i] for i, _ in texts])[clear], want[clear], atol=1e-5)
