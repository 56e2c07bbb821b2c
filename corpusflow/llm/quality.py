"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated monotonically."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import staged, with_python

STATISTICS = (
    "log_chars",
    "log_words",
    "log_lines",
    "word_length",
    "word_length_spread",
    "long_words",
    "upper_share",
    "digit_share",
    "space_share",
    "symbol_share",
    "stop_share",
    "bar_share",
    "mark_share",
    "distinct_words",
    "distinct_lines",
    "line_words",
    "open_lines",
    "top_word",
)
_ENDS = (33, 46, 63, 58, 34)
_TEXT_MARKS = (32, 10, 13, 9, 46, 44, 39, 34, 45, 58, 59, 40, 41)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text, in the order of ``STATISTICS``; all zero for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).astype(float)
    n = counts.sum()
    lengths = np.fromiter(map(len, words), float, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    times = Counter(words)
    ascii_letters = counts[65:91].sum() + counts[97:123].sum()
    plain = ascii_letters + counts[48:58].sum() + counts[128:].sum() + sum(counts[c] for c in _TEXT_MARKS)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        (lengths > 12).mean(),
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        (counts[32] + counts[9] + counts[10] + counts[13]) / n,
        (n - plain) / n,
        (counts[46] + counts[44]) / n,
        counts[124] / len(words),
        counts[33] / len(words),
        len(times) / len(words),
        len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
        sum(ord(x.rstrip()[-1]) not in _ENDS for x in lines) / len(lines),
        max(times.values()) / len(words),
    ]


def _statistic_batches(batches):
    for batch in batches:
        texts = batch["text"]
        out = batch.drop(columns=["text"])
        out["x"] = [statistics(t or "") for t in texts]
        yield out


@dataclass(frozen=True)
class Model:
    """A fitted scorer. Scores rise with the likelihood of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.hstack([np.ones((len(z), 1)), wave])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of every whole text."""
    with_python(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(_statistic_batches, schema)


def _sums(model: Model):
    """Normal equations of a partition, a row of the matrix per output row."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                z = model.features(np.stack(batch["x"].to_numpy()))
                part = z.T @ np.hstack([z, batch["y"].to_numpy(float)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            k, j = np.indices(total.shape)
            yield pd.DataFrame({"k": k.ravel(), "j": j.ravel(), "v": total.ravel()})

    return run


def _raw(model: Model, bins: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                raw = model.raw(np.stack(batch["x"].to_numpy()))
                yield pd.DataFrame({"b": np.floor(raw * bins).astype(np.int64), "y": batch["y"].to_numpy(float)})

    return run


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, features: int = 256, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> Model:
    """A model from ``rows`` of ``x`` (statistics), ``y`` (0 or 1) and ``calibrate`` (rows kept for calibration).

    Each partition sums its own normal equations; the sums meet cell by cell in an aggregate, and the driver solves a
    system of ``features + 1`` unknowns. Calibration pools raw scores in ``bins`` per unit, so that the driver gets a
    bounded number of bins, whatever the number of rows. Without rows, or with one class only, every score is the
    share of label 1 (0.5 without rows).
    """
    d = len(STATISTICS)
    known = rows.filter("y is not null")
    moments = known.select(
        F.count("*"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)], F.avg("y")
    ).first()
    rng = np.random.default_rng(seed)
    n, share = moments[0], float(moments[-1]) if moments[-1] is not None else 0.5
    mean = np.array([moments[1 + 2 * i] or 0.0 for i in range(d)], float)
    scale = np.array([moments[2 + 2 * i] or 1.0 for i in range(d)], float)
    directions, phases = rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features)
    flat = Model(mean, scale, directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([share]))
    if not n or share in (0.0, 1.0):
        return flat
    cells = (
        known.filter("not calibrate")
        .select("x", "y")
        .mapInPandas(_sums(flat), "k int, j int, v double")
        .groupBy("k", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    system = np.zeros((features + 1, features + 2))
    system[cells["k"].to_numpy(int), cells["j"].to_numpy(int)] = cells["v"].to_numpy(float)
    gram, target = system[:, :-1], system[:, -1]
    penalty = ridge * max(gram[0, 0], 1.0) * np.eye(features + 1) / features
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(gram + penalty, target)
    fitted = Model(mean, scale, directions, phases, weights, flat.knots, flat.levels)
    pooled = (
        known.filter("calibrate")
        .select("x", "y")
        .mapInPandas(_raw(fitted, bins), "b long, y double")
        .groupBy("b")
        .agg(F.sum("y").alias("s"), F.count("*").alias("n"))
        .orderBy("b")
        .toPandas()
    )
    if pooled.empty:
        return Model(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    count = pooled["n"].to_numpy(float)
    level = pool_adjacent(pooled["s"].to_numpy(float) / count, count)
    return Model(mean, scale, directions, phases, weights, (pooled["b"].to_numpy(float) + 0.5) / bins, level)


def _score_batches(model: Model):
    def run(batches):
        for batch in batches:
            out = batch.drop(columns=["x"])
            out["score"] = model.score(np.stack(batch["x"].to_numpy())) if len(batch) else np.zeros(0)
            yield out

    return run


def fold(column: str = "doc_id") -> Column:
    """0 to 4; documents of fold 0 are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the statistics of labelled documents outside fold 0; of those, fold 1 calibrates."""
    marks = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).alias("y"))
    )
    rows = stats.filter(fold() != 0).join(marks, "doc_id")
    return fit(rows.select("x", "y", (fold() == 1).alias("calibrate")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A score from 0 to 1 for every row of ``docs``: ``doc_id, held_out, score``.

    ``docs``: doc_id, text and any other columns. ``labels``: doc_id, quality. Learns from labelled documents outside
    fold 0; of those, fold 1 calibrates and the rest fits. Rows with a null label teach nothing, several labels of
    one document are averaged and rounded, a null doc_id is in no fold and scored as the rest. Null texts count as
    empty; rows that repeat are scored each. Only the text goes into a score.
    """
    stats = staged(document_statistics(docs), "quality")
    model = learn(stats, labels)
    schema = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = stats.mapInPandas(_score_batches(model), schema)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, unchanged.

    Texts are scored where they stand by the model that ``quality_scores`` fits, so no text is shuffled.
    """
    model = learn(staged(document_statistics(docs), "quality"), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts]).reshape(-1, len(STATISTICS))))

    return docs.filter(score(F.col("text")) >= least)
