"""Embedding text with a model that is created once per Python worker."""

from __future__ import annotations

from hashlib import md5
from typing import Callable, Protocol, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas

# Rows per model call, and the dimension of the default model.
BATCH_SIZE = 64
DIMENSION = 384
# Tokens whose buckets a worker remembers.
_SLOTS = 100_000


class Embedder(Protocol):
    """Anything that turns texts into a (texts x dimension) matrix. Rows need not be of unit length."""

    name: str

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


# A picklable function of no arguments; it runs on the worker.
EmbedderFactory = Callable[[], Embedder]


class _Slots(dict):
    """Token -> bucket, plus the dimension where its sign is minus. Tokens are hashed when first met."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, token: str) -> int:
        digest = md5(token.encode()).hexdigest()
        slot = int(digest[:8], 16) % self.dimension + self.dimension * (int(digest[8], 16) & 1)
        if len(self) < _SLOTS:  # beyond this, new tokens are hashed each time
            self[token] = slot
        return slot


class HashingEmbedder:
    """A deterministic stand-in for a neural model: signed token counts in hashed buckets.

    Tokens are the lower-case text split on white space. A token's bucket is the first 8 hex digits of its MD5 modulo
    the dimension; the 9th digit gives the sign, plus where even.
    """

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.name = f"hashing-{dimension}"
        self._slots = _Slots(dimension)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            tokens = text.lower().split()
            slots = np.fromiter(map(self._slots.__getitem__, tokens), np.int64, len(tokens))
            plus, minus = np.bincount(slots, minlength=2 * self.dimension).reshape(2, -1)
            row += plus - minus
        return out


class SentenceTransformerEmbedder:
    """A sentence-transformers model by name; needs that package and the model's weights on the workers."""

    def __init__(self, name: str = "sentence-transformers/all-MiniLM-L12-v2"):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError:
            raise ImportError("install sentence-transformers on the workers to use this embedder") from None
        self.name = name
        self._model = SentenceTransformer(name)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return self._model.encode(list(texts), batch_size=len(texts), convert_to_numpy=True)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 as float32; a zero row stays zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norms == 0, 1, norms)).astype(np.float32)


def unit_vector(vector: Column) -> Column:
    """An array column scaled to length 1, computed in double; a zero vector stays zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    return F.when(norm == 0, wide).otherwise(F.transform(wide, lambda x: x / norm))


def embed(
    df: DataFrame,
    text: str = "text",
    factory: EmbedderFactory = HashingEmbedder,
    batch_size: int = BATCH_SIZE,
    out: str = "embedding",
) -> DataFrame:
    """Adds the unit-length vector of each row's text. Narrow; a vector stays with its row."""

    def make_predictor():
        model = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            return unit_rows(np.asarray(model.encode([t or "" for t in texts.tolist()])))

        return predict

    encode = predict_batch_udf(make_predictor, return_type=schemas.VECTOR, batch_size=batch_size)
    # Declared nondeterministic so that Spark never runs the model twice, say for a filter it infers from an explode.
    return df.withColumn(out, encode.asNondeterministic()(F.col(text)))
