"""Tables, staging in the shared folder, and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_path, ship_package

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """``df`` written to the folder all executors share and read back.

    Cuts the lineage, keeps later joins free to split hot keys, and outlives a lost executor. Columns of ``hashes`` are
    written without looking for values that repeat.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.enable.dictionary", not hashes).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table once all that is made from it has been stored."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``df`` that meet a condition on columns it computes.

    A plain filter is pushed below the projections that compute them and does all their work again. One that refers to
    a row's number in its task is not.
    """
    return df.withColumn("_place", F.monotonically_increasing_id()).filter(condition & (F.col("_place") >= 0)).drop("_place")


def with_python(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one entry more than texts).

    A word is a run of ASCII letters, digits and underscores and of non-ASCII characters, in lower case. Every word is
    hashed from differences of running polynomial sums, so that no Python code runs per word.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _MULTIPLIER, np.uint64))
        undo = np.cumprod(np.full(len(data), _INVERSE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        # Dividing by the power at its start makes equal words equal wherever they stand.
        hashes = mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; empty where there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def text_batches(texts: list[str], limit: int = 1 << 20):
    """Index ranges of consecutive texts of about ``limit`` characters, a longer text by itself.

    Hashing words takes some fifty bytes a character while it lasts.
    """
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def map_texts(describe):
    """A function for ``mapInArrow``: replaces ``text`` by the columns that ``describe`` makes from a list of texts.

    Null texts count as empty. Texts come in groups of about a million characters, whatever the size of the batch.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            others = [n for n in batch.schema.names if n != "text"]
            for lo, hi in text_batches(texts):
                columns = {n: batch.column(n).slice(lo, hi - lo) for n in others} | describe(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run
