"""Benchmark decontamination by greedy string tiling.

Runs of words are hashed by a rolling (Karp-Rabin) hash and joined with those of the benchmark. Equal runs on one diagonal
grow into matches. Matches are marked longest first, each word at most once, so that a passage whose parts were reordered
is covered as well as one copied whole. What counts is the share of the item's words that end up marked.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import map_texts, shingle_hashes, staged, text_or_empty, with_python, word_hashes

RUN = 5
COVERAGE = 0.5
#: Bits of the filter that keeps words outside the benchmark off the network; its size does not depend on the benchmark.
FILTER_BITS = 1 << 24


def _item_seeds(run: int):
    def describe(texts: list[str]) -> dict[str, pa.Array]:
        words, bounds = word_hashes(texts)
        parts = [words[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        seeds = [shingle_hashes(w, min(run, len(w))).view(np.int64) if len(w) else np.zeros(0, np.int64) for w in parts]
        return {
            "seeds": pa.array(seeds, pa.list_(pa.int64())),
            "n_words": pa.array([len(w) for w in parts], pa.int32()),
            "run": pa.array([min(run, len(w)) for w in parts], pa.int32()),
        }

    return map_texts(describe)


def _document_seeds(runs: list[int], words_of_filter: np.ndarray):
    """Hashes and places of runs that pass the filter."""

    def describe(texts: list[str]) -> dict[str, pa.Array]:
        words, bounds = word_hashes(texts)
        seeds, places = [], []
        for i in range(len(texts)):
            own = words[bounds[i] : bounds[i + 1]]
            found = []
            for run in runs:
                h = shingle_hashes(own, run)
                bit = h % np.uint64(FILTER_BITS)
                at = np.flatnonzero((words_of_filter[(bit >> np.uint64(6)).astype(int)] >> (bit & np.uint64(63))) & np.uint64(1))
                found.append((h[at].view(np.int64), at.astype(np.int32)))
            seeds.append(np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.int64))
            places.append(np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int32))
        return {"seeds": pa.array(seeds, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32()))}

    return map_texts(describe)


def tiles(points: list[tuple[int, int]], run: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in the text, place in the item, words), longest first.

    ``points`` are places where runs of ``run`` words agree. Ties go to the earlier place in the item, then the text.
    """
    matches, last = [], None
    for diagonal, place in sorted((d - i, d) for d, i in set(points)):
        if last and last[0] == diagonal and last[1] + last[2] == place:
            last[2] += 1
        else:
            matches.append(last := [diagonal, place, 1])
    heap = [(-(n + run - 1), d - diagonal, d) for diagonal, d, n in matches]
    heapq.heapify(heap)
    text, item, out = set(), set(), []
    while heap:
        size, i, d = heapq.heappop(heap)
        n, free = -size, 0
        pieces = []
        for k in range(n + 1):
            if k < n and i + k not in item and d + k not in text:
                free += 1
            else:
                if free >= run:
                    pieces.append((k - free, free))
                free = 0
        if pieces == [(0, n)]:
            out.append((d, i, n))
            item.update(range(i, i + n))
            text.update(range(d, d + n))
        else:
            for k, free in pieces:
                heapq.heappush(heap, (-free, i + k, d + k))
    return out


def _tilings(batches):
    for batch in batches:
        frame = batch.select(["places", "run"]).to_pydict()
        found = [
            tiles([(p["place"], p["item_place"]) for p in points], run)
            for points, run in zip(frame["places"], frame["run"], strict=True)
        ]
        others = [n for n in batch.schema.names if n not in ("places", "run")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in others]
            + [pa.array([len(t) for t in found], pa.int32()), pa.array([sum(x[2] for x in t) for t in found], pa.int32())],
            names=[*others, "tiles", "covered"],
        )


def overlaps(docs: DataFrame, benchmark: DataFrame, run: int = RUN, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of document and benchmark item of whose words ``coverage`` or more are in matches of ``run`` words or more.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; both may have other columns. Gives ``doc_id, version`` (hash of
    the document's text), ``item_id, n_words, tiles, covered, coverage``. Items shorter than ``run`` words match as a
    whole; items and documents without words (null or empty texts) match nothing. Documents that repeat a doc_id and its
    text count once, and so do items.
    """
    spark = docs.sparkSession
    with_python(spark)
    asked = benchmark.select("item_id", "text").distinct()
    kind = asked.schema["item_id"]
    item_schema = T.StructType(
        [
            kind,
            T.StructField("item", T.LongType()),
            T.StructField("seeds", T.ArrayType(T.LongType())),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("run", T.IntegerType()),
        ]
    )
    items = asked.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text")
    seeds = staged(
        items.mapInArrow(_item_seeds(run), item_schema)
        .filter("n_words > 0")
        .select("item_id", "item", "n_words", "run", F.posexplode("seeds").alias("item_place", "seed")),
        "seeds",
    )
    runs = sorted(r[0] for r in seeds.select("run").distinct().collect())
    bit = F.expr(f"pmod(if(seed < 0, seed % {FILTER_BITS} + {FILTER_BITS}, seed), {FILTER_BITS})")
    masks = (
        seeds.select(bit.alias("bit"))
        .groupBy(F.expr("cast(shiftright(bit, 6) as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        .toPandas()
    )
    filled = np.zeros(FILTER_BITS // 64, np.uint64)
    filled[masks["word"].to_numpy(int)] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("version"), "text")
    doc_schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("version", T.LongType()),
            T.StructField("seeds", T.ArrayType(T.LongType())),
            T.StructField("places", T.ArrayType(T.IntegerType())),
        ]
    )
    found = (
        rows.mapInArrow(_document_seeds(runs, filled), doc_schema)
        .filter("size(seeds) > 0")
        .select("doc_id", "version", F.expr("inline(arrays_zip(seeds, places))"))
        .withColumnsRenamed({"seeds": "seed", "places": "place"})
    )
    pairs = (
        found.join(seeds, "seed")
        .groupBy("doc_id", "version", "item_id", "item", "n_words", "run")
        .agg(F.collect_set(F.struct("place", "item_place")).alias("places"))
    )
    schema = T.StructType(
        [f for f in pairs.schema if f.name not in ("places", "run")]
        + [T.StructField("tiles", T.IntegerType()), T.StructField("covered", T.IntegerType())]
    )
    tiled = pairs.mapInArrow(_tilings, schema).withColumn("coverage", F.col("covered") / F.col("n_words"))
    return tiled.filter(F.col("coverage") >= coverage).drop("item")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, unchanged. ``options``: those of ``overlaps``."""
    found = overlaps(docs, benchmark, **options)
    gone = staged(found.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text_or_empty()) == gone["gone_version"])
    return docs.join(gone, same, "left_anti")
