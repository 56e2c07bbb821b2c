"""Mixtures of sources with target weights, from fixed-length blocks of words.

The words of each source, document after document, form blocks of equal length. Each output shard draws from a multinomial
distribution how many blocks it takes of each source; its slots walk through a pseudorandom permutation of the source's
blocks, and meet the blocks in a join on their index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import mix, staged, text_or_empty, with_python

BLOCK = 64
SHARDS = 16
WEIGHTS = (5, 2, 1)
_WORD = r"[^\\x20\\x09-\\x0D]+"
_BUCKETS = 1024


@dataclass(frozen=True)
class Plan:
    """Of each source: words, target, number of blocks, number of slots; and the slots by shard and source."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: np.ndarray
    counts: np.ndarray


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: ``share`` of all words, dealt by repeating ``weights``.

    No source gives more than ``most`` times its words; what is above is dealt to the others until none is above.
    """
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    limit = most * np.array(sizes, float)
    out, free = np.zeros(len(sizes)), limit > 0
    left = share * float(sum(sizes))
    while free.any():
        part = left * weight / weight[free].sum()
        above = free & (part > limit)
        if not above.any():
            out[free] = part[free]
            break
        out[above] = limit[above]
        left -= limit[above].sum()
        free &= ~above
    return out.tolist()


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of ``range(size)`` takes ``index``: four Feistel rounds, repeated until inside."""
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(size, 2))) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ mix(k + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def plan(sizes: list[tuple[str | None, int]], block: int, shards: int, seed: int, **options) -> Plan:
    """The slots to fill. Slot counts are drawn per shard, then moved so that each source meets its target."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    words = [int(n) for _, n in order]
    wanted = targets(words, **options)
    blocks = np.array([-(-n // block) for n in words], np.int64)
    quota = np.array(
        [min(2 * b, round(t * b / n)) if n else 0 for t, b, n in zip(wanted, blocks, words, strict=True)], np.int64
    )
    total = int(quota.sum())
    rng = np.random.default_rng(seed)
    counts = np.zeros((shards, len(order)), np.int64)
    if total:
        sizes_of_shards = np.full(shards, total // shards, np.int64)
        sizes_of_shards[: total % shards] += 1
        counts = np.array([rng.multinomial(n, quota / total) for n in sizes_of_shards], np.int64)
        for s, q in enumerate(quota):
            over = int(counts[:, s].sum() - q)
            step = -(-abs(over) // shards)
            for j in [*rng.permutation(shards), *range(shards)]:
                moved = min(over, step, int(counts[j, s])) if over > 0 else max(over, -step)
                counts[j, s] -= moved
                over -= moved
            for j in range(shards):  # what shards with few slots could not give
                moved = min(max(over, 0), int(counts[j, s]))
                counts[j, s] -= moved
                over -= moved
    return Plan([s for s, _ in order], words, wanted, blocks, counts)


def sized(docs: DataFrame) -> DataFrame:
    """A stored row per row of ``docs``: ``rid, doc_id, version, source, size, start``.

    ``size`` counts words, ``start`` the words of the source before the document. The order within a source is by a
    hash bucket, then doc_id and text; running totals go over each bucket and over the bucket totals, so that no task
    sees a whole source.
    """
    rows = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty()).alias("version"),
        F.col("source").cast("string").alias("source"),
        F.expr(f"cast(regexp_count(coalesce(text, ''), '{_WORD}') as long)").alias("size"),
    ).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, version), {_BUCKETS})"))
    rows = staged(rows, "sizes")
    total = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(total.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))), "bases")
    inner = (
        Window.partitionBy("source", "bucket").orderBy("doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    bases = base.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    joined = placed.join(bases, F.expr("source <=> s and bucket = b"))
    return staged(
        joined.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "version",
            "source",
            "size",
            (F.col("base") + F.col("inner")).alias("start"),
        ),
        "sized",
    )


def _slot_batches(counts: np.ndarray, blocks: np.ndarray, seed: int):
    """Slots by number: shard, place in the shard, source and block."""
    ends = np.cumsum(counts.ravel())
    before = np.cumsum(counts, axis=0) - counts
    sizes = counts.sum(axis=1)
    shard_starts = np.cumsum(sizes) - sizes

    def run(batches):
        for batch in batches:
            slot = batch["id"].to_numpy(np.int64)
            cell = np.searchsorted(ends, slot, side="right")
            shard, source = np.divmod(cell, counts.shape[1])
            index = slot - (ends[cell] - counts.ravel()[cell]) + before[shard, source]
            size = blocks[source]
            key = source.astype(np.uint64) * np.uint64(1 << 20) + (index // np.maximum(size, 1)).astype(np.uint64)
            block = permuted(index % np.maximum(size, 1), size, mix(key + np.uint64(seed)))
            place = permuted(slot - shard_starts[shard], sizes[shard], mix(shard.astype(np.uint64) + np.uint64(~seed & 0xFFFFFFFF)))
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": place, "s": source.astype(np.int32), "block": block})

    return run


def draws(rows: DataFrame, made: Plan, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """What the mixture takes: ``shard, slot, piece, rid, from_word, n_words``, a row per document part of each slot.

    ``rows``: the result of ``sized``.
    """
    spark = rows.sparkSession
    with_python(spark)
    total = int(made.counts.sum())
    parallel = max(spark.sparkContext.defaultParallelism, -(-total // (1 << 20)))
    slots = spark.range(0, total, 1, parallel).mapInPandas(
        _slot_batches(made.counts, made.blocks, seed), "shard int, slot long, s int, block long"
    )
    names = _names(spark, made)
    pieces = (
        rows.filter("size > 0")
        .join(F.broadcast(names), F.expr("source <=> name"))
        .withColumn("block", F.expr(f"explode(sequence(start div {block}, (start + size - 1) div {block}))"))
        .select(
            "s",
            "block",
            "rid",
            F.expr(f"greatest(block * {block}, start) - start").alias("from_word"),
            F.expr(f"least((block + 1) * {block}, start + size) - greatest(block * {block}, start)").alias("n_words"),
            F.expr(f"greatest(block * {block}, start) - block * {block}").alias("piece"),
        )
    )
    return slots.join(pieces, ["s", "block"]).select("shard", "slot", "piece", "rid", "from_word", "n_words")


def _names(spark: SparkSession, made: Plan) -> DataFrame:
    rows = [(i, *x) for i, x in enumerate(zip(made.sources, made.sizes, made.targets, strict=True))]
    return spark.createDataFrame(rows, "s int, name string, source_size long, target double")


def planned(rows: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 5, **options) -> Plan:
    """Sources are components of a mixture, few enough for their totals to meet in the driver."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    return plan([(r["source"], r["size"] or 0) for r in found], block, shards, seed, **options)


def mixture_shares(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 5, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source, other columns).

    ``taken`` counts the document's words in the mixture, repeats included. Null texts have no words, null sources are
    a source of their own, the last. Rows that repeat are rows of their own.
    """
    rows = sized(docs)
    made = planned(rows, block, shards, seed, **options)
    taken = draws(rows, made, block, seed).groupBy("rid").agg(F.sum("n_words").alias("taken"))
    return (
        rows.join(F.broadcast(_names(docs.sparkSession, made)), F.expr("source <=> name"))
        .join(taken, "rid", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixture(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 5, **options) -> DataFrame:
    """The mixture itself: ``shard, slot, piece, source, doc_id, from_word, n_words, text``.

    A slot holds ``block`` words (the last block of a source fewer), in pieces of consecutive documents ordered by
    ``piece``, the place of the piece's first word. Texts keep the white space after each word. ``docs`` as in
    ``mixture_shares``; rows that repeat a doc_id, source and text share their pieces.
    """
    rows = sized(docs)
    made = planned(rows, block, shards, seed, **options)
    taken = draws(rows, made, block, seed)
    wanted = (
        taken.join(rows.select("rid", "doc_id", "version", "source"), "rid")
        .groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("source").alias("o"))
        .agg(F.collect_list(F.struct("shard", "slot", "piece", "from_word", "n_words")).alias("parts"))
    )
    texts = (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text"))
        .withColumn("version", F.xxhash64(text_or_empty()))
        .dropDuplicates(["doc_id", "version", "source"])
    )
    whole = texts.join(wanted, F.expr("doc_id <=> d and version = v and source <=> o")).withColumn(
        "words", F.expr(f"regexp_extract_all(text, '{_WORD}[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    )
    return whole.select("doc_id", "source", "words", F.explode("parts").alias("p")).select(
        "p.shard",
        "p.slot",
        "p.piece",
        "source",
        "doc_id",
        "p.from_word",
        "p.n_words",
        F.expr("array_join(slice(words, cast(p.from_word as int) + 1, cast(p.n_words as int)), '')").alias("text"),
    )
