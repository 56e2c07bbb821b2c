"""Ranked lexical search by bag deduplication.

A score depends only on how often a document holds each of the items' terms and on its length class ``m``. Documents are
restricted to the items' vocabulary, and those with the same counts and the same ``m`` form a class: grouped by a hash, and
by the counts themselves, so that a shared hash joins nothing that differs. Each class is scored once for all items;
classes are then expanded to their members by ascending doc_id.

Items are searched in blocks of bounded size: a block's vocabulary and postings travel to every task. A document is read
once per block. No block holds more than ``block_terms`` entries and one item's terms.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.common import discard, staged, with_python
from corpusflow.operators.ordinals import dense_order

# On UTF-8 bytes in ASCII lower case, a byte above 127 belongs to a character above 127.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]")
_PIECE = 1 << 20
# Scores held at once in a task, and what an item counts for in a block besides its terms.
_CELLS, _ITEM = 1 << 21, 256


def term_counts(text: str | None) -> Counter:
    """How often each term (bytes, ASCII lower case) occurs in the whole text, which is read in pieces."""
    data, found, at = (text or "").encode("utf-8", "replace").lower(), Counter(), 0
    while at < len(data):
        gap = _OTHER.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        found.update(_TERM.findall(data, at, end))
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows that share an item_id are one item."""
    with_python(items.sparkSession)

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                terms = [t.decode() for t in term_counts(text.as_py())]
                ids = batch.column("item_id").slice(i, 1).take(pa.array([0] * len(terms), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string())], names=["item_id", "term"])

    given = items.select(F.col("item_id").cast("long"), "text")
    return given.mapInArrow(run, "item_id long, term string").distinct()


def item_blocks(items: DataFrame, block_terms: int) -> DataFrame:
    """``item_id, term, block``: consecutive items of about ``block_terms`` terms together, and not too many of them."""
    terms = staged(item_terms(items), "item-terms")
    sizes = terms.groupBy("item_id").agg((F.count("*") + _ITEM).alias("size")).withColumn("one", F.lit(0))
    placed = dense_order(sizes, ["one"], [F.col("item_id")], "size", "before")
    block = placed.select(F.col("item_id").alias("id"), F.expr(f"before div {int(block_terms)}").alias("block"))
    return staged(terms.join(block, F.expr("item_id <=> id")).select("item_id", "term", "block"), "item-blocks")


def term_vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``doc_id, n, bag``: all terms counted, and the counts of the vocabulary's (pairs of number and count, packed).

    ``vocabulary`` gives the number of each term.
    """
    with_python(docs.sparkSession)

    def run(batches):
        number = vocabulary.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text"):
                found = term_counts(text.as_py())
                sizes.append(sum(found.values()))
                pairs = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                bags.append(np.array(pairs, np.int32).tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "bag"])

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "doc_id long, n long, bag binary")


def _pairs(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the batch, number and count of all pairs of packed bags."""
    flat = np.frombuffer(b"".join(bags), np.int32).reshape(-1, 2).astype(np.int64)
    rows = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
    return rows, flat[:, 0], flat[:, 1]


def document_frequencies(classes: DataFrame) -> DataFrame:
    """``number, df``: the documents that hold each term of the vocabulary, from ``bag`` and ``size`` of classes."""

    def run(batches):
        for batch in batches:
            rows, number, _ = _pairs(batch.column("bag").to_pylist())
            sizes = np.asarray(batch.column("size"))
            terms, place = np.unique(number, return_inverse=True)
            sums = np.zeros(len(terms), np.int64)
            np.add.at(sums, place, sizes[rows])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(sums)], names=["number", "df"])

    counts = classes.select("bag", "size").mapInArrow(run, "number long, df long")
    return counts.groupBy("number").agg(F.sum("df").alias("df"))


def term_weights(df: DataFrame, documents: int) -> DataFrame:
    """``number, weight``: floor(1000 ln((2N + 2) / (2df + 1)))."""
    share = (F.lit(2 * documents + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")
    return df.select("number", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("weight"))


class _Best:
    """The best rows per item so far: score descending, then the order given. Memory is bounded by items times k."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.floor = np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4

    def add(self, item, score, first, place):
        self.kept = [np.concatenate(x) for x in zip(self.kept, (item, score, first, place), strict=True)]
        if len(self.kept[0]) > 4 * self.items * self.k:
            self.prune()

    def prune(self):
        item, score, first, place = self.kept
        order = np.lexsort((place, first, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = order[rank < self.k]
        self.kept = [x[best] for x in (self.kept)]
        full = item[rank == self.k - 1]
        self.floor[full] = score[order][rank == self.k - 1]


def best_classes(classes: DataFrame, postings: Broadcast, n_items: int, k: int) -> DataFrame:
    """``item, score, class_id``: of each task's classes, the k best for each item (by number).

    ``postings`` holds ``starts, items, weights``: ``items[starts[t] : starts[t + 1]]`` are the items that hold term t.
    """
    with_python(classes.sparkSession)
    last = np.iinfo(np.int64).max

    def scored(bags, m, first, place, best):
        starts, items, weights = postings.value
        rows, number, count = _pairs(bags)
        part = weights[number] * ((1_000_000_000 * count) // (1000 * count + 20 * m[rows]))
        width = starts[number + 1] - starts[number]
        total = np.zeros((len(bags), n_items), np.int64)
        done = np.concatenate([[0], np.cumsum(width)])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(done, done[at] + _CELLS, "right")) - 1)
            w = width[at:end]
            pair = np.repeat(np.arange(at, end), w)
            item = items[np.repeat(starts[number[at:end]] - (done[at:end] - done[at]), w) + np.arange(len(pair))]
            np.add.at(total.reshape(-1), rows[pair] * n_items + item, part[pair])
            at = end
        row, item = np.nonzero(total >= best.floor)
        best.add(item, total[row, item], first[row], place[row])

    def run(batches):
        best = _Best(n_items, k)
        step = max(1, _CELLS // max(1, n_items))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                numbers = [np.asarray(some.column(c).fill_null(last)) for c in ("m", "first_id", "class_id")]
                scored(some.column("bag").to_pylist(), *numbers, best)
        best.prune()
        item, score, _, place = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, score, place)], names=["item", "score", "class_id"])

    return classes.select("bag", "m", "first_id", "class_id").mapInArrow(run, "item long, score long, class_id long")


def _search_block(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best documents for each item of a block of ``item_id, term``."""
    spark: SparkSession = docs.sparkSession
    held = entries.toArrow()  # bounded by the block
    item_ids, terms = held.column("item_id").to_pylist(), held.column("term").to_pylist()
    ids = sorted(set(item_ids), key=lambda x: (x is None, x))
    item_no = {x: i for i, x in enumerate(ids)}
    term_no = {t: i for i, t in enumerate(sorted(set(terms)))}
    of_item = np.array([item_no[x] for x in item_ids], np.int64)
    of_term = np.array([term_no[t] for t in terms], np.int64)
    order = np.lexsort((of_item, of_term))
    starts = np.searchsorted(of_term[order], np.arange(len(term_no) + 1))

    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in term_no.items()})
    vectors = staged(term_vectors(docs, vocabulary), "vectors")
    documents, total = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    length = F.expr(f"50 + cast(n as decimal(19)) * {50 * documents}BD div {max(total, 1)}BD").alias("m")
    bags = vectors.filter("octet_length(bag) > 0").select("doc_id", "bag", length, F.xxhash64("bag").alias("hash"))
    class_key = ["hash", "m", "bag"]
    classes = staged(
        bags.groupBy(*class_key)
        .agg(F.count("*").alias("size"), F.min("doc_id").alias("first_id"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    weights = np.zeros(len(term_no), np.int64)
    weighed = term_weights(document_frequencies(classes), documents).toPandas()  # a row per term of the block
    weights[weighed.number] = weighed.weight

    postings = spark.sparkContext.broadcast((starts, of_item[order], weights))
    found = best_classes(classes, postings, len(ids), k)
    found = found.join(classes.select("class_id", "first_id"), "class_id")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first_id"), "class_id")
    best = staged(found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k), "best")
    # Members of a class rank by doc_id for every item, so that k of them are enough.
    chosen = classes.join(best.select("class_id").distinct(), "class_id", "left_semi").select("class_id", *class_key)
    members = bags.join(chosen, class_key).select("class_id", "doc_id")
    by_id = Window.partitionBy("class_id").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k).drop("nth")
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = (
        best.select("item", "score", "class_id")
        .join(members, "class_id")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
    result = staged(out.join(names, "item").select("item_id", "rank", "doc_id", "score"), "hits")
    for table in (vectors, classes, best):
        discard(table)
    for sent in (vocabulary, postings):
        sent.unpersist()
    return result


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 1 << 20) -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased, of the whole text. Rows of
    ``docs`` are documents of their own even if they share a doc_id; a null doc_id comes last among equal scores; a null or
    empty text has no terms. Items without terms, and items none of whose terms any document holds, give no rows; rows of
    ``items`` that share an item_id are one item, a null one too. Equal scores rank by ascending doc_id; among those rows of one
    doc_id take consecutive ranks. Other columns of either table play no part. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, block_terms)
    hits = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for row in blocks.select("block").distinct().sort("block").toLocalIterator():
        entries = blocks.filter(F.col("block") == row.block).select("item_id", "term")
        hits = hits.unionAll(_search_block(docs, entries, k))
    return hits
