"""The exact L2 index as a table of vectors, and search in it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.operators.ordinals import dense_order
from corpusflow.session import scratch_path

# Bytes of query vectors sent to every task at once.
QUERY_BYTES = 16 << 20
# Bytes of corpus vectors, as doubles, that a task holds where queries come in many blocks.
TILE_BYTES = 16 << 20
# Vectors compared with a quarter of as many queries in one matrix product, and queries whose hits are sent on at once.
_STEP = 2048
_ROWS = 10_000
# More than rounding to nine digits can change a distance.
_SLACK = 1e-9
# Pivots of an index, which meet every query in the driver.
MOST_PIVOTS = 1024


def vector_stats(vectors: DataFrame, groups: list[str], vector: str = "embedding") -> DataFrame:
    """Per group: the number of vectors, their dimension, and whether all have the same."""
    size = F.size(vector)
    return vectors.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("ntotal"),
        F.max(size).alias("dim"),
        (F.min(size) == F.max(size)).alias("same_dim"),
    )


def assign_vector_ids(
    vectors: DataFrame, groups: list[str], document: str, order: list[Column], index: str = "chunk_index"
) -> DataFrame:
    """Adds ``vec_id``, the position in the group by document order, then chunk index.

    Chunk indices run 0..n-1 in each document, so only documents need numbering: their chunk counts are added up in
    document order and each document's base is joined back. ``order`` is made of ``document`` alone.
    """
    sizes = vectors.groupBy(*groups, document).agg(F.count(F.lit(1)).alias("_size"))
    bases = dense_order(sizes, groups, order, "_size", "_base").select(*groups, document, "_base")
    return (
        vectors.join(bases, [*groups, document])
        .withColumn("vec_id", F.col("_base") + F.col(index))
        .drop("_base")
    )


def attach_chunks(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Search hits with the chunk each ``vec_id`` stands for."""
    return hits.join(chunks, keys)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _k_best(rows: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int):
    """The k smallest (distance, id) of each row number."""
    order = np.lexsort((ids, distances, rows))
    rows, ids, distances = rows[order], ids[order], distances[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], distances[keep]


class _Nearest:
    """The k nearest corpus rows met so far by each of a block of queries, by squared distance, ties by id.

    A task holds these and a piece of the distances at a time, whatever the number of queries and of corpus rows.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.square = np.einsum("ij,ij->i", queries, queries)
        self.distances = np.full((len(queries), k), np.inf)
        self.ids = np.zeros((len(queries), k), np.int64)

    def meet(self, corpus: np.ndarray, corpus_ids: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Compares the queries, or those whose numbers are in ``asking``, with more corpus rows."""
        asking = np.arange(len(self.queries)) if asking is None else asking
        for at in range(0, len(corpus), _STEP):
            part, ids = corpus[at : at + _STEP], corpus_ids[at : at + _STEP]
            square = np.einsum("ij,ij->i", part, part)
            for q in range(0, len(asking), _STEP // 4):
                self._meet(asking[q : q + _STEP // 4], part, ids, square)

    def _meet(self, asking, part, ids, square) -> None:
        distance = self.queries[asking] @ part.T
        distance *= -2
        distance += square
        distance += self.square[asking, None]
        bound = self.distances[asking, -1]
        fresh, k = np.flatnonzero(np.isinf(bound)), min(self.k, len(part))
        if len(fresh):
            bound[fresh] = np.partition(distance[fresh], k - 1, axis=1)[:, k - 1]
        # What is left is rounded before ranking, so that the order does not hang on the last bits of a matrix product.
        rows, columns = np.nonzero(distance <= (bound + _SLACK)[:, None])
        if not len(rows):
            return
        found = np.round(np.maximum(distance[rows, columns], 0), 9)
        touched, rows = np.unique(rows, return_inverse=True)
        mine = asking[touched]
        held, places = np.nonzero(np.isfinite(self.distances[mine]))
        rows, ids, found = _k_best(
            np.concatenate([held, rows]),
            np.concatenate([self.ids[mine[held], places], ids[columns]]),
            np.concatenate([self.distances[mine[held], places], found]),
            self.k,
        )
        self.distances[mine] = np.inf
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.distances[mine[rows], place], self.ids[mine[rows], place] = found, ids

    def batches(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(query_ids), _ROWS):
            distances, ids = self.distances[at : at + _ROWS], self.ids[at : at + _ROWS]
            rows, places = np.nonzero(np.isfinite(distances))
            if len(rows):
                columns = [query_ids[at + rows], ids[rows, places], distances[rows, places]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "distance"])


_HIT = "query_id long, vec_id long, distance double"


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each query. The rank limit applies before the shuffle too, so a task sends k rows per query."""
    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return candidates.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact k nearest neighbours by squared L2 distance: ``query_id, vec_id, distance, rank``.

    ``corpus`` has ``vec_id`` and ``embedding``, ``queries`` has ``query_id`` and ``embedding``. Queries of ``block_bytes``
    of vectors at most travel to every task, and the corpus stays where it is. More queries are never held together: the
    corpus is dealt into tiles, and each tile's task holds its tile and a block of queries at a time while all of them pass
    by. Either way a task sends on the k best per query, never a distance per pair.
    """
    near = corpus.select(F.col("vec_id").cast("long"), "embedding")
    asked = queries.select(F.col("query_id").cast("long"), "embedding")
    dimension, few = _few_queries(asked, block_bytes)
    if few is None and not dimension:
        return corpus.sparkSession.createDataFrame([], _HIT + ", rank int")
    if few is not None:
        held = corpus.sparkSession.sparkContext.broadcast(few)
        return _merge(near.mapInArrow(_scan(held, k), _HIT), k)
    tiles = _tiles(corpus.sparkSession, near.count(), dimension)
    dealt = near.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
    return _merge(_meet_tiles(dealt, asked, tiles, k, _in_block(block_bytes, dimension)), k)


def _tiles(spark: SparkSession, count: int, dimension: int) -> int:
    """Tiles of at most ``TILE_BYTES`` on average, and enough for all cores."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-count * dimension * 8 // TILE_BYTES))


def _in_block(block_bytes: int, dimension: int) -> int:
    return max(1, block_bytes // (8 * max(1, dimension)))


def _few_queries(asked: DataFrame, block_bytes: int) -> tuple[int, tuple[np.ndarray, np.ndarray] | None]:
    """The dimension of the queries, and their ids and vectors if all of them fit ``block_bytes``."""
    first = asked.first()
    if first is None:
        return 0, None
    dimension = max(1, len(first.embedding))
    most = _in_block(block_bytes, dimension)
    part = asked.limit(most + 1).toArrow()
    if part.num_rows > most:
        return dimension, None
    return dimension, (part.column("query_id").to_numpy(), _matrix(part.column("embedding")))


def _meet_tiles(corpus: DataFrame, queries: DataFrame, tiles: int, k: int, block: int, compare=None) -> DataFrame:
    """The k nearest rows of ``corpus`` (``tile, vec_id, embedding``) in each tile for each query.

    A tile is a partition: its corpus rows come first, by ``place`` where there is one, and then the queries, in blocks.
    ``queries`` without a ``tile`` go to all. ``compare(nearest, tile_rows, tile_ids, places, extra)`` leaves out what it can.
    """
    if "tile" not in queries.columns:
        queries = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    place = F.col("place") if "place" in corpus.columns else F.lit(0)
    extra = F.col("extra") if "extra" in queries.columns else F.lit(0.0)
    rows = corpus.select("tile", F.lit(False).alias("asks"), place.cast("int").alias("place"), F.lit(0.0).alias("extra"), F.col("vec_id").alias("id"), "embedding")
    asked = queries.select("tile", F.lit(True).alias("asks"), F.lit(0).alias("place"), extra.alias("extra"), F.col("query_id").alias("id"), "embedding")
    dealt = rows.unionByName(asked).repartitionById(tiles, F.col("tile")).sortWithinPartitions("tile", "asks", "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            first = len(asks) - int(asks.sum())  # a partition is one tile, its corpus rows before the queries
            if first:
                rows = batch.slice(0, first)
                parts.append((_matrix(rows.column("embedding")), rows.column("id").to_numpy(), rows.column("place").to_numpy()))
            if first == len(asks) or not parts:
                continue
            if held is None:
                held = tuple(np.concatenate(x) for x in zip(*parts))
                parts = [held]
            for at in range(first, len(asks), block):
                rows = batch.slice(at, block)
                nearest = _Nearest(_matrix(rows.column("embedding")), k)
                if compare:
                    compare(nearest, *held, rows.column("extra").to_numpy())
                else:
                    nearest.meet(held[0], held[1])
                yield from nearest.batches(rows.column("id").to_numpy())

    return dealt.mapInArrow(scan, _HIT)


@dataclass(frozen=True)
class PivotIndex:
    """Vectors stored by their nearest pivot: where, the pivots, and of each the least and greatest distance and the
    number of its vectors."""

    path: str
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray


def build_pivot_index(corpus: DataFrame, pivots: int | None = None) -> PivotIndex:
    """Stores ``vec_id, embedding`` in a folder per pivot.

    Pivots are vectors of the corpus, by default the square root of their number and at most ``MOST_PIVOTS``. Equal vectors and
    a dense region share a folder, which is dealt over several files.
    """
    spark, path = corpus.sparkSession, scratch_path(corpus.sparkSession, "pivots")
    rows = corpus.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null and embedding is not null")
    count = rows.count()
    wanted = pivots or max(1, min(MOST_PIVOTS, math.isqrt(count)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()
    points = _matrix(chosen.column("embedding")) if count else np.zeros((0, 0))
    held = spark.sparkContext.broadcast(points)

    def place(batches):
        points = held.value
        for batch in batches:
            if batch.num_rows:
                distance = _distances(_matrix(batch.column("embedding")), points)
                block = distance.argmin(1)
                away = distance[np.arange(len(block)), block]
                columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(block, pa.int32()), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "block", "away"])

    placed = rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("block", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    salted = placed.repartition("block", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    salted.write.partitionBy("block").parquet(path)
    low, high, counts = np.full(len(points), np.inf), np.full(len(points), -np.inf), np.zeros(len(points), np.int64)
    if count:
        facts = spark.read.parquet(path).groupBy("block").agg(F.min("away"), F.max("away"), F.count("*"))
        for row in facts.toLocalIterator():  # a row per pivot
            low[row[0]], high[row[0]], counts[row[0]] = row[1:]
    return PivotIndex(path, points, low, high, counts)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)
    return np.sqrt(np.maximum(square, 0))


def admitted_blocks(index: PivotIndex, distances: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which blocks (columns) may hold a vector within ``bound`` of each query (rows), from its distances to the pivots.

    A vector at distance r from a pivot is no nearer to the query than the difference of r and the query's distance.
    """
    least = np.maximum(distances - index.high, index.low - distances)
    # Distances come from rounded products: some slack, relative to what was subtracted, lets more in, never less.
    return (index.counts > 0) & (least <= bound[:, None] + 1e-6 * (1 + distances))


def search_pivots(index: PivotIndex, queries: DataFrame, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The same as ``search``, reading only blocks that can hold a neighbour.

    Each query first meets the blocks around it that hold k vectors; its k-th distance there bounds what it is looking
    for. Of the other blocks only those are met whose distances to their pivot leave room for a vector within a
    query's bound, and by these queries alone. Exact by the triangle inequality. Queries that fit ``block_bytes`` travel to
    every task, and blocks none of them needs are not read; more of them pass by the tiles that hold a block they need.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), "embedding")
    dimension, few = _few_queries(asked, block_bytes) if len(index.pivots) else (0, None)
    if few is None and not dimension:
        return spark.createDataFrame([], _HIT + ", rank int")
    path = scratch_path(spark, "hits")
    if few is None:
        return _pivots_in_tiles(index, asked, k, _in_block(block_bytes, dimension), path)
    ids, vectors = few
    distances = _distances(vectors, index.pivots)
    near = _blocks_around(index, distances, k)
    _search_admitted(index, ids, vectors, near, k).write.parquet(f"{path}/near")
    first = spark.read.parquet(f"{path}/near")
    reached = first.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n")).toArrow()
    bound = np.full(len(ids), np.inf)
    where = {q: i for i, q in enumerate(ids.tolist())}
    for q, far, n in zip(*(reached.column(c).to_pylist() for c in ("query_id", "far", "n"))):
        bound[where[q]] = math.sqrt(far) if n >= k else np.inf
    rest = admitted_blocks(index, distances, bound) & ~near
    hits = first.drop("rank").unionByName(_search_admitted(index, ids, vectors, rest, k).drop("rank"))
    return _merge(hits, k)


def _blocks_around(index: PivotIndex, distances: np.ndarray, k: int) -> np.ndarray:
    """As many of the nearest blocks as hold k vectors, for each query."""
    order = np.argsort(distances, axis=1)
    held = np.cumsum(index.counts[order], axis=1)
    near = np.zeros(distances.shape, bool)
    np.put_along_axis(near, order, np.concatenate([np.zeros((len(distances), 1)), held[:, :-1]], 1) < k, 1)
    return near & (index.counts > 0)


def _pivots_in_tiles(index: PivotIndex, asked: DataFrame, k: int, block: int, path: str) -> DataFrame:
    """``search_pivots`` for queries that are not held together.

    A tile is made of neighbouring blocks, a large block of several tiles. A query is sent to the tiles that hold a block it
    needs, once for the blocks around it and once, with its bound, for the others.
    """
    spark, dimension = asked.sparkSession, index.pivots.shape[1]
    most = -(-int(index.counts.sum()) // _tiles(spark, int(index.counts.sum()), dimension))
    pieces = np.maximum(1, -(-index.counts // most))  # of each block
    first = (np.cumsum(index.counts) - index.counts) // most
    tiles = int((first + pieces).max())
    held = spark.sparkContext.broadcast((index, first, pieces))

    def dealt(batches):
        _, first, pieces = held.value
        for batch in batches:
            if batch.num_rows:
                blocks, ids = batch.column("block").to_numpy(), batch.column("vec_id").to_numpy()
                tile = first[blocks] + ids % pieces[blocks]
                columns = [batch.column("vec_id"), batch.column("embedding"), batch.column("block"), pa.array(tile, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "place", "tile"])

    stored = spark.read.schema("vec_id long, embedding array<float>, block int").parquet(index.path)
    corpus = stored.mapInArrow(dealt, "vec_id long, embedding array<float>, place int, tile int")

    def needed(vectors, bound, later):
        """The blocks each query needs, those around it or all others within its bound."""
        index = held.value[0]
        distances = _distances(vectors, index.pivots)
        near = _blocks_around(index, distances, k)
        return admitted_blocks(index, distances, bound) & ~near if later else near

    def sent(later):
        def send(batches):
            _, first, pieces = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, _STEP // 2):
                    batch = whole.slice(at, _STEP // 2)
                    wanted = needed(_matrix(batch.column("embedding")), batch.column("extra").to_numpy(), later)
                    goes = np.zeros((len(wanted), tiles), bool)
                    for b in np.flatnonzero(wanted.any(0)):
                        goes[:, first[b] : first[b] + pieces[b]] |= wanted[:, b, None]
                    rows, tile = np.nonzero(goes)
                    for cut in range(0, len(rows), _ROWS):
                        part = batch.take(pa.array(rows[cut : cut + _ROWS]))
                        columns = [part.column(c) for c in ("query_id", "embedding", "extra")]
                        yield pa.RecordBatch.from_arrays(
                            [*columns, pa.array(tile[cut : cut + _ROWS], pa.int32())], names=["query_id", "embedding", "extra", "tile"]
                        )

        return send

    def compared(later):
        def compare(nearest, rows, ids, places, bound):
            wanted = needed(nearest.queries, bound, later)
            starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            for start, stop in zip(starts, [*starts[1:], len(places)]):
                asking = np.flatnonzero(wanted[:, places[start]])
                if len(asking):
                    nearest.meet(rows[start:stop], ids[start:stop], asking)

        return compare

    def met(queries, later):
        to = queries.mapInArrow(sent(later), "query_id long, embedding array<float>, extra double, tile int")
        return _meet_tiles(corpus, to, tiles, k, block, compared(later))

    _merge(met(asked.withColumn("extra", F.lit(math.inf)), False), k).write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    reached = near.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.sqrt("far")).otherwise(F.lit(math.inf)).alias("extra")
    bounded = asked.join(reached.select("query_id", bound), "query_id", "left").fillna(math.inf, ["extra"])
    return _merge(near.drop("rank").unionByName(met(bounded.select("query_id", "embedding", "extra"), True)), k)


def _search_admitted(index: PivotIndex, ids: np.ndarray, vectors: np.ndarray, admitted: np.ndarray, k: int) -> DataFrame:
    """The k nearest vectors of each query in the blocks that admit it. Blocks that admit none are not read."""
    spark = SparkSession.active()
    wanted = np.flatnonzero(admitted.any(0)).tolist()
    schema = "vec_id long, embedding array<float>, away double, block int"
    rows = spark.read.schema(schema).parquet(index.path).filter(F.col("block").isin(wanted) if wanted else F.lit(False))
    held = spark.sparkContext.broadcast((ids, vectors, admitted))

    def scan(batches):
        ids, vectors, admitted = held.value
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks):
                mine, asking = np.flatnonzero(blocks == block), np.flatnonzero(admitted[:, block])
                if len(asking):
                    part, near = batch.take(pa.array(mine)), _Nearest(vectors[asking], k)
                    near.meet(_matrix(part.column("embedding")), part.column("vec_id").to_numpy())
                    yield from near.batches(ids[asking])

    return _merge(rows.select("vec_id", "embedding", "block").mapInArrow(scan, _HIT), k)


def _scan(held, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        nearest = _Nearest(vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                nearest.meet(_matrix(part.column("embedding")), part.column("vec_id").to_numpy())
        yield from nearest.batches(ids)

    return scan
