"""Set similarity join by chosen paths.

A text is the set of its five-word shingles. A path is a list of tokens; a text is on a path when it holds all of them
and when, at each step, a hash of the path and the token falls below a threshold that lets 1 / similarity tokens through
on average. Similar texts share most tokens, so they stay on common paths; others part after a step or two. Buckets of
paths that hold few texts are compared pair by pair; those that hold many go one step further, and at the last step are
compared in blocks. Independent runs, as many as the recall asked for takes, start from different hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from corpusflow.llm.common import map_texts, mix, shingle_hashes, staged, text_or_empty, with_python, word_hashes
from corpusflow.llm.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
DEPTH = 3
#: Texts of a bucket that goes no further, and texts that a task compares at once in larger ones.
BUCKET = 64
BLOCK = 512
_BINS = 64
_PATH_COLUMNS = {
    "key": pa.binary(),
    "n": pa.int32(),
    "sketch": pa.binary(),
    "b1": pa.list_(pa.int64()),
    "b2": pa.list_(pa.int64()),
    "p2": pa.list_(pa.int32()),
    "b3": pa.list_(pa.int64()),
    "p3": pa.list_(pa.int32()),
}


def runs_needed(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the similarity threshold is found with probability ``recall``.

    A pair at the threshold shares one chosen token per step on average, so that the number of shared paths is a
    critical branching process; deeper paths are rarer, and the deepest are assumed throughout.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def token_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles in order; a text of fewer words is one shingle, a text without words has none."""
    return np.unique(shingle_hashes(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _sketch(tokens: np.ndarray) -> bytes:
    """16 bits of the least token in each of 64 ranges of hashes; 0 marks an empty range. ``tokens`` are in order."""
    out = np.zeros(_BINS, np.uint16)
    bins = (tokens >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = (tokens[first] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out.tobytes()


def _step(tokens: np.ndarray, starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The next buckets of paths that end in ``starts``, and which start each goes on from."""
    if not len(tokens) or not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(tokens)))))
    found, parent = [], []
    width = max(1, (1 << 18) // len(tokens))
    for k in range(0, len(starts), width):
        # Tokens and starts are scrambled already, so that a short hash of the two does.
        h = (tokens[None] ^ starts[k : k + width, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        i, j = np.nonzero(h < limit)
        found.append(mix(h[i, j] ^ starts[k + i]))
        parent.append((k + i).astype(np.int32))
    return np.concatenate(found), np.concatenate(parent)


def _paths(seeds: np.ndarray, similarity: float, width: int):
    """Per text: key, set size, sketch, and the buckets of each step with the index of the bucket before."""

    def describe(texts: list[str]) -> dict[str, pa.Array]:
        hashes, bounds = word_hashes(texts)
        out: dict[str, list] = {name: [] for name in _PATH_COLUMNS}
        for i, text in enumerate(texts):
            tokens = token_set(hashes[bounds[i] : bounds[i + 1]], width)
            out["key"].append(hashlib.md5(text.encode("utf-8", "replace")).digest())
            out["n"].append(len(tokens))
            out["sketch"].append(_sketch(tokens))
            starts = seeds
            for step in range(1, DEPTH + 1):
                starts, parent = _step(tokens, starts, similarity)
                out[f"b{step}"].append(starts.view(np.int64))
                if step > 1:
                    out[f"p{step}"].append(parent)
        return {name: pa.array(out[name], kind) for name, kind in _PATH_COLUMNS.items()}

    return map_texts(describe)


def _whole_groups(batches, name: str):
    """Frames that hold whole groups of equal ``name``, from sorted batches. A group is small."""
    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        ids = batch[name].to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _group_ranges(ids: np.ndarray):
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    return zip(edges[:-1], edges[1:], strict=True)


def _comparable(side: np.ndarray) -> np.ndarray:
    """Pairs to compare in a cell: all (side 0), or those of side 1 with those of side 2. Each pair once."""
    differ = side[:, None] != side[None, :]
    return np.where(side[0] == 0, np.triu(np.ones_like(differ), 1), np.triu(differ, 1))


def _alike(sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose sketches agree as often as six deviations below ``similarity`` allow; some rows at a time."""
    out = np.zeros((len(sketch), len(sketch)), bool)
    step = max(1, (1 << 16) // len(sketch))
    for k in range(0, len(sketch), step):
        part = sketch[k : k + step, None]
        same = ((part == sketch[None]) & (part != 0)).sum(2)
        filled = ((part | sketch[None]) != 0).sum(2)
        out[k : k + step] = same >= similarity * filled - 6 * np.sqrt(similarity * (1 - similarity) * filled) - 1
    return out


def _likely(similarity: float):
    """Drop rows of cells that no other row can equal to ``similarity``: by size, and by sketch with six deviations."""

    def run(batches):
        for frame in _whole_groups(batches, "cell"):
            keep = np.zeros(len(frame), bool)
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(-1, _BINS)
            size, side, ids = frame["n"].to_numpy(float), frame["side"].to_numpy(), frame["cell"].to_numpy()
            for lo, hi in _group_ranges(ids):
                if hi - lo < 2:
                    continue
                s, n = sketch[lo:hi], size[lo:hi]
                near = _alike(s, similarity)
                near &= np.minimum(n[:, None], n[None]) >= similarity * np.maximum(n[:, None], n[None]) - 1e-9
                near &= _comparable(side[lo:hi])
                keep[lo:hi] = near.any(0) | near.any(1)
            yield frame.loc[keep, ["cell", "side", "tid"]]

    return run


def _sets(width: int):
    def describe(texts: list[str]) -> dict[str, pa.Array]:
        hashes, bounds = word_hashes(texts)
        sets = [token_set(hashes[bounds[i] : bounds[i + 1]], width).tobytes() for i in range(len(texts))]
        return {"tokens": pa.array(sets, pa.binary())}

    return map_texts(describe)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by columns of an incidence matrix, some thousands at a time."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(tokens), 1 << 14):
        a, b = np.searchsorted(column, (lo, lo + (1 << 14)))
        block = np.zeros((len(sets), min(1 << 14, len(tokens) - lo)), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    return out


def _compared_before(cell: int, cells: list[dict[int, int]]) -> np.ndarray:
    """Pairs that a cell before this one compares. ``cells``: each member's cells with its side in them."""
    seen = np.zeros((len(cells), len(cells)), bool)
    for c in sorted({c for own in cells for c in own if c < cell}):
        side = np.array([own.get(c, -1) for own in cells])
        if (side == 0).any():
            seen |= (side == 0)[:, None] & (side == 0)[None]
        else:
            seen |= (side == 1)[:, None] & (side == 2)[None]
            seen |= (side == 2)[:, None] & (side == 1)[None]
    return seen


def _links(similarity: float):
    """Exact links of each cell, each pair in the first cell that compares it: link counts, and a tree of links."""

    def run(batches):
        for frame in _whole_groups(batches, "cell"):
            frame = frame.drop_duplicates(["cell", "tid"]).reset_index(drop=True)
            ids = frame["cell"].to_numpy()
            out = []
            for lo, hi in _group_ranges(ids):
                if hi - lo < 2:
                    continue
                part = frame.iloc[lo:hi]
                tid, copies = part["tid"].to_numpy(), part["copies"].to_numpy()
                side, cells = part["side"].to_numpy(), [dict(c) for c in part["cells"]]
                sets = [np.frombuffer(b, np.uint64) for b in part["tokens"]]
                size = np.array([len(s) for s in sets], float)
                both = _overlaps(sets)
                linked = _comparable(side) & (both >= similarity * (size[:, None] + size[None] - both) - 1e-9)
                linked &= ~_compared_before(ids[lo], cells)
                linked |= linked.T
                texts, docs, root = linked.sum(1), linked @ copies, np.arange(hi - lo)
                while True:
                    least = np.minimum(root, np.where(linked, root[None], hi - lo).min(1))
                    if (least == root).all():
                        break
                    root = least[least]
                out += [(tid[i], tid[root[i]], texts[i], docs[i]) for i in np.flatnonzero(texts)]
            yield pd.DataFrame(out, columns=["a", "b", "texts", "docs"])

    return run


def similar_classes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_links, n_text_links`` for every row of ``docs`` (doc_id, text, any other columns).

    Two texts are linked when the Jaccard similarity of their shingle sets is ``similarity`` or more, checked exactly.
    ``class_id`` is the least doc_id that links lead to, ``n_links`` counts the linked rows, copies among them, and
    ``n_text_links`` the linked texts other than the row's own. Rows without words (null or empty texts) have no links
    and are each their own class; a null doc_id is never the class of rows that have one. Rows equal in doc_id and
    text count as copies. ``options``: those of ``keyed_classes``.
    """
    return keyed_classes(docs, **options).drop("key", "class_key")


def keyed_classes(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = 0.995, seed: int = 11
) -> DataFrame:
    """``similar_classes`` with ``key``, the MD5 of the text, and ``class_key``, that of the class's first text: by doc_id,
    null last, then key. ``recall`` sets the number of runs.
    """
    with_python(docs.sparkSession)
    runs = runs_needed(recall)
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *from_arrow_schema(pa.schema(_PATH_COLUMNS.items()))])
    paths = staged(rows.mapInArrow(_paths(seeds, similarity, width), schema), "paths")
    counted = paths.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"),
        F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("n", "sketch", "b1", "b2", "p2", "b3", "p3")],
    )
    texts = staged(counted.withColumn("tid", F.monotonically_increasing_id()), "texts")

    cells = staged(_cells(texts), "cells")
    sketched = cells.join(texts.select("tid", "n", "sketch"), "tid").repartition("cell").sortWithinPartitions("cell")
    likely = staged(sketched.mapInPandas(_likely(similarity), "cell long, side int, tid long"), "likely")
    own = likely.groupBy("tid").agg(F.map_from_entries(F.collect_set(F.struct("cell", "side"))).alias("cells"))
    asked = own.join(texts.select("tid", "key", "doc_id", "copies"), "tid")
    keyed = rows.withColumn("key", F.unhex(F.md5(text_or_empty())))
    wanted = keyed.join(
        asked.withColumnRenamed("doc_id", "first_doc").withColumnRenamed("key", "first_key"),
        F.expr("doc_id <=> first_doc and key = first_key"),
    ).select("tid", "copies", "cells", "text")
    sets = wanted.mapInArrow(_sets(width), "tid long, copies long, cells map<long,int>, tokens binary")
    spread = (
        sets.select("tid", "copies", "tokens", "cells", F.explode("cells").alias("cell", "side"))
        .repartition("cell")
        .sortWithinPartitions("cell")
    )
    links = staged(spread.mapInPandas(_links(similarity), "a long, b long, texts long, docs long"), "links")
    return _classes(paths, texts, links)


def _cells(texts: DataFrame) -> DataFrame:
    """``tid, cell, side``: which texts to compare. Buckets of equal members appear once."""

    def counted(step: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        step = staged(step, label)
        agg = step.groupBy("bucket").agg(
            F.count("*").alias("members"),
            F.bit_xor(F.xxhash64("tid")).alias("x1"),
            F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("x2"),
        )
        return step, staged(agg.filter("members > 1"), f"{label}-counts")

    steps, leaves = [], []
    step, counts = counted(texts.select("tid", F.explode("b1").alias("bucket")), "step1")
    for depth in range(2, DEPTH + 2):
        last = depth > DEPTH
        steps.append(step)
        leaves.append(counts if last else counts.filter(F.col("members") <= BUCKET))
        if not last:
            big = counts.filter(F.col("members") > BUCKET).select(F.col("bucket").alias("before"))
            following = texts.select(
                "tid", F.expr(f"inline(arrays_zip(transform(p{depth}, i -> b{depth - 1}[i]), b{depth}))")
            ).toDF("tid", "before", "bucket")
            step, counts = counted(following.join(big, "before").select("tid", "bucket"), f"step{depth}")
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    once = staged(leaf.groupBy("members", "x1", "x2").agg(F.min("bucket").alias("bucket")), "buckets")
    members = steps[0].join(once, "bucket")
    for more in steps[1:]:
        members = members.union(more.join(once, "bucket"))
    blocked = members.select(
        "tid",
        "bucket",
        F.ceil(F.col("members") / BLOCK).alias("blocks"),
        F.expr(f"pmod(xxhash64(tid, bucket), ceil(members / {BLOCK}))").alias("block"),
    )
    return blocked.select("tid", "bucket", "block", F.expr("explode(sequence(0, blocks - 1)) as other")).select(
        "tid",
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        F.expr("cast(case when block = other then 0 when block < other then 1 else 2 end as int)").alias("side"),
    )


def _classes(paths: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("a").agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("n_docs"))
    labels = connected_components(links.select("a", "b"))
    named = (
        labels.join(texts.select(F.col("tid").alias("node"), "doc_id", "key"), "node")
        .groupBy("label")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
        .select("label", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"))
    )
    linked = staged(
        labels.join(named, "label")
        .join(counts.withColumnRenamed("a", "node"), "node")
        .select(F.col("node").alias("tid"), "class_id", "class_key", "n_texts", "n_docs"),
        "linked",
    )
    described = staged(
        texts.select("tid", "key", "doc_id", "copies")
        .join(linked, "tid", "left")
        .select(
            "key",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("class_key", "key").alias("class_key"),
            (F.col("copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"),
            F.coalesce("n_texts", F.lit(0)).alias("n_text_links"),
        ),
        "described",
    )
    with_words = paths.filter("n > 0").select("key", "doc_id").join(described, "key")
    none = F.lit(0).cast("long")
    without = paths.filter("n = 0").select(
        "key", "doc_id", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"), none.alias("n_links"), none.alias("n_text_links")
    )
    return with_words.union(without)


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, by doc_id (null last), then by the hash of the text, unchanged.

    Rows that repeat the first's doc_id and text are the same document and stay with it; near copies that only share
    its doc_id, or have none, go.
    """
    classes = keyed_classes(docs, **options).filter("n_links > 0 and not (doc_id <=> class_id and key = class_key)")
    gone = staged(classes.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.unhex(F.md5(text_or_empty())) == gone["gone_key"])
    return docs.join(gone, same, "left_anti")
