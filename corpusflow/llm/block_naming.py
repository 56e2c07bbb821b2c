"""Exact copies by deterministic block naming.

A text without its white space is cut into blocks of equal size. Equal blocks get the same integer name, numbers along
the sorted list of all distinct blocks. Names of neighbours are then paired, equal pairs get the same name again, and so on
until one name is left of each text: the texts of one name are equal, and no others are. Built-in functions only.

A block travels once, to where its distinct values are counted, and copies are combined before. What is joined and paired
afterwards are 128-bit keys; the count of distinct blocks per key has shown by then that no two blocks of the corpus share
one, else other keys are taken. A text that holds a name found nowhere else has no copy and needs no more levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.common import discard, staged, text_or_empty

#: What texts are compared without.
BLANKS = r"[\x20\x09-\x0D]+"


def without_blanks(column: str = "text") -> Column:
    """The text without the characters of ``BLANKS``; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), BLANKS, "")


def _blocks(text: Column, size: int) -> Column:
    """The UTF-8 bytes of a text in blocks of ``size``, the last one shorter; one empty block of an empty text."""
    data = text.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def block_key(block: Column, attempt: int) -> list[Column]:
    """Two 64-bit hashes of a block, others at every attempt."""
    return [F.xxhash64(F.lit(2 * attempt + k), block).alias(f"k{k + 1}") for k in range(2)]


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """A ``name`` for each row of ``keys``: its place in the sorted order within its partition, stored."""
    return staged(keys.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def block_names(docs: DataFrame, size: int, keys=block_key, attempts: int = 16) -> tuple[DataFrame, int]:
    """``k1, k2, times, name`` per distinct block, and the attempt whose keys no two blocks share."""
    for attempt in range(attempts):
        bare = docs.select(without_blanks().alias("_bare"))  # a column of its own: blocks refer to it many times
        block = bare.select(F.explode(_blocks(F.col("_bare"), size)).alias("block"))
        counted = block.groupBy(*keys(F.col("block"), attempt), "block").agg(F.count("*").alias("times"))
        names = _named(counted.select("k1", "k2", "times"), ["k1", "k2"])
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return names, attempt
        discard(names)
    raise RuntimeError(f"blocks shared a key in each of {attempts} attempts")


def text_identities(docs: DataFrame, size: int = 1024, keys=block_key) -> tuple[DataFrame, DataFrame]:
    """``docs`` without the text but with ``_row, _chars, _sha`` (code points of the text, digest of what is compared),
    and an identity ``_row, level, name`` for each text that may have an equal one: equal texts have the same.
    """
    names, attempt = block_names(docs, size, keys)
    # Row numbers are stored with what is known of the text, so that no later pass can number rows otherwise.
    bare = docs.withColumns({"_chars": F.length(text_or_empty()).cast("long"), "_bare": without_blanks()})
    rows = staged(
        bare.select(
            *[F.col(c) for c in docs.columns if c != "text"],
            "_chars",
            F.unhex(F.sha2(F.col("_bare").cast("binary"), 256)).alias("_sha"),
            F.transform(
                _blocks(F.col("_bare"), size), lambda b: F.struct(*[k for k in keys(b, attempt)])
            ).alias("_keys"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "rows",
    )
    parts = rows.select("_row", F.posexplode("_keys").alias("pos", "key")).select("_row", "pos", "key.*")
    by, level, done = ["k1", "k2"], 0, []
    while True:
        named = parts.join(names, by).select("_row", "pos", "name", "times")
        row = Window.partitionBy("_row")
        paired = named.select(
            "_row",
            "pos",
            F.col("name").alias("left"),
            F.lead("name", 1, -1).over(row.orderBy("pos")).alias("right"),
            F.min("times").over(row).alias("least"),
        )
        # Pairs of this level, and in pos 0 also the names that stand alone: those are whole texts.
        pairs = staged(
            paired.filter("least > 1 and pos % 2 = 0").select(
                "_row", F.expr("cast(pos div 2 as int)").alias("pos"), "left", "right",
                F.max("pos").over(row).alias("last"),
            ),
            "pairs",
        )
        discard(names)
        done.append(
            pairs.filter("last = 0 and right = -1").select("_row", F.lit(level).alias("level"), F.col("left").alias("name"))
        )
        parts = pairs.filter("not (last = 0 and right = -1)").drop("last")
        by, level = ["left", "right"], level + 1
        if parts.isEmpty():
            break
        names = _named(parts.groupBy(*by).agg(F.count("*").alias("times")), by)
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    return rows.drop("_keys"), found


def group_copies(docs: DataFrame, size: int = 1024, keys=block_key) -> DataFrame:
    """``docs`` without the text, and ``keep_id, group_size, kept, text_sha256`` of each row.

    Texts are equal when they are identical without white space; null counts as empty, and empty texts are equal. Of equal
    texts the row with the most code points in its text stays, then that with the smallest ``doc_id``, a null one last; of
    rows alike in both, one. ``keep_id`` is the doc_id of the row that stays. Columns of the input that have one of the new
    names, or one of ``_row, _chars, _sha, _keys``, are left out. An empty table gives an empty one.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256", "_row", "_chars", "_sha", "_keys", "_bare")
    rows, found = text_identities(docs, size, keys)
    order = F.struct(
        (-F.col("_chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("_row")
    )
    identity = found.join(rows.select("_row", "_chars", "doc_id"), "_row")
    groups = identity.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    member = identity.select("_row", "level", "name").join(groups.filter("group_size > 1"), ["level", "name"])
    member = member.select("_row", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first._row").alias("keep"))
    return rows.join(member, "_row", "left").select(
        *[F.col(c) for c in docs.columns if c != "text"],
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, size: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and their text as it was (see ``group_copies``)."""
    numbered = staged(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")
    kept = group_copies(numbered.select("row.doc_id", "row.text", "place"), size).filter("kept").select("place")
    return numbered.join(kept, "place", "left_semi").select("row.*")
