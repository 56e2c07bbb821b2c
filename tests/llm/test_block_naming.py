import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.block_naming import block_key, block_names, drop_copies, group_copies
from llm_helpers import DOCUMENT, FOLDER, documents, needs_tables


def plain(rows):
    """doc_id to (keep_id, group_size, kept, digest), by comparing texts; doc_ids are unique."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i))
    out = {}
    for body, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for m in members:
            out[m[2]] = (first[2], len(members), m == first, hashlib.sha256(body.encode()).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def weak(block, attempt):
    """Keys that blocks share at the first attempts."""
    if attempt < 2:
        return [(F.octet_length(block) % 3).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")]
    return block_key(block, attempt)


def hard_texts(seed):
    """Texts of several levels that share blocks, ends and lengths."""
    draw = random.Random(seed)
    parts = ["".join(draw.choice("abé中 \n") for _ in range(draw.randint(1, 9))) for _ in range(6)]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(60)]
    return texts + [t.replace(" ", "\t\x0b\x0c\r ") for t in texts[::3]] + [t + "x" for t in texts[::7]] + [t[:-1] for t in texts[::5]]


@pytest.mark.parametrize("size", [1, 4, 7, 1024])
def test_equals_comparison_of_texts(spark, size):
    rows = [*enumerate(hard_texts(size)), (None, hard_texts(size)[1])]
    assert found(group_copies(documents(spark, rows), size)) == plain(rows)


def test_keys_that_blocks_share_are_replaced(spark):
    rows = list(enumerate(hard_texts(3)))
    docs = documents(spark, rows)
    assert block_names(docs, 5, weak)[1] == 2
    assert found(group_copies(docs, 5, weak)) == plain(rows)
    with pytest.raises(RuntimeError):
        block_names(docs, 5, weak, attempts=2)


@needs_tables
def test_equals_comparison_on_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = found(group_copies(docs))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert any(not r[2] for r in got.values())


def test_large_group_in_many_partitions(spark):
    copies = [(i, "one text " * 300 + " " * (i % 3)) for i in range(600)]
    rows = copies + [(1000 + i, f"{i} " * 900) for i in range(40)]
    assert found(group_copies(documents(spark, rows).repartition(40), 256)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (5, "ab"), (None, "a  b"), (None, "z"), (6, " "), (7, "x" * 300_000), (8, "x" * 300_000 + " "), (9, "x" * 300_001)]
    docs = documents(spark, rows).selectExpr("*", "1 as kept", "2 as _row", "3 as k1", "4 as name", "5 as pos")
    out = group_copies(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "k1", "name", "pos", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out.collect()))
    assert got == [
        (0, 0, 1, True), (0, 0, 4, True), (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 0, 4, False),
        (4, 0, 4, False), (5, 0, 4, False), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True),
    ]
    assert group_copies(docs.limit(0)).count() == 0


def test_rows_that_stay_keep_their_text(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, None), (4, " "), (5, "c"), (5, "c")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENT).selectExpr("*", "'k' as place")
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "a  b"), (4, " "), (5, "c")]
