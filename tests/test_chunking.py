"""Packing rules, boundaries and the agreement of the several forms."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators.chunking import (
    as_pages,
    chunk_documents,
    chunk_documents_native,
    chunk_page_rows,
    chunk_texts,
    clean_lines,
    pack,
    with_chunk_ids,
)
from corpusflow.operators.ordinals import dense_order, running_total

LINES = st.lists(st.text("ab ", min_size=0, max_size=90), max_size=40)


def slow_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Packing by growing a list line by line, joined anew at every step."""
    kept, held = [], []
    for line in clean_lines(text):
        if held and len("\n".join([*held, line])) > size:
            kept.append("\n".join(held))
            held = held[len(held) - overlap :] if 0 < overlap < len(held) else (held if overlap else [])
        held = [*held, line]
    if held:
        kept.append("\n".join(held))
    return [c for c in kept if len(c) > 30]


@settings(max_examples=300, deadline=None)
@given(LINES, st.integers(1, 300), st.integers(0, 60))
def test_binary_search_equals_growing_a_list(lines, size, overlap):
    text = "\n".join(lines)
    assert chunk_texts(text, size, overlap) == slow_chunks(text, size, overlap)


@given(LINES, st.integers(1, 300))
def test_without_overlap_the_spans_partition_the_lines(lines, size):
    lengths = [len(x) for x in clean_lines("\n".join(lines))]
    spans = pack(lengths, size, 0)
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(lengths)))


def test_short_chunks_are_dropped_and_take_no_index(spark):
    text = "\n".join(["a" * 30, "b" * 600, "c" * 31])
    rows = chunk_documents(spark.createDataFrame([(1, text)], "id int, text string").select("id", as_pages(F.col("text")).alias("pages")), overlap=0).collect()
    assert [(r.chunk_index, r.char_count) for r in rows] == [(0, 600), (1, 31)]


def test_boundaries():
    assert chunk_texts("a" * 30, 500, 2) == []
    assert chunk_texts("a" * 31, 500, 2) == ["a" * 31]
    assert [len(c) for c in chunk_texts("a" * 501 + "\n" + "b" * 40, 500, 0)] == [501, 40]
    # Exactly the size fits: 249 + 1 + 250.
    assert [len(c) for c in chunk_texts("a" * 249 + "\n" + "b" * 250, 500, 0)] == [500]
    assert [len(c) for c in chunk_texts("a" * 250 + "\n" + "b" * 250, 500, 0)] == [250, 250]
    # Context lines and the new line are not checked again.
    assert [len(c) for c in chunk_texts("a" * 400 + "\n" + "b" * 400, 500, 2)] == [400, 801]
    assert chunk_texts(" \n\t\n", 500, 2) == []
    assert chunk_texts("　a" + "b" * 31 + "\xa0", 500, 2) == ["a" + "b" * 31]


def test_a_large_overlap_keeps_the_whole_buffer():
    chunks = chunk_texts("\n".join("x" * 100 for _ in range(20)), 500, 50)
    assert [c.count("\n") + 1 for c in chunks] == [4, *range(5, 20), 20]


def test_index_runs_through_pages_and_chunks_do_not_cross_them(spark):
    pages = [(3, "c" * 40), (1, "a" * 40), (2, "   "), (4, "short")]
    docs = spark.createDataFrame([("d", [(n, t) for n, t in pages], {"k": "v"})], "doc_id string, pages array<struct<page int, text string>>, extra map<string,string>")
    rows = with_chunk_ids(chunk_documents(docs)).orderBy("chunk_index").collect()
    # Pages are taken in array order.
    assert [(r.page, r.chunk_index, r.chunk_id, r.extra["k"]) for r in rows] == [
        (3, 0, "d_chunk_0000", "v"),
        (1, 1, "d_chunk_0001", "v"),
    ]


def test_null_pages_and_null_text_give_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, [(1, None)])], "id int, pages array<struct<page int, text string>>")
    assert chunk_documents(docs).count() == 0


def test_page_rows_equal_pages_in_one_row(spark):
    rows = [(d, p, "\n".join(f"{d}-{p}-{i} " + "x" * ((i * 37) % 120) for i in range(p % 7))) for d in range(3) for p in range(1, 40)]
    pages = spark.createDataFrame(rows, "doc int, page int, text string")
    grouped = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    columns = ["doc", "page", "chunk_index", "text", "char_count"]
    expected = sorted(map(tuple, chunk_documents(grouped, 150, 2).select(columns).collect()))
    got = sorted(map(tuple, chunk_page_rows(pages.repartition(5), ["doc"], size=150).select(columns).collect()))
    assert got == expected and len(got) > 100


def test_built_in_form_agrees(spark):
    texts = [("\n".join("y" * ((i * j) % 130) for i in range(j)),) for j in range(1, 60)]
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, text string")
    for overlap in (0, 2, 5):
        native = chunk_documents_native(docs, size=200, overlap=overlap)
        arrow = chunk_documents(docs.select("id", as_pages(F.col("text")).alias("pages")), 200, overlap)
        columns = ["id", "chunk_index", "page", "text", "char_count"]
        assert sorted(map(tuple, native.select(columns).collect())) == sorted(map(tuple, arrow.select(columns).collect()))


@pytest.mark.parametrize("dense", [True, False])
def test_running_total_of_one_hot_group(spark, dense):
    rng = random.Random(3)
    places = range(0, 6000, 3) if dense else [rng.randrange(-(2**62), 2**62) for _ in range(2000)]
    rows = [("hot", p, i % 5) for i, p in enumerate(places)] + [("cold", i, 1) for i in range(10)] + [(None, 1, 1), ("hot", None, 1)]
    df = spark.createDataFrame(rows, "g string, pos long, v long").repartition(7)
    out = running_total(df, ["g"], "pos", "v", "total")
    got = {(r.g, r.pos): r.total for r in out.collect()}
    expected, sums = {}, {}
    for g, pos, v in sorted(r for r in rows if None not in r):
        expected[g, pos] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert got == expected


def test_dense_order_by_path_parts(spark):
    names = ["b", "a/z", "a", "a/b/c", "a-b", "c/d"] * 1
    df = spark.createDataFrame([(g, n, 2) for g in ("x", "y") for n in names], "g string, path string, n int").repartition(3)
    out = dense_order(df, ["g"], [F.split("path", "/")], "n", "base").filter("g = 'x'").orderBy("base").collect()
    assert [r.path for r in out] == sorted(names, key=lambda p: p.split("/"))
    assert [r.base for r in out] == [0, 2, 4, 6, 8, 10]
