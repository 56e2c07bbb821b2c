"""Row lines, and table packing in blocks against packing in one go."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import tabular
from corpusflow.operators.chunking import chunk_texts
from corpusflow.operators.tabular import chunk_lines, serialise_rows


def test_blank_cells_and_rows_are_left_out(spark):
    df = spark.createDataFrame([(1, " a ", None), (2, "  ", ""), (3, None, "007")], "id int, x string, y string")
    got = serialise_rows(df, {"x": F.col("x"), "why": F.col("y")}, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x: a"), (3, "why: 007")]


@pytest.mark.parametrize(
    "size, overlap, block, fan",
    [(500, 2, 20_000, 256), (60, 2, 100, 2), (60, 0, 64, 3), (60, 7, 70, 256), (500, 50, 300, 2), (20, 3, 30, 4)],
)
def test_blocks_equal_one_pass(spark, size, overlap, block, fan):
    rng = random.Random(size * 100 + overlap)
    lengths = [1, 2, 5, 30, 31, 60, 120, 499, 500, 501, 700]
    rows = [(g, i * 3, chr(97 + i % 26) * rng.choice(lengths)) for g, n in enumerate([900, 37, 1, 300]) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, pos long, line string").repartition(6)
    got = {(r.g, r.chunk_index): r.text for r in chunk_lines(df, ["g"], size=size, overlap=overlap, block_lines=block, fan=fan).collect()}
    expected = {}
    for g in range(4):
        text = "\n".join(line for group, _, line in rows if group == g)
        expected |= {(g, i): c for i, c in enumerate(chunk_texts(text, size, overlap))}
    assert got == expected


def test_table_that_fills_its_last_block(spark):
    rows = [("g", i, "x" * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, pos long, line string")
    got = [r.text for r in chunk_lines(df, ["g"], size=90, overlap=1, block_lines=200).orderBy("chunk_index").collect()]
    assert got == chunk_texts("\n".join("x" * 20 for _ in range(400)), 90, 1)


def test_cell_with_newlines_becomes_several_lines(spark):
    df = spark.createDataFrame([("g", 0, "a: 1\n\n b: " + "x" * 40)], "g string, pos long, line string")
    assert chunk_lines(df, ["g"]).first().text == "a: 1\nb: " + "x" * 40


def test_lines_are_stripped_and_blank_ones_take_no_number(spark):
    rows = [("g", i, ["  a" + "x" * 20 + " ", " ", "b" * 25, ""][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, pos long, line string")
    got = [r.text for r in chunk_lines(df, ["g"], size=90, block_lines=100).orderBy("chunk_index").collect()]
    assert got == chunk_texts("\n".join(r[2] for r in rows), 90, 2)


def test_no_task_sees_more_than_a_fan_of_blocks(spark, monkeypatch):
    fan, largest = 4, []
    walk, compose = tabular._walk, tabular._compose

    def counted(answers, over):
        largest.append(answers.groupBy("g", over).count().agg(F.max("count")).first()[0])

    def walked(answers, groups, keys):
        counted(answers, F.col("_over"))
        return walk(answers, groups, keys)

    def composed(answers, groups, fan):
        counted(answers, F.floor(F.col("_block") / fan))
        return compose(answers, groups, fan)

    monkeypatch.setattr(tabular, "_walk", walked)
    monkeypatch.setattr(tabular, "_compose", composed)
    rows = [("g", i, "x" * 30) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, pos long, line string")
    chunks = chunk_lines(df, ["g"], size=60, overlap=1, block_lines=62, fan=fan).orderBy("chunk_index")
    assert [r.text for r in chunks.collect()] == chunk_texts("\n".join("x" * 30 for _ in range(6000)), 60, 1)
    # 97 blocks in levels of 97, 25, 7 and 2.
    assert len(largest) == 7 and max(largest) == fan
