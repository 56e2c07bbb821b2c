"""Delimited files read in splits."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest

from corpusflow.sources import delimited
from corpusflow.sources.delimited import delimited_lines, file_lines
from corpusflow.sources.formats import csv


@contextmanager
def small_splits(spark, size):
    """Files are cut into splits of ``size`` bytes, and the lines into several partitions."""
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_of_all_separators(spark, tmp_path):
    files = {
        "a.csv": 'n,v,,n\n1,"x, ""y""",z,4\n\n,, ,\nNA,null,keep,\n5,6,7,8\n',
        "sub/b c+d.CSV": "n;v\r\n 1 ;2,3\r\n",
        "t.csv": "a\tb\nc\td",
        "p.csv": "a|b\nc|d",
        "one.csv": "only\nx\n",
        "header.csv": "a,b",
        "late.csv": '\n  \n""\na,b\n1,2',
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content, newline="")
    got = sorted((r.rel_path, r.pos, r.line) for r in delimited_lines(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", 0, 'n: 1 | v: x, "y" | Unnamed: 2: z | n.1: 4'),
        ("a.csv", 3, "Unnamed: 2: keep"),
        ("a.csv", 4, "n: 5 | v: 6 | Unnamed: 2: 7 | n.1: 8"),
        ("late.csv", 0, "a: 1 | b: 2"),
        ("one.csv", 0, "only: x"),
        ("p.csv", 0, "a: c | b: d"),
        ("sub/b c+d.CSV", 0, "n: 1 | v: 2,3"),
        ("t.csv", 0, "a: c | b: d"),
    ]


def cell(rng):
    plain = rng.choice(["x", "5 in", " padded ", "NA", "", 'mid"dle', 'a "b" c', "é中"])
    if rng.random() < 0.6:
        return plain
    inner = "".join(rng.choices(["a", "bc", ",", "\n", "\n\n", '""', ";", "\r\n", " "], k=rng.randint(0, 8)))
    return f'"{inner}"' + rng.choice(["", "", "", "tail", 'odd"'])


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_equals_the_reader_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    for f in range(12):
        header = ",".join(['"a\nname"', "b", '"c"'][: rng.randint(1, 3)])
        width = header.count(",") + 1
        records = [",".join(cell(rng) for _ in range(width)) for _ in range(rng.randint(0, 60))]
        content = "\n" * (f % 3) + "\n".join([header, *records]) + ("\n" if f % 2 else "")
        # One file's last quote is never closed, and one has a byte order mark.
        content = ("﻿" if f == 4 else "") + content + ('\n"open,\n,' if f == 5 else "")
        (tmp_path / f"f{f}.csv").write_bytes(content.encode())
    with small_splits(spark, size):
        rows = delimited_lines(spark, str(tmp_path), separators=(",",)).collect()
    assert not [r for r in rows if r.error]
    for f in range(12):
        pages = csv((tmp_path / f"f{f}.csv").read_bytes(), "f.csv")
        lines = [r.line for r in sorted(rows, key=lambda r: r.pos) if r.rel_path == f"f{f}.csv"]
        assert "\n".join(lines) == (pages[0].text if pages else "")


def test_what_cannot_be_shown_has_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "HEADER_LINES", 5)
    files = {
        "ragged.csv": 'a,b\n1,"x\ny"\n2,z,extra\n3,w\n',
        "long.csv": 'a,b\n1,"' + "y\n" * 50 + '"\n2,z\n',
        "blank.csv": " \n\n",
        "header.csv": '"' + "a\n" * 9 + '",b\n1,2\n',
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    got = sorted((r.rel_path, r.pos, r.line, r.error) for r in delimited_lines(spark, str(tmp_path), record_chars=60).collect())
    assert got == [
        ("blank.csv", 0, None, "no columns to read"),
        ("header.csv", 0, None, "the header has more than 5 lines"),
        ("long.csv", 0, None, "a record of 104 characters is too long"),
        ("long.csv", 1, "a: 2 | b: z", None),
        ("ragged.csv", 0, "a: 1 | b: x\ny", None),
        ("ragged.csv", 1, None, "2 columns expected, 3 found"),
        ("ragged.csv", 2, "a: 3 | b: w", None),
    ]


def test_places_over_many_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("".join(f"line {i}\n" for i in range(20_000)))
    with small_splits(spark, 10_000):
        rows = file_lines(spark, str(tmp_path), ("csv",)).collect()
    assert sorted((r.pos, r.value) for r in rows) == [(i, f"line {i}") for i in range(20_000)]


def test_long_cells_take_no_stack(spark, tmp_path):
    quoted = '"' + 'a""b,' * 40_000 + '"'
    (tmp_path / "wide.csv").write_text(f'a,b\n{quoted},{",".join([])}x\n{"y" * 100_000},z\n')
    rows = {r.pos: r.line for r in delimited_lines(spark, str(tmp_path)).collect()}
    assert rows == {0: "a: " + 'a"b,' * 40_000 + " | b: x", 1: f'a: {"y" * 100_000} | b: z'}
