import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import fill_middle
from corpusflow.llm.fill_middle import arrange, choose, fill_in_middle, rebuild, restore, rotate
from llm_helpers import FOLDER, documents, needs_tables


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by joining lists of units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(df):
    return {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 60))
def test_rotation_exchanges_blocks(values, a, b, c):
    first, cut, last = sorted(min(x, len(values)) for x in (a, b, c))
    data = np.array(values, np.uint8)
    rotate(data, first, cut, last)
    assert data.tolist() == values[:first] + values[cut:last] + values[first:cut] + values[last:]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="abZ<>PSM 中é\n1", max_size=40))
def test_forms_and_way_back(doc_id, text):
    data = text.encode()
    n, form, middle, suffix = choose(doc_id, data)
    output = bytes(arrange(data, form, middle, suffix))
    want = plain(doc_id, text)
    assert (n, form, output.decode()) == (want[0], want[1], want[4])
    assert bytes(rebuild(output, form)) == data


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "_PIECE", piece)
    draw = random.Random(2)
    for i in range(60):
        text = "".join(draw.choices("abcé中 .\n", k=draw.randint(0, 50)))
        data = text.encode()
        n, form, middle, suffix = choose(i, data)
        assert (n, form, bytes(arrange(data, form, middle, suffix)).decode()) == tuple(plain(i, text)[x] for x in (0, 1, 4))


@needs_tables
def test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given_rows = {r.doc_id: r.text for r in docs.collect()}
    examples = fill_in_middle(docs)
    got = made(examples)
    assert got == {i: plain(i, t) for i, t in given_rows.items()}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}
    assert {r.doc_id: r.text for r in restore(examples).collect()} == given_rows


def test_odd_rows(spark):
    long = "Wörd and 中文. " * 700_000
    rows = [(None, "no number here"), (1, None), (2, ""), (3, "has <M> inside"), (4, "same"), (4, "same"), (5, long), (6, "x"), (-7, "minus seven")]
    docs = documents(spark, rows).selectExpr("*", "'x' as output", "1 as n", "2 as _id2", "3 as middle")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_id2", "middle", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made(out) == {i: plain(i, t) for i, t in rows} and out.count() == len(rows)
    back = sorted(((r.doc_id or 0, r.text) for r in restore(out).collect()))
    assert back == sorted(((i or 0, t or "") for i, t in rows))
    assert restore(fill_in_middle(docs.limit(0))).count() == 0
