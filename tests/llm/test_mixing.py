import re

import numpy as np
import pytest

from corpusflow.llm.mixing import mixture, mixture_shares, permuted, plan, targets
from llm_helpers import DOCUMENT, FOLDER, needs_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes):
    """The rule followed step by step: deal, stop at twice the size, deal the excess again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, left = [0.0] * len(sizes), 1.5 * sum(sizes)
    while left > 1e-9:
        free = [i for i, n in enumerate(sizes) if out[i] < 2 * n - 1e-9]
        if not free:
            break
        total = sum(weights[i] for i in free)
        for i in free:
            out[i] += left * weights[i] / total
        left = 0.0
        for i, n in enumerate(sizes):
            left += max(0.0, out[i] - 2 * n)
            out[i] = min(out[i], 2.0 * n)
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [100, 1, 1], [1, 1, 1000, 5], [0, 5, 7], [3], [0, 0], [], [9] * 7])
def test_targets(sizes):
    assert targets(sizes) == pytest.approx(slow_targets(sizes), abs=1e-6)


def test_permutation():
    for size in (1, 2, 3, 17, 64, 1000):
        got = permuted(np.arange(size), np.full(size, size), np.full(size, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(size))


def test_plan_meets_quotas():
    made = plan([("b", 6400), ("a", 640), (None, 64), ("c", 0)], 64, 8, 1)
    assert made.sources == ["a", "b", "c", None]
    want = [round(t / 64) for t in made.targets]
    assert made.counts.sum(axis=0).tolist() == want and (made.counts >= 0).all()
    assert plan([], 64, 8, 1).counts.sum() == 0


def check(docs, block=64):
    """Contract of the shares, and the mixture's pieces against the texts they come from."""
    rows = [r.asDict() for r in docs.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    got = mixture_shares(docs, block=block).collect()
    assert len(got) == len(rows)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(r["text"]) for r in rows if r["source"] == s) for s in names]
    want = dict(zip(names, zip(totals, targets(totals), strict=True), strict=True))
    assert sorted((str(r["doc_id"]), size(r["text"]), *want[r["source"]]) for r in rows) == [
        pytest.approx(x) for x in sorted((str(r.doc_id), r["size"], r.source_size, r.target) for r in got)
    ]
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixture_shares(docs, block=block).collect()))
    pieces = mixture(docs, block=block).collect()
    assert sum(p.n_words for p in pieces) == sum(r.taken for r in got)
    texts = {(r["doc_id"], r["source"], w): r["text"] or "" for r in rows for w in [r["text"]]}
    slots = {}
    for p in pieces:
        found = [t for (i, s, _), t in texts.items() if i == p.doc_id and s == p.source]
        assert any(WORD.findall(p.text) == WORD.findall(t)[p.from_word : p.from_word + p.n_words] for t in found)
        slots.setdefault((p.shard, p.slot), []).append((p.piece, p.n_words, p.source))
    for parts in slots.values():
        at = 0
        for piece, n, _ in sorted(parts):
            assert piece == at
            at += n
        assert at <= block and len({s for *_, s in parts}) == 1
    for s, (total, target) in want.items():
        taken = sum(p.n_words for p in pieces if p.source == s)
        assert abs(taken - target) <= max(2 * block, 0.01 * target), (s, total, target, taken)


@needs_tables
def test_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_odd_rows(spark):
    texts = ["w " * 900, "", None, "x y z\n" * 100, "one", " \t\n ", "q " * 5000]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    rows += [(None, "n " * 70, "en", "a", 0), (1, "other text", "en", "b", 0), (0, "w " * 900, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 as size", "2 as rid", "3 as name")
    got = mixture_shares(docs, block=16)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == len(rows) and all(r.taken <= 2 * r["size"] for r in got.collect())
    distinct = docs.drop("size", "rid", "name").distinct()
    check(distinct, block=16)
    assert mixture_shares(docs.limit(0)).count() == 0
    assert mixture(docs.limit(0)).count() == 0
