import math
import random
import re
from collections import Counter

import pytest

from corpusflow.llm import bag_search
from llm_helpers import FOLDER, documents, needs_tables

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain(docs, items, k=50):
    """item_id, rank, doc_id, score of every item, by scoring every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, vocabulary in asked.items():
        scored = []
        for (i, bag), size in zip(bags, sizes, strict=True):
            score = 0
            for t in vocabulary & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * size * n_docs // total
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def item_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@needs_tables
def test_equals_scoring_every_document(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(bag_search.search(docs, items)) == want
    # The same in many blocks of items.
    assert found(bag_search.search(docs, items, block_terms=3000)) == want


def test_ties_and_large_classes(spark, monkeypatch):
    draw = random.Random(5)
    words = ["Ab", "aB", "cd", "é", "É", "x1", "中文", "zz"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(700)]
    ids = draw.sample(range(100_000), 700)
    docs = list(zip(ids, texts, strict=True)) + [(ids[0], texts[1]), (None, "ab cd"), (None, None), (7, "")]
    items = [(i, " ".join(draw.sample(words, 3))) for i in range(12)] + [(3, "cd"), (None, "É zz"), (90, "absent"), (91, None)]
    monkeypatch.setattr(bag_search, "_CELLS", 64)
    df = documents(spark, docs).repartition(7)
    for k in (3, 50):
        assert found(bag_search.search(df, item_table(spark, items), k)) == plain(docs, items, k)


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_long_texts_are_read_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(bag_search, "_PIECE", piece)
    text = "Ünïcode-wörds AND plain_ones,, 12ab\x7f\x80 \n Z" * 30
    assert {k.decode(): n for k, n in bag_search.term_counts(text).items()} == dict(Counter(terms(text)))
    assert not bag_search.term_counts(None)


def test_odd_tables(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (2, "c")]).selectExpr("*", "1 as item_id", "2 as bag", "3 as m")
    items = item_table(spark, [(1, "A")]).selectExpr("*", "5 as doc_id", "6 as term", "7 as score")
    rows = plain([(1, "a b"), (1, "a b"), (2, "c")], [(1, "A")])
    assert found(bag_search.search(docs, items)) == rows and len(rows) == 2
    assert bag_search.search(docs, items.limit(0)).count() == 0
    assert bag_search.search(docs.limit(0), items).count() == 0
    assert bag_search.search(documents(spark, [(1, None)]), items).count() == 0
