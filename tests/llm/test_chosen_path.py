import random

import numpy as np

from corpusflow.llm.chosen_path import keep_one_per_class, runs_needed, similar_classes, token_set
from corpusflow.llm.common import word_hashes
from llm_helpers import FOLDER, documents, needs_tables


def brute(rows, least=0.8):
    """doc row index to (class, linked rows, linked texts) by comparing all pairs of texts."""
    texts = sorted({t for _, t in rows if t and t.strip()})
    sets = [set(token_set(word_hashes([t])[0]).tolist()) for t in texts]
    near = {t: set() for t in texts}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= least * len(sets[i] | sets[j]) - 1e-9:
                near[texts[i]].add(texts[j])
                near[texts[j]].add(texts[i])
    copies = {t: sum(x == t for _, x in rows) for t in texts}
    out = []
    for i, t in rows:
        if t not in near or not token_set(word_hashes([t])[0]).size:
            out.append((i, i, 0, 0))
            continue
        group, todo = {t}, [t]
        while todo:
            for other in near[todo.pop()] - group:
                group.add(other)
                todo.append(other)
        ids = [k for k, x in rows if x in group and k is not None]
        links = copies[t] - 1 + sum(copies[x] for x in near[t])
        out.append((i, min(ids) if ids else None, links, len(near[t])))
    return sorted(out, key=str)


def varied(words, rng, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200, 700]))]
        rows += [varied(words, rng, rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.choice([1, 2, 5, 9]))]
    words = [f"h{k}" for k in range(400)]
    rows += [varied(words, rng, 2) for _ in range(150)]  # more than a bucket holds, all alike
    rows += ["a b c", "A b, c!", "a b c d", "", None, "  ", "?!", "x"]
    rows = list(enumerate(rows)) + [(5, rows[5]), (None, rows[0]), (None, None)]
    docs = documents(spark, rows).selectExpr("*", "1 as key", "2 as class_id", "3 as tid")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similar_classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {c for _, c, _, _ in got}


def test_one_of_near_copies_that_share_an_id_stays(spark):
    rng = random.Random(9)
    words = [[f"{g}w{k}" for k in range(300)] for g in range(3)]
    rows = [(7, varied(words[0], rng, 1)) for _ in range(4)]  # one id, four texts
    rows += [(None, varied(words[1], rng, 1)) for _ in range(4)]  # no id at all
    rows += [(None, varied(words[2], rng, 1)), (8, varied(words[2], rng, 1)), (8, rows[0][1] + " more"), (9, None), (None, None)]
    kept = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in keep_one_per_class(documents(spark, rows)).collect())
    assert kept == [(0, ""), (0, "1w"), (7, "0w"), (8, "2w"), (9, "")]


@needs_tables
def test_equals_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similar_classes(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_runs(spark):
    assert similar_classes(documents(spark, ["x"]).limit(0)).count() == 0
    assert runs_needed(0.9) < runs_needed(0.99) < runs_needed(0.999)


def test_hashes_do_not_depend_on_place():
    alone = word_hashes(["über the lazy_dog 9"])[0]
    among, bounds = word_hashes(["", "zz top", "Über, THE - lazy_dog; 9", "end"])
    assert np.array_equal(alone, among[bounds[2] : bounds[3]])
    assert list(bounds) == [0, 0, 2, 6, 7]
    assert len(set(alone.tolist())) == 4
