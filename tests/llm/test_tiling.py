import random

from corpusflow.llm.tiling import keep_clean, overlaps, tiles
from llm_helpers import documents


def greedy(text, item, run):
    """Greedy string tiling, straight from its definition: words of the item that end up marked."""
    marked_text, marked_item = set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(text)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(text) and item[i + n] == text[d + n]
                    and i + n not in marked_item and d + n not in marked_text
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < run:
            return len(marked_item)
        marked_item.update(range(i, i + n))
        marked_text.update(range(d, d + n))


def test_tiles_equal_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randrange(3, 14))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(3, 30))]
        run = rng.choice([1, 2, 3])
        points = [
            (d, i)
            for d in range(len(text) - run + 1)
            for i in range(len(item) - run + 1)
            if text[d : d + run] == item[i : i + run]
        ]
        found = tiles(points, run)
        assert sum(n for _, _, n in found) == greedy(text, item, run)
        assert all(text[d : d + n] == item[i : i + n] for d, i, n in found)


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "0 as seed", "1 as place")


def test_finds_whole_reordered_and_partial_passages(spark):
    one, two = words("alpha", 40), words("beta", 30)
    items = [(1, " ".join(one)), (2, " ".join(two)), (3, "tiny item here"), (4, ""), (None, None), (5, "... !!!"), (2, " ".join(two))]
    own = " ".join(words("own", 300))
    texts = [
        f"{own} {' '.join(one).upper()}. {own}",
        f"{own} {' '.join(two[15:])}; {own} {' '.join(two[:15])}",
        f"{own} {' '.join(one[:15])}",
        f"{own} a Tiny, item here.",
        own, "", None, " ".join(one + two), " ".join(w for pair in zip(one, one[1:], strict=False) for w in pair),
    ]
    docs = documents(spark, [*enumerate(texts), (0, texts[0]), (None, texts[3])]).selectExpr("*", "1 as seed", "2 as version")
    got = {(r.doc_id, r.item_id, r.tiles, r.covered, r.n_words) for r in overlaps(docs, benchmark(spark, items)).collect()}
    assert got == {
        (0, 1, 1, 40, 40), (1, 2, 2, 30, 30), (3, 3, 1, 3, 3), (None, 3, 1, 3, 3), (7, 1, 1, 40, 40), (7, 2, 1, 30, 30),
    }
    kept = keep_clean(docs, benchmark(spark, items))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8]


def test_equals_plain_tiling(spark):
    rng = random.Random(2)
    vocabulary = words("v", 6)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 25)))) for i in range(8)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(25)]
    got = {(r.doc_id, r.item_id): r.covered for r in overlaps(documents(spark, texts), benchmark(spark, items), coverage=0.4).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            item = x.split()
            covered = greedy(t.split(), item, min(5, len(item)))
            if covered >= 0.4 * len(item):
                want[d, i] = covered
    assert got == want


def test_empty_tables(spark):
    docs, items = documents(spark, ["a b c d e f"]), benchmark(spark, [(1, "a b c d e f")])
    assert overlaps(docs.limit(0), items).count() == 0
    assert overlaps(docs, items.limit(0)).count() == 0
    assert keep_clean(docs, items.limit(0)).count() == 1
