import re

import xxhash

from corpusflow.llm.line_dedup import dedup_lines
from llm_helpers import FOLDER, documents, needs_tables

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def line_hash(line):
    return xxhash.xxh64(line.encode(), seed=42).intdigest()


def units(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text or "")


def passages(lines, gone, min_words):
    """The repeated lines that stand in runs of two physical lines or of enough words."""
    out, gone = set(), sorted(gone)
    for k, i in enumerate(gone):
        if k and gone[k - 1] == i - 1:
            continue
        run = [i]
        while run[-1] + 1 in gone:
            run.append(run[-1] + 1)
        text = "".join(lines[x] for x in run).strip(" \n\r\t")
        if re.search(r"\n\s*\S", text) or len(text.split()) >= min_words:
            out.update(run)
    return out


def plain(docs, min_chars=40, min_words=30):
    """The operator's rules in plain Python: doc_id to text."""
    docs = sorted({(i, t or "") for i, t in docs}, key=lambda x: (x[0], signed(line_hash(x[1]))))
    parsed = []
    for i, text in docs:
        lines = units(text)
        bare = [u.rstrip(" \n\r\t") for u in lines]
        h = [line_hash(b) for b in bare]
        r = [signed(x if k == 0 else (x ^ (((h[k - 1] << 1) & MASK) | (h[k - 1] >> 63)))) for k, x in enumerate(h)]
        cuts = [k for k in range(len(h)) if k == 0 or (2 <= k < len(h) - 1 and r[k] < r[k - 1] and r[k] <= r[k + 1])]
        parsed.append((i, text, lines, bare, [*cuts, len(h)]))
    first, gone = {}, {}
    taken = [joined_chunks(bare, cuts, min_chars, min_words) for _, _, _, bare, cuts in parsed]

    def around(d, k, e):
        """Lines on both sides, nearest first, and how many the nearest chunk, or the row that begins there, has."""
        _, _, _, bare, cuts = parsed[d]
        w, size = taken[d][0], len(cuts) - 1
        onward = w[e] if e < size else None
        until = min(max(e + 2, e + (size if onward is None else onward)), size)
        before = bare[cuts[max(k - 2, 0)] : cuts[k]][::-1], cuts[k] - cuts[max(k - 1, 0)]
        return before, (bare[cuts[e] : cuts[until]], None if onward is None else cuts[e + onward] - cuts[e])

    def same(own, theirs):
        n = 0
        while n < min(len(own[0]), len(theirs[0])) and own[0][n] == theirs[0][n]:
            n += 1
        return 0 if own[1] is not None and own[1] == theirs[1] and n >= own[1] else n

    for d, (_, _, _, bare, cuts) in enumerate(parsed):
        for k, e in taken[d][1]:
            f = first.setdefault(tuple(bare[cuts[k] : cuts[e]]), (d, k, e))
            if f != (d, k, e):
                left, right = map(same, around(d, k, e), around(*f))
                gone.setdefault(d, set()).update(range(cuts[k] - left, cuts[e] + right))
    return {
        (i, text): "".join(u for k, u in enumerate(lines) if k not in passages(lines, gone.get(d, ()), min_words))
        for d, (i, text, lines, _, _) in enumerate(parsed)
    }


def joined_chunks(bare, cuts, min_chars, min_words):
    """Of each chunk, with how many after it it is long enough (None if never), and all chunks taken together."""
    size = len(cuts) - 1
    many = re.compile(rf"\s*(?:\S+\s+){{{min_words - 1}}}\S", re.ASCII)
    counts = []
    for k in range(size):
        filled = [b for b in bare[cuts[k] : cuts[k + 1]] if b]
        counts.append((sum(2 if many.match(b) else 1 for b in filled), sum(map(len, filled))))
    w = []
    for k in range(size):
        lines = chars = n = 0
        while k + n < size and not (lines >= 2 and chars >= min_chars):
            lines, chars, n = lines + counts[k + n][0], chars + counts[k + n][1], n + 1
        w.append(n if lines >= 2 and chars >= min_chars else None)
    rows = [(k, k + n) for k, n in enumerate(w) if n is not None]
    if rows and rows[-1][1] < size:
        rows.append((rows[-1][0], size))
    return w, rows


@needs_tables
def test_equals_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.text for r in got} == {i: want[i, text[i]] for i in text}
    assert any(r.removed_lines for r in got)


def sentences(name, n):
    return [f"{name} sentence number {k} speaks of {name * 2} and {k * 37 % 101}." for k in range(n)]


def test_passages_go_and_the_rest_stays(spark):
    passage = "\n".join(sentences("shared", 12))
    texts = ["\n".join([*sentences(f"own{i}", 5), passage, *sentences(f"end{i}", 5)]) for i in range(6)]
    prose = " ".join(sentences("prose", 12))
    texts += [f"Before it all. {prose}", f"Something else here! {prose}"]
    out = [r.text for r in dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert out[0] == texts[0] and out[6] == texts[6]
    for i in range(1, 6):
        assert out[i] == "\n".join([*sentences(f"own{i}", 5), *sentences(f"end{i}", 5)])
    assert out[7] == "Something else here! "


def test_short_repeats_on_one_line_stay(spark):
    short = "This is what every page says. It says so at the end."
    texts = ["\n".join([*sentences(f"own{i}", 8), short]) for i in range(5)]
    assert [r.text for r in dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()] == texts


def test_odd_rows(spark):
    copy = "\n".join(sentences("copy", 9))
    rows = [(1, copy), (2, copy), (2, copy), (None, None), (3, ""), (4, None), (5, "\n\n\n\n"), (6, "one line"), (7, "same.\n" * 300), (9, copy)]
    docs = documents(spark, rows).selectExpr("*", "1 as lines", "'x' as found", "'y' as key")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "found", "key", "lines", "removed_lines", "removed_chars"]
    got = {(r.doc_id, r.text, r.removed_chars) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        (1, copy, 0), (2, "", len(copy)), (9, "", len(copy)), (None, None, 0), (3, "", 0), (4, None, 0),
        (5, "\n\n\n\n", 0), (6, "one line", 0), (7, "same.\n" * 300, 0),
    }
    assert dedup_lines(docs.limit(0)).count() == 0


def test_copies_of_short_or_blank_separated_lines_go(spark):
    short = "\n".join(f"{chr(97 + k % 26)}{k}" for k in range(60))
    spaced = "\n\n".join(f"Line {k} of {k * k}." for k in range(40)) + "\n\n\nEnd.\n"
    shouted = " ".join(f"W{k}!!" for k in range(150))
    long = " ".join(f"word{k}" for k in range(35))
    few = "Too short. Stays."
    copies = [short, spaced, shouted, long]
    rows = [(i, t) for i, t in enumerate(copies * 2)] + [(8, few), (9, few)]
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark, rows)).collect()}
    assert got == {i: t for i, t in enumerate(copies)} | {4: "", 5: "", 6: "", 7: "", 8: few, 9: few}


def test_short_lines_inside_a_longer_passage_go(spark):
    passages = [
        "\n".join(f"{x}\n" if len(x) < 12 else x for k in range(14) for x in (f"p{n} {k}.", *sentences(f"shared{n}", k + 1)[k:]))
        for n in range(20)
    ]
    texts = [
        "\n".join([*sentences(f"own{i}x{n}", 5), passage, *sentences(f"end{i}x{n}", 5)])
        for i in range(2)
        for n, passage in enumerate(passages)
    ]
    out = {r.doc_id: r.text for r in dedup_lines(documents(spark, texts)).collect()}
    for n in range(20):
        assert out[n] == texts[n]
        assert out[20 + n] == "\n".join([*sentences(f"own1x{n}", 5), *sentences(f"end1x{n}", 5)])


@needs_tables
def test_exact_copies_of_the_table_end_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen, copies = set(), set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text in seen and len(r.text or "") >= 40:
            copies.add(r.doc_id)
        seen.add(r.text)
    left = {r.doc_id: r.text for r in dedup_lines(docs).collect() if r.doc_id in copies and r.text}
    assert copies and not left
