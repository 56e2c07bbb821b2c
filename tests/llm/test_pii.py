import re
from collections import Counter, defaultdict

from corpusflow.llm.pii import KINDS, find_personal_data
from llm_helpers import FOLDER, documents, needs_tables

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, name in enumerate(KINDS):
        for m in re.finditer(PLAIN[name], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[name]()
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


ODD = [
    (1, None), (2, ""), (3, "a.b@c.d.e@f.g x@y.z_q@r.s 😀 a@b.co, 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255"),
    (4, "4111 1111 1111 1111-4111111111111111 é4111-1111-1111-1111 +1 (800) 555-1234 +12 +49.30.1234567x"),
    (5, "@@@" * 50), (6, "1" * 5000), (7, "a" * 50_000 + "@" + "b.c" * 3000), (8, "1.1.1.1" * 2000), (9, "+1-2" * 3000),
    (None, "me@example.com"), (10, "me@example.com"), (10, "me@example.com"), (11, "%" * 100_000), (12, "no thing 12"),
]


def test_base_equals_the_plain_patterns(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as base", "2 as rid", "3 as word", "4 as value")
    out = find_personal_data(docs)
    assert out.columns == ["doc_id", "base", "added"]
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in out.collect())
    assert got == sorted((str(i), base(t)) for i, t in ODD)
    assert find_personal_data(docs.limit(0)).count() == 0


@needs_tables
def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in find_personal_data(docs).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"words of all sorts, member-id: user{i}@mail.example.com here") for i in range(30)]
    rows += [(100 + i, f"some text member-id: X{i:02d}Q{i * 7919 % 10007:05d}Z and more") for i in range(12)]
    rows += [(200 + i, f"the code R{i:02d}T{i * 7919 % 10007:05d} is nobody's") for i in range(12)]
    rows += [(300, "the one member-id: 77A88B99C and nothing"), (301, "all member-id: short7")]
    # One value in many copies confirms no pattern.
    rows += [(400 + i, "ask lonely: same@mail.example.com") for i in range(20)] + [(500, "ask lonely: 88A99B00C")]
    out = {r.doc_id: r for r in find_personal_data(documents(spark, rows)).collect()}
    found = {i for i, r in out.items() if r.added}
    assert found == {*range(100, 112), 300}
    text = dict(rows)[300]
    assert [tuple(s) for s in out[300].added] == [(len(KINDS), text.index("77A"), text.index(" and"))]


IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9._@+/-])(?:[0-9]{1,5}+(?: [0-9]{1,5}+(?![A-Za-z0-9._@+/-]))++"
    r"|(?:\([0-9]{1,5}+\) ?+)?(?=[A-Za-z._@+/-]*+[0-9])[A-Za-z0-9._@+/-]*[A-Za-z0-9])"
)
WORD = re.compile(r"[^\s=:\"'(]+[=:]?", re.A)


def words_of(text):
    return [w[-64:] for w in WORD.findall(re.sub(r"\s+(?=[=:])", "", text.lower(), flags=re.A))]


def plain_added(texts, rounds=3, support=3, least=0.5):
    """Spans by context of each text, from dictionaries over the whole words of all texts."""
    total, edges, free = Counter(), defaultdict(Counter), defaultdict(list)
    seeds = set()
    for i, text in enumerate(texts):
        words = words_of(text)
        total.update((0, w) for w in words)
        total.update((2, w) for w in words)
        total.update((1, a, b) for a, b in zip(words, words[1:]))
        spans = [(s, e) for _, s, e in base(text)]
        runs = [m.span() for m in IDENTIFIER.finditer(text)]
        runs = [(s, e) for s, e in runs if e - s >= 6 and sum(c in "0123456789" for c in text[s:e]) >= 4]
        inner = [(s, e) for s, e in runs if any(a < s and e <= b for a, b in spans)]
        others = [(s, e) for s, e in runs if not any(a < e and s < b for a, b in spans)]
        for s, e in spans + inner + others:
            before = words_of(text[:s])
            beside = [(0, before[-1])] if before else []
            beside += [(1, before[-2], before[-1])] if len(before) > 1 else []
            rest = re.sub(r"^[^\s=:\"'(]*[=:]?[\s\"'(=:]*", "", re.sub(r"\s+(?=[=:])", "", text[e:].lower(), flags=re.A), flags=re.A)
            after = WORD.match(rest)
            beside += [(2, after[0])] if after and len(after[0]) <= 64 else []
            for p in beside:
                edges[p][text[s:e]] += 1
            if (s, e) in others:
                free[i].append((s, e, beside))
            else:
                seeds.add(text[s:e])
    values = {v for c in edges.values() for v in c}
    trust = {v: float(v in seeds) for v in values}
    for turn in range(rounds):
        good = {}
        for p, c in edges.items():
            if total[p] and sum(trust[v] >= least for v in c) >= support:
                good[p] = min(sum(n * trust[v] for v, n in c.items()) / total[p], 0.99)
        if turn + 1 < rounds:
            doubt = dict.fromkeys(values, 1.0)
            for p, t in good.items():
                for v in edges[p] if t >= least else ():
                    doubt[v] *= 1 - t
            trust = {v: 1.0 if v in seeds else 1 - doubt[v] for v in values}
    trusted = {p for p, t in good.items() if t >= least}
    return {i: [(len(KINDS), s, e) for s, e, ps in found if trusted & set(ps)] for i, found in free.items()}


def check_added(spark, texts):
    got = {r.doc_id: [tuple(s) for s in r.added] for r in find_personal_data(documents(spark, texts)).collect()}
    want = plain_added(texts)
    assert got == {i: want.get(i, []) for i in range(len(texts))}
    return {(i, texts[i][s:e]) for i, spans in got.items() for _, s, e in spans}


def number(i, n):
    return f"{i * 7919 % 10**n:0{n}d}"


def test_rounds_equal_the_plain_version(spark):
    texts = [f"the account number {'A' if i % 2 else 'user.'}{number(i + 1, 5)}{'' if i % 2 else '@m.example'} is it" for i in range(16)]
    texts += [f"one number {number(i, 5)}B and number {number(i + 50, 4)}CC of all" for i in range(20)]
    texts += [f"mail = x{i}@m.example and" for i in range(5)] + ["so mail= 77A88B99C.", "or mail : \"88A99B00\" too"]
    # Words that only discovered identifiers stand beside are found in a later round.
    texts += [f"badge: a{i}@m.example" for i in range(9)] + [f"badge: K{number(i, 6)} (ledger" for i in range(4)]
    texts += ["see K555666777 ledger", "see K55566677 other", "phone +1 (555) 010-2233 4111 1111 1111 1111 22"]
    texts += [f"call +1 ({number(i + 3, 3)}) 555-{number(i + 1, 4)} now" for i in range(6)] + ["call +1\n(333) 555-7777. So"]
    texts += [f"{'w' * 70 * (i % 3 + 1)} b{i}@m.example" for i in range(6)] + [f"{'w' * 300} 123 45 6789"]
    # Entities without an at sign, four digits in a row or a point between digits.
    texts += [f"office line +1 23 45 67 8{i} so" for i in range(6)] + [f"a line of {i}" for i in range(30)] + ["office line 99 88 77 66"]
    found = check_added(spark, texts)
    assert {v for _, v in found} >= {"99 88 77 66", "A31676", "77A88B99C", "K555666777", "(555) 010-2233", "(333) 555-7777", "123 45 6789"}
    assert not any(v.endswith(("B", "CC")) or v == "K55566677" for _, v in found)


def test_odd_rows_equal_the_plain_version(spark):
    check_added(spark, [t or "" for _, t in ODD] + [f"id: u{i}@m.example " + "9" * 3000 for i in range(4)] + [" " * 9000 + ":1234567"])


@needs_tables
def test_documents_equal_the_plain_version(spark):
    docs = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    # Two phones that the fixed pattern takes for one number with the address behind them, in the tables' own words.
    tail = [docs[0][:50] + f" +1 (826) 555-{4000 + i} 190.137.223.{200 + i} " + docs[1][:50] for i in range(2)]
    more = [docs[2][:40] + f" +1 ({200 + i}) 555-{3000 + i} " + docs[3][:40] for i in range(20)]
    found = check_added(spark, docs + tail + more)
    assert {(len(docs), "(826) 555-4000"), (len(docs) + 1, "(826) 555-4001")} <= found
