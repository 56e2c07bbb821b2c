"""Personal data: fixed patterns, and identifiers that turn up in the same contexts, in built-in functions.

Entities found by the fixed patterns are seeds. Lexical patterns are the word before an entity, the two words before it and
the word after it; a seed of several parts also is an instance of the words inside it (``+1`` before ``(706) 555-3138``).
Patterns and instances form a graph: a pattern is trusted by the share of its occurrences in the whole corpus that stand
beside trusted instances, and an instance by the patterns that it stands beside. After a few rounds, patterns that were
confirmed by several different instances mark the identifiers beside them that no fixed pattern found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import staged, text_or_empty

#: Fixed patterns, in the order of kinds. Runs are possessive and begin where a run begins (or the match before ended), so
#: that a long run of matching characters is read once; what they match is what the plain patterns match.
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Identifiers: runs of these characters, after digits in brackets or not, or short groups of digits parted by blanks; with
#: four digits or more, and six characters or more.
_IDENTIFIER = (
    r"(?<![A-Za-z0-9._@+/-])(?:[0-9]{1,5}+(?:\x20[0-9]{1,5}+(?![A-Za-z0-9._@+/-]))++"
    r"|(?:\([0-9]{1,5}+\)\x20?+)?(?=[A-Za-z._@+/-]*+[0-9])[A-Za-z0-9._@+/-]*[A-Za-z0-9])"
)
#: A word that may stand beside an entity, with the colon or equals sign that ends it; blanks before that are left out.
_WORD = r"[^\s=:\"'(]++[=:]?"
_DETACHED = r"(?<!\s)\s++(?=[=:])"
#: The next word after the rest of the entity's own.
_NEXT = rf"^[^\s=:\"'(]*+[=:]?+[\s\"'(=:]*+({_WORD})"
#: A word is known by this many last characters; contexts lie within the reach.
_TAIL, _REACH = 64, 256
#: Texts that may hold an entity.
_MAY_HOLD = r"@|[0-9]{4}|[0-9]\.[0-9]"
#: Sorts of patterns.
_LEFT, _PAIR, _RIGHT = 0, 1, 2


def _found(text: Column, pattern: str) -> Column:
    """Place (from 0, in characters) and content of every match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    starts = F.aggregate(
        F.zip_with(gaps, F.transform(matches, F.length), lambda g, m: F.struct(g.alias("gap"), m.alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNotNull(), F.array_append(a["starts"], a["at"] + x["gap"]))
            .otherwise(a["starts"])
            .alias("starts"),
        ),
        lambda a: a["starts"],
    )
    return F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _DETACHED, "")


def _key(*words: Column) -> Column:
    return F.xxhash64(*[F.right(w, F.lit(_TAIL)) for w in words])


def _patterns(text: Column, x: Column) -> Column:
    """``sort, key`` of the patterns that an instance stands beside, within reach."""
    start, end = x["start"], x["end"]
    near = _plain(F.substring(text, F.greatest(start - _REACH, F.lit(0)) + 1, F.least(start, F.lit(_REACH))))
    # An array of one element brings the words into a lambda, so that they are looked for once.
    before = F.transform(F.array(F.regexp_extract_all(near, F.lit(_WORD), F.lit(0))), lambda w: _left(w, start))
    after = F.regexp_extract(_plain(F.substring(text, end + 1, F.lit(_REACH))), _NEXT, 1)
    right = F.struct(F.lit(_RIGHT).alias("sort"), F.when(F.length(after).between(1, _TAIL), _key(after)).alias("key"))
    return F.filter(F.concat(F.flatten(before), F.array(right)), lambda p: p["key"].isNotNull())


def _left(words: Column, start: Column) -> Column:
    last, other, n = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2)), F.size(words)
    # The first word of the window may be cut.
    whole = (n >= 3) | (start <= _REACH) | (F.length(other) >= _TAIL)
    return F.array(
        F.struct(F.lit(_LEFT).alias("sort"), F.when(n >= 1, _key(last)).alias("key")),
        F.struct(F.lit(_PAIR).alias("sort"), F.when((n >= 2) & whole, _key(other, last)).alias("key")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """A stored row per row of ``docs``: ``rid, doc_id, base`` (kind number, start, end, hash of the value, patterns),
    ``inner``, the identifiers that begin inside one of them and end there, and ``others``, those that overlap none.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    text, none = F.col("text"), F.array().cast("array<struct<start:int,end:int,value:string>>")
    may = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}
    digit = text.rlike("[0-9]")
    for kind in KINDS:
        seen = F.when(may.get(kind, digit), _found(text, _PATTERNS[kind])).otherwise(none)
        rows = rows.withColumn(kind, seen)

    def kept(number: int, kind: str) -> Column:
        good = F.filter(kind, lambda x: _valid(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(F.lit(number).alias("kind"), x["start"], x["end"], x["value"]))

    rows = rows.withColumn("base", F.concat(*[kept(i, k) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("runs", F.when(digit, _found(text, _IDENTIFIER)).otherwise(none))
    runs = F.filter(
        "runs", lambda x: (F.length(x["value"]) >= 6) & (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 4)
    )
    rows = rows.withColumn("runs", runs)
    rows = rows.withColumn(
        "inner",
        F.filter("runs", lambda x: F.exists("base", lambda b: (b["start"] < x["start"]) & (x["end"] <= b["end"]))),
    ).withColumn(
        "free",
        F.filter("runs", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))),
    )

    def described(x, kind):
        return F.struct(
            kind.alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.xxhash64(x["value"]).alias("value"),
            _patterns(text, x).alias("patterns"),
        )

    return staged(
        rows.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.transform("base", lambda x: described(x, x["kind"])).alias("base"),
            F.transform("inner", lambda x: described(x, F.lit(0))).alias("inner"),
            F.transform("free", lambda x: described(x, F.lit(len(KINDS)))).alias("others"),
        ),
        "scan",
    )


def _words() -> Column:
    return F.regexp_extract_all(_plain(text_or_empty()), F.lit(_WORD), F.lit(0))


def _pairs(docs: DataFrame) -> DataFrame:
    """A ``key`` for every two neighbouring words."""
    n = F.greatest(F.size("words") - 1, F.lit(0))
    both = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: _key(a, b))
    return docs.select(_words().alias("words")).select(F.explode(both).alias("key"))


def trusted_patterns(
    docs: DataFrame, scanned: DataFrame, rounds: int = 3, support: int = 3, least: float = 0.5
) -> DataFrame:
    """``sort, key, trust`` of the patterns that ``support`` different trusted instances or more confirm.

    In each round a pattern's trust is the trust of the instances beside it over all its occurrences in the corpus, and
    an instance's the chance that one of its patterns of at least ``least`` is right, so that doubtful ones do not add up
    to trust; seeds keep theirs. Patterns beside fewer than ``support``
    different instances, or beside any instance in less than ``least`` of their occurrences, can never be trusted and
    are left out before the rounds.
    """
    every = scanned.select(F.explode(F.concat("base", "inner", "others")).alias("x")).select("x.*")
    beside = every.select("kind", "value", F.explode("patterns").alias("p")).select("kind", "value", "p.*")
    met = staged(
        beside.groupBy("sort", "key", "value").agg(F.count("*").alias("n"), (F.min("kind") < len(KINDS)).alias("seed")),
        "met",
    )
    able = staged(
        met.groupBy("sort", "key")
        .agg(F.sum("n").alias("beside"), F.count("*").alias("values"))
        .filter(F.col("values") >= support)
        .drop("values"),
        "able",
    )
    enough = F.col("beside") / F.col("total") >= least
    single, pair = able.filter(F.col("sort") != _PAIR), able.filter(F.col("sort") == _PAIR)
    # Of pairs of words, those that already occur too often in texts with entities are not looked for in all others.
    some = _pairs(docs.filter(F.col("text").rlike(_MAY_HOLD))).groupBy("key").agg(F.count("*").alias("total"))
    pair = staged(pair.join(some, "key", "left").filter(F.col("total").isNull() | enough).drop("total"), "pairs")
    words = docs.select(F.explode(_words()).alias("w")).select(_key(F.col("w")).alias("key"))
    words = words.groupBy("key").agg(F.count("*").alias("total"))
    pairs = _pairs(docs).join(pair.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("total"))
    total = staged(
        single.join(words, "key")
        .unionByName(pair.join(pairs, "key"))
        .filter(enough)
        .select("sort", "key", "total"),
        "totals",
    )
    edges = staged(met.join(total, ["sort", "key"], "left_semi"), "edges")
    instances = staged(
        edges.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("trust", F.col("seed").cast("double")),
        "instances",
    )
    patterns = None
    for turn in range(rounds):
        behind = edges.select("sort", "key", "value", "n").join(instances, "value")
        sums = behind.groupBy("sort", "key").agg(
            F.sum(F.col("n") * F.col("trust")).alias("right"),
            F.sum((F.col("trust") >= least).cast("int")).alias("confirmed"),
        )
        patterns = staged(
            sums.join(total, ["sort", "key"]).select(
                "sort",
                "key",
                F.when(F.col("confirmed") >= support, F.least(F.col("right") / F.col("total"), F.lit(0.99)))
                .otherwise(0.0)
                .alias("trust"),
            ),
            "patterns",
        )
        if turn + 1 < rounds:
            doubt = (
                edges.select("sort", "key", "value")
                .join(patterns.filter(F.col("trust") >= least), ["sort", "key"])
                .groupBy("value")
                .agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("found"))
            )
            instances = staged(
                instances.join(doubt, "value", "left").select(
                    "value",
                    "seed",
                    F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("trust"),
                ),
                "instances",
            )
    return patterns.filter(F.col("trust") >= least)


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, least: float = 0.5) -> DataFrame:
    """``doc_id, base, added`` for every row of ``docs`` (doc_id, text, any other columns): arrays of ``kind`` (number in
    ``KINDS``; ``len(KINDS)`` for identifiers known by context), ``start`` and ``end`` (code points, end exclusive),
    in that order.

    Null texts count as empty. Rows that repeat are searched each; equal values count as one instance. Words are known by
    their last 64 characters, and contexts lie within 256 characters of an entity. Identifiers without digits and those
    that no trusted word stands beside are not found.
    """
    scanned = scan(docs)
    patterns = staged(trusted_patterns(docs, scanned, rounds, support, least), "trusted").select("sort", "key")
    spans = "transform({}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    added = (
        scanned.select("rid", F.explode("others").alias("x"))
        .select("rid", "x.*")
        .select("rid", "kind", "start", "end", F.explode("patterns").alias("p"))
        .select("rid", "kind", "start", "end", "p.*")
        .join(patterns, ["sort", "key"], "left_semi")
        .groupBy("rid")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    )
    return scanned.join(added, "rid", "left").select(
        "doc_id",
        F.expr(f"array_sort({spans.format('base')})").alias("base"),
        F.expr("array_sort(coalesce(added, array()))").alias("added"),
    )
