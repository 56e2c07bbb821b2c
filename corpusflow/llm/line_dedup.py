"""Removal of repeated passages: content-defined chunks of lines, compared across all documents.

Text is cut into lines; prose that runs on without line feeds is cut after each sentence. A rolling hash over the hashes
of neighbouring lines has a local minimum about every third line. A chunk begins at each, so its place depends on the
lines around it and not on what stands before. Equal chunks are found by their hashes, grown over the equal lines next to
them, and removed where the text equals the first occurrence byte by byte (white space at line ends aside).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import discard, staged, text_or_empty

# Trimming other characters than blanks reads a line from its start; few lines need it.
_TRIMMED = (
    "if(contains({0}, '\\t') or contains({0}, '\\r'), rtrim(' \\n\\r\\t', {0}), rtrim(replace({0}, '\\n', '')))"
)
# A line ends after a line feed or a sentence. Where the text is free of a mark, putting it there and splitting at it is
# several times faster than splitting by a pattern.
_ENDS = r"'(?<=\\n)|(?<=[.!?] )'"
_MARK = "'\\u0001'"


def _lines(text: str) -> str:
    """SQL: the lines of a text, ends included."""
    marked = f"coalesce({text}, '')"
    for end in ("\\n", ". ", "! ", "? "):
        marked = f"replace({marked}, '{end}', '{end}\\u0001')"
    return f"if(contains({text}, {_MARK}), split({text}, {_ENDS}, -1), split({marked}, {_MARK}, -1))"


def _bare_lines(text: str) -> str:
    """SQL: the same lines without white space at their ends."""
    marked = f"coalesce({text}, '')"
    for end, left in (("\\n", ""), (". ", "."), ("! ", "!"), ("? ", "?")):
        marked = f"replace({marked}, '{end}', '{left}\\u0001')"
    trimmed = _TRIMMED.format("u")
    return (
        f"if(contains({text}, {_MARK}), transform(split({text}, {_ENDS}, -1), u -> {trimmed}),"
        f" transform(split({marked}, {_MARK}, -1), u -> if(endswith(u, ' ') or endswith(u, '\\t') or endswith(u, '\\r'),"
        f" {trimmed}, u)))"
    )


def _line_count(text: str) -> str:
    """SQL: how many lines a text has, without making them."""
    ends = " + ".join(
        f"(octet_length(replace({text}, '{end}', '{end} ')) - octet_length({text}))" for end in ("\\n", ". ", "! ", "? ")
    )
    return f"coalesce({ends}, 0) + 1"


def _enough(total: str, min_chars: int) -> str:
    """SQL: whether lines of this total (as in ``line_chunks``) are two that are not blank, or one of many words."""
    return f"(shiftright({total}, 40) >= 2 and {total} % {1 << 40} >= {int(min_chars)})"


def line_chunks(docs: DataFrame, min_chars: int = 40, min_words: int = 30) -> DataFrame:
    """A row per chunk, taken together with as many chunks after it as give two lines that are not blank (or one of
    ``min_words`` words) and ``min_chars`` characters. The last such chunk of a text is also taken with all that follows.

    ``doc_id, version`` (hash of the text), ``start`` and ``n`` (lines, from 0), ``key`` and ``key2`` (hashes of the
    lines), ``before`` and ``after`` (line hashes of the two neighbouring chunks on either side or of the next row's
    lines, nearest line first), ``n_before`` (lines of the nearest chunk), ``n_after`` (lines of the row that begins
    there; null if none does).
    """
    words, least = int(min_words), 2 * int(min_words) - 1
    many = rf"u rlike '^\\s*+(?:\\S++\\s++){{{words - 1}}}\\S'"
    lines = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty()).alias("version"),
        F.expr(_bare_lines("text")).alias("lines"),
    )
    hashed = lines.select(
        "doc_id",
        "version",
        F.expr("transform(lines, u -> xxhash64(u))").alias("h"),
        # Characters, and above 40 bits the lines that are not blank; one of many words counts as two.
        F.expr(
            f"transform(lines, u -> length(u) + case when u = '' then 0L when length(u) >= {least} and {many}"
            f" then {2 << 40} else {1 << 40} end)"
        ).alias("filled"),
    )
    rolled = hashed.select(
        "*",
        # A cyclic hash over two lines: the earlier line's bits turned by one, then combined with the later's.
        F.expr(
            "transform(h, (x, i) -> if(i = 0, x, x ^ (shiftleft(h[i - 1], 1) | shiftrightunsigned(h[i - 1], 63))))"
        ).alias("r"),
    )
    cut = rolled.select(
        "doc_id",
        "version",
        "h",
        # Half of each hash is enough to see which neighbouring lines agree: bytes decide later.
        F.expr("transform(h, x -> cast(x & 2147483647 as int))").alias("short"),
        "filled",
        F.expr(
            "concat(filter(sequence(0, size(h) - 1), i -> i = 0 or"
            " (i >= 2 and i < size(h) - 1 and r[i] < r[i - 1] and r[i] <= r[i + 1])), array(size(h)))"
        ).alias("b"),
    )
    summed = cut.select(
        "doc_id",
        "version",
        "h",
        "short",
        "b",
        F.expr(
            "transform(sequence(0, size(b) - 2), k ->"
            " aggregate(slice(filled, b[k] + 1, b[k + 1] - b[k]), 0L, (a, x) -> a + x))"
        ).alias("c"),
    )

    def taken(chunks: int) -> str:
        return (
            f"aggregate(slice(c, k + 1, {chunks}), named_struct('sum', 0L, 'n', 0), (a, y) ->"
            f" if({_enough('a.sum', min_chars)}, a, named_struct('sum', a.sum + y, 'n', a.n + 1)),"
            f" a -> if({_enough('a.sum', min_chars)}, a.n, null))"
        )

    # Of two neighbouring chunks one has a line that is not blank, as no boundary falls between blank lines: these are
    # all the chunks that may be needed.
    most = 2 * max(int(min_chars), 2)
    joined = summed.select(
        "*",
        F.expr(
            f"transform(c, (x, k) -> if({_enough('x', min_chars)}, 1, coalesce({taken(4)}, {taken(most)})))"
        ).alias("w"),
    )
    whole = joined.select(
        "*",
        F.expr(
            "filter(transform(w, (m, k) -> named_struct('k', k, 'e', k + m)), p -> p.e is not null)"
        ).alias("p"),
    )
    ended = whole.select(
        "*",
        F.expr(
            "if(get(p, size(p) - 1).e < size(c),"
            " array_append(p, named_struct('k', get(p, size(p) - 1).k, 'e', size(c))), p)"
        ).alias("q"),
    )
    return ended.select(
        "doc_id",
        "version",
        F.expr(
            """inline(transform(transform(q, p -> named_struct(
                'k', p.k, 'e', p.e, 'lines', slice(h, b[p.k] + 1, b[p.e] - b[p.k])
            )), p -> named_struct(
                'start', b[p.k],
                'n', size(p.lines),
                'key', xxhash64(p.lines),
                'key2', hash(p.lines),
                'before', reverse(slice(short, b[greatest(p.k - 2, 0)] + 1, b[p.k] - b[greatest(p.k - 2, 0)])),
                'n_before', b[p.k] - b[greatest(p.k - 1, 0)],
                'after', slice(short, b[p.e] + 1,
                    b[least(greatest(p.e + 2, p.e + coalesce(get(w, p.e), size(c))), size(c))] - b[p.e]),
                'n_after', b[p.e + get(w, p.e)] - b[p.e]
            )))"""
        ),
    )


def _same_lines(side: str) -> str:
    """SQL: how many lines next to a chunk agree with those next to its first occurrence.

    0 where all lines of the neighbouring chunk (on the right, of the row that begins there) agree, as those are found by
    themselves. Boundaries depend on the lines around them, so that inside a passage they differ within two chunks of its
    ends at most.
    """
    agree = (
        f"transform(sequence(0, least(size({side}), size(f.{side}))),"
        f" i -> coalesce(get({side}, i) = get(f.{side}, i), false))"
    )
    lines = f"array_position({agree}, false) - 1"
    return f"if(n_{side} = f.n_{side} and {lines} >= n_{side}, 0, {lines})"


def repeated_spans(docs: DataFrame, min_chars: int = 40, min_words: int = 30) -> DataFrame:
    """Spans of lines that repeat an earlier occurrence: ``doc_id, version, start, n`` and that occurrence's
    ``f.doc_id, f.version, f_start``. The first occurrence is the one with the least (doc_id, version, start).
    """
    chunks = staged(line_chunks(docs, min_chars, min_words), "chunks", hashes=True)
    times = chunks.groupBy("key", "key2").agg(F.count("*").alias("times")).filter("times > 1").select("key", "key2")
    repeated = staged(chunks.join(staged(times, "keys"), ["key", "key2"]), "repeated", hashes=True)
    discard(chunks)
    where = "struct(doc_id, version, start, before, n_before, after, n_after)"
    first = staged(repeated.groupBy("key", "key2").agg(F.min(F.expr(where)).alias("f")), "firsts")
    hits = repeated.join(first, ["key", "key2"]).filter(
        "not (doc_id <=> f.doc_id and version = f.version and start = f.start)"
    )
    grown = hits.withColumn("left", F.expr(_same_lines("before"))).withColumn(
        "right", F.expr(_same_lines("after"))
    )
    return grown.select(
        "doc_id",
        "version",
        F.expr("cast(start - left as int)").alias("start"),
        F.expr("cast(n + left + right as int)").alias("n"),
        F.struct("f.doc_id", "f.version").alias("f"),
        F.expr("cast(f.start - left as int)").alias("f_start"),
    ).distinct()


def _passages(repeated: str, min_words: int) -> str:
    """SQL: those of the repeated lines that stand in runs of two physical lines or more, or of ``min_words`` words."""
    r = repeated
    starts = f"filter({r}, (x, i) -> i = 0 or {r}[i - 1] <> x - 1)"
    ends = f"filter({r}, (x, i) -> i = size({r}) - 1 or {r}[i + 1] <> x + 1)"
    runs = f"zip_with({starts}, {ends}, (s, e) -> named_struct('s', s, 'e', e))"
    text = "array_join(slice(lines, p.s + 1, p.e - p.s + 1), '')"
    long = (
        rf"({text} rlike '^\\s*+[^\\n]*+\\n\\s*+\\S'"
        rf" or {text} rlike '^\\s*+(?:\\S++\\s++){{{int(min_words) - 1}}}\\S')"
    )
    return f"flatten(transform(filter({runs}, p -> {long}), p -> sequence(p.s, p.e)))"


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_words: int = 30) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, and ``lines``, ``removed_lines`` and ``removed_chars``.

    Every row stays, with all its columns; a text without repeats stays as it is (a null text, null), and a document
    all of whose lines repeat earlier ones gets an empty text. Of equal passages the first stays, by doc_id, then hash
    of the text, then place; a null doc_id comes first. Rows equal in doc_id and text count once and are treated alike,
    so a table row that is repeated keeps its text. A passage spans two physical lines or more, or holds ``min_words``
    words: single lines, and a few sentences of one, stay however often they occur. Columns of the input named as the three counts are replaced.
    """
    docs = docs.drop("lines", "removed_lines", "removed_chars")
    spans = staged(repeated_spans(docs, min_chars, min_words), "spans")
    versions = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("version"), "text")
    asked = (
        spans.groupBy(F.col("f.doc_id").alias("doc_id"), F.col("f.version").alias("version"))
        .agg(F.collect_set(F.struct("f_start", "n")).alias("asked"))
        .withColumnRenamed("doc_id", "a_doc")
        .withColumnRenamed("version", "a_version")
    )
    same = F.expr("doc_id <=> a_doc and version = a_version")
    originals = staged(
        versions.join(asked, same)
        .select(
            F.struct("doc_id", "version").alias("f"),
            # Texts travel whole and are cut where they have arrived, if anything is asked of them.
            F.expr(_bare_lines("text")).alias("lines"),
            "asked",
        )
        .select("f", "lines", F.expr("explode(asked)").alias("x"))
        .select("f", "x.f_start", "x.n", F.expr("slice(lines, x.f_start + 1, x.n)").alias("body"))
        .groupBy("f", "f_start", "n")
        .agg(F.first("body").alias("body")),
        "originals",
    )
    found = (
        spans.join(originals, ["f", "f_start", "n"])
        .groupBy(F.col("doc_id").alias("a_doc"), F.col("version").alias("a_version"))
        .agg(F.collect_list(F.struct("start", "n", "body")).alias("found"))
    )
    # The row travels as one column, so that no name of the input meets one used here.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64(text_or_empty()).alias("version"))
    repeated = F.expr(
        "array_distinct(flatten(transform(filter(found, s -> s.body ="
        f" transform(slice(lines, s.start + 1, s.n), u -> {_TRIMMED.format('u')})),"
        " s -> sequence(s.start, s.start + s.n - 1))))"
    )
    cleaned = F.expr(
        "if(size(gone) > 0, array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), ''),"
        " row.text)"
    )
    out = (
        rows.join(found, F.expr("doc_id <=> a_doc and version = a_version"), "left")
        # Few texts have lines to remove; the others need not be cut.
        .select("row", "found", F.expr(f"if(found is null, null, {_lines('row.text')})").alias("lines"))
        .select("row", "lines", F.sort_array(repeated).alias("repeated"))
        .select("row", "lines", F.expr(_passages("repeated", min_words)).alias("gone"))
        .select("row", "gone", "lines", cleaned.alias("text"))
    )
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(
        *kept,
        F.expr(f"if(lines is null, cast({_line_count('row.text')} as int), size(lines))").alias("lines"),
        F.expr("greatest(size(gone), 0)").alias("removed_lines"),
        F.expr("coalesce(length(row.text) - length(text), 0)").alias("removed_chars"),
    )
