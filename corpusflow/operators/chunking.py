"""Packing lines into overlapping chunks.

A page's lines are packed greedily: a line that would push the buffer past ``chunk_size`` closes it, the last
``overlap`` lines stay behind as context, and the line is added without a second check. Chunks of 30 characters
or fewer are dropped and take no index. A buffer is always a run of neighbouring lines, so a chunk is a pair of
line numbers, found by binary search in the running line lengths.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.paths import make_chunk_id
from corpusflow.operators.ordinals import running_total

# Defaults of the chunker, and the length a chunk must exceed.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 2
MIN_CHARS = 30

# Characters collected before an output batch is sent to the JVM.
_FLUSH_CHARS = 4 << 20


def clean_lines(text: str) -> list[str]:
    """Stripped, non-blank lines of a page."""
    return [line for line in map(str.strip, text.split("\n")) if line]


def next_flush(ends: list[int], start: int, last: int, size: int) -> int:
    """The first line after ``last`` that does not fit a buffer holding lines ``start..last``.

    ``ends[i]`` is the length of lines ``0..i`` joined by newlines, plus one.
    """
    base = ends[start - 1] if start else 0
    return max(last + 1, bisect_right(ends, base + size + 1))


def pack(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Line ranges ``[start, stop)`` of the chunks of one page, short ones included."""
    count = len(lengths)
    if not count:
        return []
    ends = list(accumulate(n + 1 for n in lengths))
    spans, start, last = [], 0, 0
    while (stop := next_flush(ends, start, last, size)) < count:
        spans.append((start, stop))
        start, last = (max(start, stop - overlap) if overlap > 0 else stop), stop
    spans.append((start, count))
    return spans


def chunk_texts(text: str, size: int, overlap: int) -> list[str]:
    """The kept chunks of one page, in order."""
    lines = clean_lines(text)
    joined = ("\n".join(lines[a:b]) for a, b in pack([len(x) for x in lines], size, overlap))
    return [c for c in joined if len(c) > MIN_CHARS]


def as_pages(text: Column, page: Column | int = 1) -> Column:
    """A one-page ``pages`` array from a text column."""
    number = F.lit(page) if isinstance(page, int) else page
    return F.array(F.struct(number.cast("long").alias("page"), text.alias("text")))


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    pages: str = "pages",
    first_index: str | None = None,
) -> DataFrame:
    """Chunks of documents whose pages are an array in one row.

    Every other column is copied to each chunk. Adds ``page``, ``chunk_index``, ``text`` and ``char_count``. The
    index runs through the document, so the operator is narrow: no shuffle. ``first_index`` names a column the
    index starts from (0 otherwise); that column is not copied.
    """
    carried = [c for c in docs.columns if c not in (pages, first_index)]
    ordered = docs.select(
        *carried,
        F.transform(F.col(pages), lambda p: p["page"].cast("long")).alias("_numbers"),
        F.transform(F.col(pages), lambda p: p["text"]).alias("_texts"),
        (F.col(first_index) if first_index else F.lit(0)).cast("long").alias("_first"),
    )
    schema = T.StructType(
        [docs.schema[c] for c in carried]
        + [
            T.StructField("page", T.LongType()),
            T.StructField("chunk_index", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("char_count", T.IntegerType()),
        ]
    )

    def run(batches):
        for batch in batches:
            # Texts of a row are taken when it is its turn: all of a batch would be there twice.
            numbers, first = (batch.column(c).to_pylist() for c in ("_numbers", "_first"))
            texts = batch.column("_texts")
            kept = [batch.column(c) for c in carried]
            rows, page, index, out, pending = [], [], [], [], 0

            def flush():
                at = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [c.take(at) for c in kept]
                    + [
                        pa.array(page, pa.int64()),
                        pa.array(index, pa.int64()),
                        pa.array(out, pa.string()),
                        pa.array([len(t) for t in out], pa.int32()),
                    ],
                    names=[f.name for f in schema],
                )

            for row in range(batch.num_rows):
                position = first[row]
                for number, text in zip(numbers[row] or (), texts[row].as_py() or ()):
                    for chunk in chunk_texts(text, size, overlap) if text else ():
                        rows.append(row)
                        page.append(number)
                        index.append(position)
                        out.append(chunk)
                        position += 1
                        pending += len(chunk)
                        if pending > _FLUSH_CHARS:
                            yield flush()
                            rows, page, index, out, pending = [], [], [], [], 0
            if rows:
                yield flush()

    return ordered.mapInArrow(run, schema)


def count_chunks(
    rows: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text"
) -> DataFrame:
    """The other columns of each row plus ``n_chunks``, the number of chunks its text gives."""
    carried = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in carried] + [T.StructField("n_chunks", T.LongType())])

    def run(batches):
        for batch in batches:
            counts = [
                len(chunk_texts(t.as_py(), size, overlap)) if t.as_py() else 0 for t in batch.column(text)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [pa.array(counts, pa.int64())],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(run, schema)


def chunk_page_rows(
    pages: DataFrame,
    keys: list[str],
    page: str = "page",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of documents whose pages are rows, numbered through each document in page order.

    ``(*keys, page)`` must be unique. A first narrow pass counts chunks per page; blocked running totals of the
    counts give each page its first index, and pages then pack on their own. Page text crosses the network once,
    keyed by page, so a document holding most of the pages is spread like any other.
    """
    counts = count_chunks(pages.select(*keys, page, text), size, overlap, text)
    starts = running_total(counts, keys, page, "n_chunks", "_start")
    placed = pages.join(starts.select(*keys, page, "_start"), [*keys, page])
    carried = [c for c in pages.columns if c not in (page, text)]
    shaped = placed.select(*carried, as_pages(F.col(text), F.col(page)).alias("pages"), "_start")
    return chunk_documents(shaped, size, overlap, first_index="_start")


def with_chunk_ids(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return chunks.withColumn("chunk_id", make_chunk_id(F.col(doc_id).cast("string"), F.col("chunk_index")))


def chunk_documents_native(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``chunk_documents`` for one text column, in built-in expressions only.

    Kept as an independent form to check against, and for clusters without Python workers. Its output array is
    copied at each chunk, so it suits texts of up to a few thousand lines.
    """
    from corpusflow.functions.text import strip

    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: x != "")
    start = F.struct(
        F.lit(0).cast("int").alias("length"),
        F.array().cast("array<string>").alias("held"),
        F.array().cast("array<string>").alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["held"]) > 0) & (acc["length"] + 1 + F.length(line) > size)
        tail = (
            F.slice(acc["held"], F.greatest(F.size(acc["held"]) - overlap + 1, F.lit(1)), overlap)
            if overlap > 0
            else F.array().cast("array<string>")
        )
        held = F.concat(F.when(full, tail).otherwise(acc["held"]), F.array(line))
        closed = F.array_join(acc["held"], "\n")
        out = F.when(full, F.concat(acc["out"], F.array(closed))).otherwise(acc["out"])
        return F.struct(
            F.length(F.array_join(held, "\n")).cast("int").alias("length"), held.alias("held"), out.alias("out")
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.array_join(acc["held"], "\n")))

    chunks = F.filter(F.aggregate(lines, start, step, finish), lambda c: F.length(c) > MIN_CHARS)
    carried = [c for c in docs.columns if c != text]
    return docs.select(*carried, F.posexplode(chunks).alias("chunk_index", "text")).select(
        *carried,
        F.lit(1).cast("long").alias("page"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "text",
        F.length("text").alias("char_count"),
    )
