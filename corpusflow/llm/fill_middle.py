"""Fill-in-the-middle examples by rotating blocks in place.

A text is cut twice at places that depend on its doc_id alone. Its bytes go into a bytearray together with the sentinels,
in the order prefix, middle, suffix; the parts then change places by rotations, each three reversals of a range. The way
back finds the sentinels, undoes the rotations and deletes the sentinels. Both work on the whole text, in pieces of a
megabyte where they scan or reverse, so that a long text takes its own size and little more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import with_python

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares in percent: texts left as they are (from this value of a hash on), and suffix first among the others.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

_PIECE = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Bytes 128 to 191 go on with a character; all others begin one.
_BEGINS = np.ones(256, bool)
_BEGINS[128:192] = False


def _unit_starts(data: np.ndarray, at: int) -> np.ndarray:
    """Whether a unit (a run of ASCII letters, or any other character) begins at each byte of the piece at ``at``."""
    piece = data[at : at + _PIECE]
    letter = _LETTER[piece]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[0] = at > 0 and _LETTER[data[at - 1]]
    return _BEGINS[piece] & ~(letter & before)


def count_units(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero(_unit_starts(data, at))) for at in range(0, len(data), _PIECE))


def scan_cut(data: np.ndarray, units: int) -> int:
    """The byte after the first ``units`` units."""
    for at in range(0, len(data), _PIECE):
        starts = _unit_starts(data, at)
        found = int(np.count_nonzero(starts))
        if units < found:
            return at + int(np.flatnonzero(starts)[units])
        units -= found
    return len(data)


def _chars(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero(_BEGINS[data[at : at + _PIECE]])) for at in range(0, len(data), _PIECE))


def reverse(data: np.ndarray, first: int, last: int) -> None:
    """Reverse the range in place, swapping pieces from both ends."""
    while last - first > 1:
        n = min(_PIECE, (last - first) // 2)
        head = data[first : first + n].copy()
        data[first : first + n] = data[last - n : last][::-1]
        data[last - n : last] = head[::-1]
        first, last = first + n, last - n


def rotate(data: np.ndarray, first: int, cut: int, last: int) -> None:
    """Exchange the blocks [first, cut) and [cut, last) in place, by three reversals."""
    reverse(data, first, cut)
    reverse(data, cut, last)
    reverse(data, first, last)


def _hashes(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def choose(doc_id: int | None, text: bytes) -> tuple[int, str, int, int]:
    """Units, form, and the bytes where middle and suffix begin."""
    data = np.frombuffer(text, np.uint8)
    n = count_units(data)
    h1, h2, h3, h4 = _hashes(doc_id)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", scan_cut(data, low), scan_cut(data, high)


def arrange(text: bytes, form: str, middle: int, suffix: int) -> bytes | bytearray:
    """The text in its form: sentinels go in where the parts begin, then blocks are rotated."""
    if form == "plain":
        return text
    out = bytearray(text)
    out[suffix:suffix] = SUFFIX
    out[middle:middle] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = middle + len(PREFIX), suffix + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(out, np.uint8)
    # <P>prefix <M>middle <S>suffix: the suffix moves before the middle, or before all.
    rotate(view, middle if form == "psm" else 0, suffix, len(view))
    return out


def rebuild(output: bytes, form: str) -> bytes | bytearray:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    out = bytearray(output)
    middle = out.find(MIDDLE)
    first = out.find(SUFFIX) if form == "psm" else 0
    cut = middle if form == "psm" else out.find(PREFIX)
    view = np.frombuffer(out, np.uint8)
    # The first block of the exchange has become the second: rotating at the new border undoes it.
    rotate(view, first, cut, len(view))
    del view
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = out.find(sentinel)
        del out[at : at + len(sentinel)]
    return out


_FIELDS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def _string(data: bytes | bytearray) -> str:
    return data.decode("utf-8", "replace")


def _example(doc_id, text) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    n, form, middle, suffix = choose(doc_id, data)
    if form == "plain":
        return n, form, None, None, text or ""
    view = np.frombuffer(data, np.uint8)
    sizes = _chars(view[:middle]), _chars(view[middle:suffix])
    return n, form, *sizes, _string(arrange(data, form, middle, suffix))


def _batches(table: pa.RecordBatch):
    """Rows of a batch in groups of few characters: their outputs are held together."""
    size, rows = 0, []
    for i, text in enumerate(table.column("text")):
        text = text.as_py()
        rows.append(text)
        size += len(text or "")
        if size > 8 * _PIECE:
            yield i + 1 - len(rows), rows
            size, rows = 0, []
    if rows:
        yield table.num_rows - len(rows), rows


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``docs`` without the text, with ``n`` (units), ``form``, ``prefix_chars, middle_chars`` and ``output``.

    A unit is a run of ASCII letters or one other character. The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix
    first) or ``plain`` (the text as it is: empty ones, those that hold a sentinel, and a tenth of all), and follows from
    ``doc_id``, as do the cuts. A null text counts as empty; a null doc_id as an empty number; rows alike are cut alike.
    Columns of the input named as the new ones are left out; an empty table gives an empty one.
    """
    with_python(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text" and c not in dict(_FIELDS)]

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            for at, texts in _batches(batch):
                ids = batch.column("_id").slice(at, len(texts)).to_pylist()
                made = list(zip(*map(_example, ids, texts), strict=True))
                columns = [batch.column(c).slice(at, len(texts)) for c in kept]
                columns += [pa.array(v, t) for v, t in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *dict(_FIELDS)])

    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in _FIELDS:
        schema = schema.add(name, kind)
    given = docs.select(*kept, "text", F.col("doc_id").cast("long").alias("_id"))
    return given.mapInArrow(run, schema)


def restore(examples: DataFrame) -> DataFrame:
    """``examples`` (``form`` and ``output`` as ``fill_in_middle`` makes them) with ``text`` in place of ``output``."""
    with_python(examples.sparkSession)
    kept = [c for c in examples.columns if c not in ("output", "text")]

    def run(batches):
        for batch in batches:
            forms = batch.column("form").to_pylist()
            renamed = pa.RecordBatch.from_arrays([batch.column("output")], names=["text"])
            for at, texts in _batches(renamed):
                rebuilt = [_string(rebuild(t.encode("utf-8", "replace"), f)) for t, f in zip(texts, forms[at:], strict=False)]
                columns = [batch.column(c).slice(at, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rebuilt, pa.large_string())], names=[*kept, "text"])

    schema = T.StructType([examples.schema[c] for c in kept]).add("text", "string")
    return examples.select(*kept, "output").mapInArrow(run, schema)
