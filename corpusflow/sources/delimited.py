"""Delimited files as rows of records, split over tasks however large a file is.

A line feed may stand inside a quoted cell, so a split cannot tell from its own bytes whether it begins inside one. What a
line does to that is one of four things: nothing, turning it, or leaving it inside or outside whatever it was before.
These are composed along the file, first within each partition, then over the partitions' totals, and so tell of every
line whether it begins a record. Lines of one record are then put together again.
"""

from __future__ import annotations

import csv as csv_format
import re
import uuid
from typing import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import strip
from corpusflow.session import scratch_path, stage
from corpusflow.sources.files import any_case_glob, locate
from corpusflow.sources.formats import (
    CSV_SEPARATORS,
    delimited_records,
    header_names,
    labelled_row,
    without_empty,
)

# Lines a header may have, and characters a record may have to be put together in one row.
HEADER_LINES = 1000
RECORD_CHARS = 64 << 20

NO_HEADER = "no columns to read"
LONG_HEADER = "the header has more than {} lines"
LONG_RECORD = "a record of {} characters is too long"


def split_lines(
    spark: SparkSession, root: str, paths: list[str] | None = None, extensions: Iterable[str] = (), work: str | None = None
) -> DataFrame:
    """``rel_path, value, pos`` and ``part``: lines, their place in the file, and the split they are in, which grows along it.

    Of the files at ``paths``, all below ``root``, or of all with one of the ``extensions``. The lines are stored once as
    they are read, which fixes the splits and the order in them, and only the splits' line counts are summed along a file.
    They come in runs of neighbouring lines. ``work`` is a scratch folder that is removed when the lines have served.
    """
    full, _, is_folder = locate(spark, root)
    if not is_folder:
        raise ValueError(f"Invalid directory path: {root}")
    reader = spark.read.option("recursiveFileLookup", True)
    if paths is None:
        reader = reader.option("pathGlobFilter", any_case_glob(extensions))
    lines = reader.text([_unglobbed(p) for p in paths] if paths is not None else full).select(
        F.substr(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), F.lit(len(full.rstrip("/")) + 2)).alias("rel_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    work = work or scratch_path(spark, "split")
    read = stage(f"{work}/lines-{uuid.uuid4().hex}", lines)
    sizes = read.groupBy("rel_path", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
    along = Window.partitionBy("rel_path").orderBy("_start")
    bases = sizes.select(
        "rel_path", "_start", "_first", F.row_number().over(along).alias("part"),
        F.coalesce(F.sum("_lines").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    # A row per split: stored, so that the optimizer sees how few they are.
    bases = stage(f"{work}/splits-{uuid.uuid4().hex}", bases)
    pos = (F.col("_base") + F.col("_row") - F.col("_first")).alias("pos")
    return read.join(bases, ["rel_path", "_start"]).select("rel_path", "value", pos, "part")


def _unglobbed(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_lines(spark: SparkSession, root: str, extensions: Iterable[str]) -> DataFrame:
    """``rel_path, pos, value``: the lines of the files below ``root`` with their place in the file, from 0.

    Files are read in splits. A line's order is its split's start, then its place in the task that read it.
    """
    return split_lines(spark, root, extensions=extensions).select("rel_path", "pos", "value")


def _ends_quoted(line: Column, separator: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted cell.

    Quotes count at the start of a cell only; all repetitions are possessive, so that long lines take no stack.
    """
    s = "\\t" if separator == "\t" else "\\" + separator
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    return line.rlike(rf'^(?:(?:{quoted}"[^{s}]*+|[^{s}"][^{s}]*+|){s})*+{quoted}$')


def _headers(lines: DataFrame, separators: tuple[str, ...]) -> DataFrame:
    """Per file ``separator, names, first_pos`` (of the line after the header), or an ``error`` where there is none.

    The header is the first record that is not blank; the first separator under which it has several columns holds, or the
    last under which it ends.
    """
    filled = lines.filter(strip(F.col("value")) != "").groupBy("rel_path").agg(F.min("pos").alias("begin"))
    starts = lines.filter("pos = 0").select("rel_path").join(filled, "rel_path", "left")
    head = lines.join(starts, "rel_path").filter(
        f"(begin is null and pos = 0) or pos between begin and begin + {HEADER_LINES - 1}"
    )

    def choose(key, pdf):
        pdf = pdf.sort_values("pos")
        values, chosen, fault = pdf["value"].tolist(), None, NO_HEADER
        for separator in () if pd.isna(pdf["begin"].iloc[0]) else separators:
            for n in range(1, len(values) + 1):
                # A record is whole once a line put behind it begins another; the end of the file closes the last one.
                records = list(delimited_records("\n".join([*values[:n], "x"]), separator))
                if len(records) == 1 and n == len(values) < HEADER_LINES:
                    records = [*delimited_records("\n".join(values), separator), []]
                if len(records) > 1:
                    chosen = separator, records[0], int(pdf["pos"].iloc[0]) + n
                    break
            else:
                fault = LONG_HEADER.format(HEADER_LINES) if len(values) == HEADER_LINES else fault
            if chosen and chosen[0] == separator and len(chosen[1]) > 1:
                break
        if not chosen:
            return pd.DataFrame([[key[0], None, None, 0, fault]])
        return pd.DataFrame([[key[0], chosen[0], header_names(chosen[1]), chosen[2], None]])

    schema = "rel_path string, separator string, names array<string>, first_pos long, error string"
    return head.select("rel_path", "pos", "value", "begin").groupBy("rel_path").applyInPandas(choose, schema)


def _with_records(lines: DataFrame) -> DataFrame:
    """Adds ``record``, the number of the record each line belongs to, and whether it ``begins`` and ``ends`` it.

    ``lines`` have ``rel_path, pos, part``, ``out_to`` and ``in_to``: whether a line that begins outside, or inside, of a
    quoted cell leaves the next one inside. A file begins outside.
    """
    sets, turns = F.col("out_to") == F.col("in_to"), F.col("out_to") & ~F.col("in_to")
    here = Window.partitionBy("rel_path", "part").orderBy("pos")
    until, before = (here.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    # As if every partition began outside: the state is that of the last line that sets it, turned by those since.
    marked = (
        lines.withColumn("turned", F.sum(turns.cast("int")).over(until))
        .withColumn("set", F.last(F.when(sets, F.struct(F.col("out_to").cast("int").alias("to"), "turned")), True).over(before))
        .withColumn("turned", F.col("turned") - turns.cast("int"))
        .withColumn("state", F.when(F.col("set").isNull(), F.col("turned")).otherwise(F.col("set.to") + F.col("turned") - F.col("set.turned")) % 2)
        .withColumn("bound", F.col("set").isNotNull())
        .drop("set", "turned")
    )
    after = F.when(F.col("state") == 1, F.col("in_to")).otherwise(F.col("out_to")).cast("int")
    final = F.max_by(F.struct(after.alias("state"), (F.col("bound") | sets).alias("bound")), "pos")
    totals = marked.groupBy("rel_path", "part").agg(
        final.alias("end"),
        F.count_if(F.col("state") == 0).alias("begun_outside"),
        F.count_if((F.col("state") == 0) == F.col("bound")).alias("begun_inside"),
    )
    along = Window.partitionBy("rel_path").orderBy("part")
    until, before = (along.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    turns = F.when(F.col("end.bound"), 0).otherwise(F.col("end.state"))
    entries = (
        totals.withColumn("turned", F.sum(turns).over(until))
        .withColumn("set", F.last(F.when(F.col("end.bound"), F.struct("end.state", "turned")), True).over(before))
        .withColumn("turned", F.col("turned") - turns)
        .withColumn("entry", F.when(F.col("set").isNull(), F.col("turned")).otherwise(F.col("set.state") + F.col("turned") - F.col("set.turned")) % 2)
        .withColumn("begun", F.when(F.col("entry") == 1, F.col("begun_inside")).otherwise(F.col("begun_outside")))
        .withColumn("base", F.coalesce(F.sum("begun").over(before), F.lit(0)))
        .select("rel_path", "part", "entry", "base")
    )
    state = F.when(F.col("bound"), F.col("state")).otherwise((F.col("state") + F.col("entry")) % 2)
    placed = marked.join(entries, ["rel_path", "part"]).withColumn("inside", state == 1)
    leaves = F.when(F.col("inside"), F.col("in_to")).otherwise(F.col("out_to"))
    begun = F.sum((~F.col("inside")).cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(
        *lines.columns, (F.col("base") + begun - 1).alias("record"), (~F.col("inside")).alias("begins"), (~leaves).alias("ends")
    )


def delimited_lines(
    spark: SparkSession,
    root: str,
    extensions: Iterable[str] = ("csv",),
    separators: tuple[str, ...] = CSV_SEPARATORS,
    record_chars: int = RECORD_CHARS,
    paths: list[str] | None = None,
    work: str | None = None,
) -> DataFrame:
    """``rel_path, pos, line, error``: a ``name: value`` line per record of the delimited files below ``root``.

    The first record that is not blank names the columns; the first separator that gives it several holds, or the last. Quoted
    cells may hold separators, doubled quotes and line feeds, wherever a split cuts them. Blank cells and those that mean
    none are left out, records without any value too. ``pos`` numbers records from 0. A record that cannot be shown
    has an ``error`` in place of its line: one with more cells than the header, or of more than ``record_chars``
    characters. So has a file without a header. ``paths`` names files to read in place of ``extensions``. ``operators.tabular.chunk_lines`` packs the lines.
    """
    valid = F.make_valid_utf8("value")
    lines = split_lines(spark, root, paths, extensions, work).select("rel_path", "pos", "part", valid.alias("value"))
    headers = _headers(lines, separators)
    text, mark = F.col("value"), F.col("separator")

    def ends_quoted(line: Column) -> Column:
        chosen = _ends_quoted(line, separators[-1])
        for s in separators[:-1]:
            chosen = F.when(mark == s, _ends_quoted(line, s)).otherwise(chosen)
        return chosen

    rows = lines.join(headers.filter("error is null"), "rel_path").filter("pos >= first_pos")
    quotes = F.contains(text, F.lit('"'))
    numbered = _with_records(
        rows.select(
            "rel_path", "pos", "part", "value", "separator", "names",
            (quotes & ends_quoted(text)).alias("out_to"),
            # A line that begins inside reads as one whose first cell has just been opened.
            (~quotes | ends_quoted(F.concat(F.lit('"'), text))).alias("in_to"),
        )
    )
    file = ["rel_path", "separator", "names"]
    single = numbered.filter("begins and ends").select(*file, "record", text.alias("text"), F.lit(None).cast("long").alias("chars"))
    several = numbered.filter("not (begins and ends)")
    sizes = several.groupBy("rel_path", "record").agg((F.sum(F.length("value") + 1) - 1).alias("chars"))
    fitting = several.join(sizes.filter(F.col("chars") <= record_chars), ["rel_path", "record"])
    joined = fitting.groupBy(*file, "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "\n").alias("text")
    )
    long = sizes.filter(F.col("chars") > record_chars).join(headers.select(*file), "rel_path")
    records = (
        single.unionByName(joined.withColumn("chars", F.lit(None).cast("long")))
        .unionByName(long.select(*file, "record", F.lit(None).cast("string").alias("text"), "chars"))
    )
    shown = records.mapInArrow(_show, "rel_path string, pos long, line string, error string")
    faults = headers.filter("error is not null").select(
        "rel_path", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("line"), "error"
    )
    return shown.unionByName(faults)


def _show(batches: Iterable[pa.RecordBatch]):
    """The line or the error of each record; records without any value give no row."""
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("rel_path", "record", "text", "chars", "separator", "names"))
        for path, record, text, chars, separator, names in zip(*columns):
            line = error = None
            if text is None:
                error = LONG_RECORD.format(chars)
            else:
                try:
                    cells = next(delimited_records(text, separator), [])
                    if len(cells) > len(names):
                        error = f"{len(names)} columns expected, {len(cells)} found"
                    else:
                        line = labelled_row(names, without_empty(cells))
                except csv_format.Error as fault:
                    error = str(fault)
            if line or error:
                out.append((path, record, line, error))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        values = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, kinds)], names=["rel_path", "pos", "line", "error"]
        )
