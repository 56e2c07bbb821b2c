"""Text files that no row can hold: read in splits, as lines, and packed in blocks.

A chunk is made of whole lines, so that a line is the most that has to fit a row. Lines come with their place in the file;
what concerns a file as a whole (whether all of it is UTF-8, a byte order mark, whether it has any text) is worked out
beside them. The chunks equal those of the file read at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import strip
from corpusflow.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE
from corpusflow.operators.tabular import BLOCK_LINES, chunk_lines
from corpusflow.session import scratch_path, stage
from corpusflow.sources.delimited import delimited_lines, split_lines
from corpusflow.sources.extract import MARKDOWN, NATIVE, PLAIN
from corpusflow.sources.formats import CSV_SEPARATORS
from corpusflow.sources.tree import open_files

SPLITTABLE = (*NATIVE, "csv", "tsv")

UTF16 = "UTF-16 text is too large to read in splits"


def text_lines(files: DataFrame, root: str, work: str | None = None) -> DataFrame:
    """``rel_path, pos, line, error`` of plain text, Markdown and source code among ``files`` (``path, rel_path, ext``) below
    ``root``, by the rules for whole files: plain text that is not UTF-8 throughout is Latin-1, other text has U+FFFD for
    malformed bytes, source code is headed by its language. UTF-16 cannot be cut into lines by its bytes, and is an error.
    """
    spark = files.sparkSession
    named = files.filter(F.col("ext").isin(*NATIVE)).select("path", "rel_path", "ext")
    paths = [r.path for r in named.toLocalIterator()]  # of files that are large each
    schema = "rel_path string, pos long, line string, error string"
    if not paths:
        return spark.createDataFrame([], schema)
    # The line reader takes a UTF-8 mark away, which other readers keep.
    heads = open_files(named.select("rel_path", "ext"), root, start=3)
    mark = F.hex("content")
    work = work or scratch_path(spark, "text")
    lines = split_lines(spark, root, paths, work=work).select("rel_path", "pos", "value")
    whole = lines.groupBy("rel_path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(strip(F.make_valid_utf8("value")) != "").alias("filled"),
    )
    about = heads.join(whole, "rel_path").select(
        "rel_path", "ext", "utf8", "filled", (mark == "EFBBBF").alias("marked"),
        (F.col("ext").isin(*PLAIN) & ~F.col("utf8") & F.substr(mark, F.lit(1), F.lit(4)).isin("FFFE", "FEFF")).alias("utf16"),
    )
    # A row per file, read three times below: stored, so that it travels to the lines and not they to it.
    about = stage(f"{work}/about", about)
    latin = F.col("ext").isin(*PLAIN) & ~F.col("utf8")
    text = F.when(latin, F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.make_valid_utf8("value"))
    head = F.when(F.col("marked") & (F.col("pos") == 0), F.when(latin, "ï»¿").otherwise("﻿")).otherwise("")
    read = lines.join(about.filter("not utf16"), "rel_path").select(
        "rel_path", "pos", F.concat(head, text).alias("line"), F.lit(None).cast("string").alias("error")
    )
    no_error = F.lit(None).cast("string").alias("error")
    # The suffix keeps its case in the heading.
    code = about.filter(~F.col("ext").isin(*PLAIN, *MARKDOWN) & F.col("filled")).select(
        "rel_path", F.lit(-1).cast("long").alias("pos"),
        F.concat(F.lit("# Language: "), F.regexp_extract("rel_path", r"\.([^.]+)$", 1)).alias("line"), no_error,
    )
    faults = about.filter("utf16").select(
        "rel_path", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("line"), F.lit(UTF16).alias("error")
    )
    return read.unionByName(code).unionByName(faults)


def table_lines(files: DataFrame, root: str, work: str | None = None) -> DataFrame:
    """``rel_path, pos, line, error`` of the delimited files among ``files``: a line per record, or what is wrong with it."""
    spark, out = files.sparkSession, None
    for ext, separators in (("csv", CSV_SEPARATORS), ("tsv", ("\t",))):
        paths = [r.path for r in files.filter(F.col("ext") == ext).select("path").toLocalIterator()]
        found = delimited_lines(spark, root, separators=separators, paths=paths, work=work) if paths else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return spark.createDataFrame([], "rel_path string, pos long, line string, error string") if out is None else out


def long_lines(files: DataFrame, root: str, work: str | None = None) -> DataFrame:
    """The lines of all ``files`` that can be read in splits, by kind; they read what is staged in ``work``."""
    return text_lines(files, root, work).unionByName(table_lines(files, root, work))


def chunk_long_text(
    lines: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, block_lines: int = BLOCK_LINES, work: str | None = None
) -> DataFrame:
    """``rel_path, chunk_index, text, char_count``: the chunks of files given as lines (``rel_path, pos, line``).

    They are numbered where they lie, in a copy in ``work``: a scratch folder, to be removed when the chunks are written.
    """
    good = lines.filter(F.col("line").isNotNull()).select("rel_path", "pos", "line")
    work = work or scratch_path(lines.sparkSession, "lines")
    return chunk_lines(good, ["rel_path"], size=size, overlap=overlap, block_lines=block_lines, runs=work)
