"""Page text from file bytes, one row per file.

Plain text, Markdown and source code are decoded by built-in expressions. Every other format goes through one
``mapInArrow`` step that calls the readers of ``formats``. Results carry ``pages`` (null where nothing was read) and
``error`` (why), so that failures can be listed rather than lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import schemas
from corpusflow.functions.paths import make_doc_id, suffix
from corpusflow.functions.text import decode_plain, decode_replacing, strip
from corpusflow.sources.files import CODE, read_files
from corpusflow.sources.formats import READERS, Reader

PLAIN = ("txt", "rst")
MARKDOWN = ("md", "markdown")
NATIVE = (*PLAIN, *MARKDOWN, *CODE)
PARSED = tuple(READERS)

NO_TEXT = "no text"

# Characters collected before an output batch is sent to the JVM.
_FLUSH_CHARS = 4 << 20


def tag_language(text: Column, dotted_suffix: Column) -> Column:
    """Source code headed by its language; the suffix keeps its case."""
    return F.concat(F.lit("# Language: "), F.ltrim(dotted_suffix, F.lit(".")), F.lit("\n\n"), text)


def native_text(content: Column, ext: Column, name: Column) -> Column:
    """The page text of plain text, Markdown or source code; empty where there is none."""
    replaced = strip(decode_replacing(content))
    return (
        F.when(ext.isin(*PLAIN), strip(decode_plain(content)))
        .when(ext.isin(*MARKDOWN), replaced)
        .when(replaced == "", "")
        .otherwise(tag_language(replaced, suffix(name)))
    )


def extract_native(files: DataFrame) -> DataFrame:
    """Pages of files whose ``ext`` is in ``NATIVE``, in built-in expressions."""
    text = native_text(F.col("content"), F.col("ext"), F.col("source_file"))
    page = F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet_name"), F.col("_text").alias("text"))
    kept = [c for c in files.columns if c != "content"]
    return files.withColumn("_text", text).select(
        *kept,
        F.when(F.col("_text") != "", F.array(page)).cast(schemas.PAGES).alias("pages"),
        F.when(F.col("_text") == "", NO_TEXT).alias("error"),
    )


def extract_parsed(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Pages of files read by ``readers``, by default ``formats.READERS``; other files get an error."""
    table = READERS if readers is None else readers
    kept = [c for c in files.columns if c != "content"]
    schema = T.StructType(
        [files.schema[c] for c in kept]
        + [T.StructField("pages", schemas.PAGES), T.StructField("error", T.StringType())]
    )
    page_type = pa.list_(
        pa.struct([("page", pa.int32()), ("sheet_name", pa.string()), ("text", pa.string())])
    )

    def one(content: bytes, ext: str, name: str):
        reader = table.get(ext)
        if reader is None:
            return None, f"no reader for '{ext}'"
        try:
            found = [p._asdict() for p in reader(content, name)]
        except Exception as fault:
            return None, f"{type(fault).__name__}: {fault}"
        return (found, None) if found else (None, NO_TEXT)

    def run(batches):
        for batch in batches:
            rows, pages, errors, chars = [], [], [], 0

            def flush():
                at = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [batch.column(c).take(at) for c in kept]
                    + [pa.array(pages, page_type), pa.array(errors, pa.string())],
                    names=[f.name for f in schema],
                )

            inputs = (batch.column(c) for c in ("content", "ext", "source_file"))
            for row, (content, ext, name) in enumerate(zip(*inputs)):
                found, error = one(content.as_py(), ext.as_py(), name.as_py())
                rows.append(row)
                pages.append(found)
                errors.append(error)
                chars += sum(len(p["text"]) for p in found or ())
                if chars > _FLUSH_CHARS:  # a zipped file can hold far more text than bytes
                    yield flush()
                    rows, pages, errors, chars = [], [], [], 0
            if rows:
                yield flush()

    return files.mapInArrow(run, schema)


def is_native(ext: Column, readers: dict[str, Reader] | None = None) -> Column:
    """Whether built-in expressions read this extension; a reader passed in takes it over."""
    return ext.isin(*[e for e in NATIVE if e not in (readers or {})])


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Pages of files of any kind. ``readers`` adds to, or replaces, the readers by extension.

    Where ``files`` has the partition column ``is_native``, as the archive does, each branch reads its own partitions
    only. For a folder, ``extract_folder`` splits at the listing instead.
    """
    table = {**READERS, **(readers or {})}
    native = F.col("is_native").cast("boolean") if "is_native" in files.columns else is_native(F.col("ext"), readers)
    return extract_native(files.filter(native)).unionByName(extract_parsed(files.filter(~native), table))


def extract_folder(spark: SparkSession, root: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Pages of the files below ``root``. Each branch lists its own extensions, so a file is read once."""
    table = {**READERS, **(readers or {})}
    plain = [e for e in NATIVE if e not in (readers or {})]
    return extract_native(read_files(spark, root, plain)).unionByName(
        extract_parsed(read_files(spark, root, table), table)
    )


def to_documents(extracted: DataFrame) -> DataFrame:
    """Files that gave text: adds ``doc_id`` and ``total_pages``, the number of non-empty pages."""
    return (
        extracted.filter(F.col("pages").isNotNull())
        .drop("error")
        .withColumn("doc_id", make_doc_id(F.col("rel_path")))
        .withColumn("total_pages", F.size("pages"))
    )


def to_errors(extracted: DataFrame) -> DataFrame:
    """Files that gave no text, and why."""
    return extracted.filter(F.col("pages").isNull()).select(
        "path", F.lit("extract").alias("stage"), F.col("error").alias("reason")
    )
