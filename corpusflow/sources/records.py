"""Chunk and document records exchanged as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import schemas
from corpusflow.operators.metadata import chunk_json, parse_chunk_lines

_CORRUPT = "_corrupt_record"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows as JSON lines, a folder per client. A file holds many documents; each line names its own."""
    lines = chunks.select("client_id", chunk_json().alias("value"))
    lines.write.mode("overwrite").partitionBy("client_id").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows from the JSON-lines files below ``path``, with defaults for what a line leaves out."""
    return parse_chunk_lines(spark.read.option("recursiveFileLookup", True).text(path))


def read_document_meta(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata from the ``*_meta.json`` files below ``path``; files that cannot be parsed are skipped."""
    schema = T.StructType([*schemas.DOCUMENT_META, T.StructField(_CORRUPT, T.StringType())])
    found = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_meta.json")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    return found.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
