"""Schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
PAGES = T.ArrayType(PAGE)

EXTRA = T.MapType(T.StringType(), T.StringType())
VECTOR = T.ArrayType(T.FloatType())

# The fields of a chunk record, in the order they are exported.
CHUNK = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("uploaded_at", T.StringType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("embedding", VECTOR),
    ]
)

DOCUMENT_META = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("total_pages", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("total_chars", T.LongType()),
        T.StructField("processed_at", T.StringType()),
        T.StructField("blob_urls", EXTRA),
        T.StructField("extra_metadata", EXTRA),
    ]
)
