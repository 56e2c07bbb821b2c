"""Functions on file names, paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import strip

# Extension -> content type of stored objects.
CONTENT_TYPES = {
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "htm": "text/html",
    "html": "text/html",
    "json": "application/json",
    "jsonl": "application/jsonl",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "rtf": "application/rtf",
    "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "application/xml",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def file_name(path: Column) -> Column:
    """The last path part; trailing slashes do not count."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """The last suffix with its dot; a leading dot or a trailing dot makes none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension(name: Column) -> Column:
    """The lower-case suffix without its dot."""
    return F.ltrim(F.lower(suffix(name)), F.lit("."))


def path_parts(path: Column) -> Column:
    """The parts of a path; ordering by them puts ``a/b.txt`` before ``a.txt``."""
    return F.split(path, "/")


def make_doc_id(path: Column) -> Column:
    """The slug of a file's stem; a stem without letters or digits gets an id from the path's hash."""
    slug = F.btrim(F.regexp_replace(F.lower(stem(file_name(path))), "[^a-z0-9]+", "_"), F.lit("_"))
    fallback = F.concat(F.lit("doc_"), F.substring(F.sha2(path, 256), 1, 8))
    return F.when(slug == "", fallback).otherwise(slug)


def make_chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", doc_id, index)


def safe_name(name: Column) -> Column:
    """Characters a file system refuses become ``_``."""
    return F.translate(name, '\\/:*?"<>|', "_________")


def client_key(client_id: Column) -> Column:
    """The isolation key of a client: stripped and lower-case, null where blank."""
    return F.nullif(F.lower(strip(client_id)), F.lit(""))


def client_object_key(prefix: Column, client_id: Column, name: Column) -> Column:
    """``prefix/client/name``; null (refused) where the client or the file name is blank."""
    base = F.nullif(strip(file_name(name)), F.lit(""))
    return F.concat(prefix, F.lit("/"), client_key(client_id), F.lit("/"), base)


def content_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in CONTENT_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(DEFAULT_CONTENT_TYPE))


def public_url(account: Column, container: Column, key: Column) -> Column:
    return F.concat(F.lit("https://"), account, F.lit(".blob.core.windows.net/"), container, F.lit("/"), key)


def sha256_hex(content: Column) -> Column:
    """The integrity fingerprint of a file's bytes."""
    return F.sha2(content, 256)
