"""The registered queries: each operator over whole tables.

Keys match those of ``oracles``. Every function takes the session and the folder of the parquet tables.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import partial
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import paths, text
from corpusflow.operators import catalog, chunking, embedding, metadata, tabular, vectors
from corpusflow.plans import ingest, maintenance
from corpusflow.plans.store import Store
from corpusflow.session import bound_batches, scratch_path, ship_package, spread
from corpusflow.sources import delimited, extract, files, manifest, objects, records, sample_files
from corpusflow.streaming.folder import stream_changes, stream_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A fixed run time keeps results the same from run to run.
_RUN_TIME = datetime(2024, 1, 1, tzinfo=timezone.utc)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _text(number: Column) -> Column:
    return number.cast("string")


def _money(amount: Column) -> Column:
    return amount.cast("decimal(12,2)")


# ---- chunking -------------------------------------------------------------------------------------------


def _document_chunks(spark, folder, size=chunking.CHUNK_SIZE, overlap=chunking.CHUNK_OVERLAP) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("extra_metadata"),
        chunking.as_pages(F.col("text")).alias("pages"),
    )
    return chunking.with_chunk_ids(chunking.chunk_documents(spread(docs), size, overlap))


def _with_lang(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", "chunk_id", "chunk_index", "page", "text", "char_count", F.col("extra_metadata")["lang"].alias("lang")
    )


@query
def chunk_documents(spark, folder):
    return _with_lang(_document_chunks(spark, folder))


@query
def chunk_overlap_zero(spark, folder):
    return _with_lang(_document_chunks(spark, folder, overlap=0))


@query
def chunk_overlap_fifty(spark, folder):
    return _with_lang(_document_chunks(spark, folder, overlap=50))


@query
def chunk_built_in(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return chunking.chunk_documents_native(spread(docs))


def _turns(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("page"), "role", "text"
    )


def _conversation_chunks(spark, folder) -> DataFrame:
    pages = _turns(spark, folder).select("conv_id", "page", "text")
    return chunking.with_chunk_ids(chunking.chunk_page_rows(pages, ["conv_id"]), "conv_id")


@query
def chunk_conversation_pages(spark, folder):
    return _conversation_chunks(spark, folder)


@query
def conversation_full_text(spark, folder):
    """Page by page, and whole for conversations whose pages have been gathered into a row."""
    return metadata.full_text_pages(_turns(spark, folder), ["conv_id"])


@query
def document_full_text(spark, folder):
    """Documents of two pages in a row, the second first, and an empty one between."""
    half = F.expr("cast(length(text) / 2 as int)")
    texts = {3: F.substr("text", half + 1), 2: F.lit(""), 1: F.substr("text", F.lit(1), half)}
    pages = F.array(*[F.struct(F.lit(p).alias("page"), t.alias("text")) for p, t in texts.items()])
    docs = table(spark, folder, "documents").select("doc_id", pages.alias("pages"))
    return docs.select("doc_id", paths.sha256_hex(_bytes(metadata.full_text(F.col("pages")))).alias("sha256"))


# ---- extraction -----------------------------------------------------------------------------------------


def _as_files(df: DataFrame, key: Column, name: Column, content: Column) -> DataFrame:
    """Rows as files: a key, a name and bytes."""
    named = spread(df).select(key.alias("file_id"), name.alias("source_file"), content.alias("content"))
    return named.withColumn("ext", paths.extension(F.col("source_file")))


def _page_texts(extracted: DataFrame, key: str) -> DataFrame:
    # The outer form: for the plain one Spark adds a filter on the array, which would compute the text twice.
    rows = extracted.select(F.col("file_id").alias(key), F.inline_outer("pages"))
    return rows.filter("page IS NOT NULL").select(key, "page", "sheet_name", "text")


def _one_page(extracted: DataFrame, key: str) -> DataFrame:
    return _page_texts(extracted, key).drop("sheet_name")


def _bytes(content: Column) -> Column:
    return content.cast("binary")


def _web_files(spark, folder) -> DataFrame:
    pages = table(spark, folder, "pages")
    return _as_files(pages, F.col("page_id"), F.concat(_text(F.col("page_id")), F.lit(".html")), _bytes(F.col("html")))


@query
def html_text(spark, folder):
    return _one_page(extract.extract_parsed(_web_files(spark, folder)), "page_id")


@query
def html_chunks(spark, folder):
    docs = extract.extract_parsed(_web_files(spark, folder)).select(F.col("file_id").alias("page_id"), "pages")
    return chunking.chunk_documents(docs)


@query
def code_language_tag(spark, folder):
    docs = table(spark, folder, "documents")
    name = F.concat(F.lit("Main"), _text(F.col("doc_id")), F.lit(".Py"))
    return _one_page(extract.extract_native(_as_files(docs, F.col("doc_id"), name, _bytes(F.col("text")))), "doc_id")


@query
def plain_text(spark, folder):
    """Documents as UTF-8 with CRLF, as Latin-1, and as UTF-16 with a BOM, by turns."""
    docs = table(spark, folder, "documents")
    body = F.col("text")
    turn = F.col("doc_id") % 3
    content = (
        F.when(turn == 0, _bytes(F.replace(body, F.lit("\n"), F.lit("\r\n"))))
        .when(turn == 1, F.encode(body, "ISO-8859-1"))
        .otherwise(F.encode(body, "UTF-16"))
    )
    name = F.concat(_text(F.col("doc_id")), F.lit(".txt"))
    return _one_page(extract.extract_native(_as_files(docs, F.col("doc_id"), name, content)), "doc_id")


@query
def markdown_text(spark, folder):
    docs = table(spark, folder, "documents")
    name = F.concat(_text(F.col("doc_id")), F.lit(".md"))
    return _one_page(extract.extract_native(_as_files(docs, F.col("doc_id"), name, _bytes(F.col("text")))), "doc_id")


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


@query
def csv_text(spark, folder):
    """A file per customer, with each of the separators by turns."""
    rows = table(spark, folder, "customer")
    turn = (F.col("c_custkey") % 4).cast("int") + 1
    separator = F.element_at(F.array(*[F.lit(s) for s in (",", ";", "\t", "|")]), turn)
    header = F.array_join(F.array(*[F.lit(c) for c in ("c_custkey", "c_name", "note", "c_mktsegment")]), ";")
    values = F.concat_ws(
        ";", F.lpad(_text(F.col("c_custkey")), 9, "0"), F.col("c_name"), F.lit(" "), F.col("c_mktsegment")
    )
    content = F.replace(_lines(header, values), F.lit(";"), separator)
    name = F.concat(F.col("c_name"), F.lit(".csv"))
    found = extract.extract_parsed(_as_files(rows, F.col("c_custkey"), name, _bytes(content)))
    return _one_page(found, "c_custkey")


@query
def delimited_lines(spark, folder):
    """Customers as a delimited file per nation, read in splits: the place and the line of each."""
    root = scratch_path(spark, "delimited")
    rows = table(spark, folder, "customer").select(
        "c_nationkey", "c_custkey", F.concat(F.lit('a "b", '), "c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), F.lit("NA").alias("none"),
    )
    ordered = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.write.option("header", True).option("sep", ";").option("escape", '"').partitionBy("c_nationkey").csv(root)
    read = delimited.delimited_lines(spark, root)
    nation = F.regexp_extract("rel_path", "c_nationkey=([0-9]+)", 1).cast("int")
    return read.select(nation.alias("c_nationkey"), "pos", "line")


@query
def delimited_records(spark, folder):
    """Customers as a delimited file per nation with line feeds, quotes and separators in cells, and some records too long."""
    root = scratch_path(spark, "records")
    name = F.concat(F.lit('"first; ""line""\nof '), "c_name", F.lit('"'))
    record = F.concat_ws(
        ";", _text(F.col("c_custkey")), name, F.lit('5" wide'), F.when(F.col("c_custkey") % 5 == 0, F.lit('"\n\n"')).otherwise(F.col("c_mktsegment")),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("more")),
    )
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", record.alias("value"))
    header = rows.select("c_nationkey", F.lit(-1).cast("long").alias("c_custkey"), F.lit('key;"the\nname";size;segment').alias("value")).distinct()
    ordered = rows.unionByName(header).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.drop("c_custkey").write.partitionBy("c_nationkey").text(root)
    read = delimited.delimited_lines(spark, root, ("txt",))
    nation = F.regexp_extract("rel_path", "c_nationkey=([0-9]+)", 1).cast("int")
    return read.select(nation.alias("c_nationkey"), "pos", "line", "error")


@query
def tsv_text(spark, folder):
    rows = table(spark, folder, "part")
    content = _lines(F.lit("p_name\tp_brand\tp_size"), F.concat_ws("\t", "p_name", "p_brand", _text(F.col("p_size"))))
    name = F.concat(_text(F.col("p_partkey")), F.lit(".tsv"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("p_partkey"), name, _bytes(content))), "p_partkey")


@query
def json_text(spark, folder):
    rows = table(spark, folder, "part")
    content = F.to_json(F.struct("p_name", "p_partkey", F.array("p_brand", "p_type").alias("kinds")))
    name = F.concat(_text(F.col("p_partkey")), F.lit(".json"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("p_partkey"), name, _bytes(content))), "p_partkey")


@query
def jsonl_normalise(spark, folder):
    """A file per event: its JSON without spaces, a blank line, and a line that is no JSON."""
    rows = table(spark, folder, "events")
    content = _lines(F.replace("props", F.lit(" "), F.lit("")), F.lit("  "), F.concat(F.lit("- "), "event_type"))
    name = F.concat(_text(F.col("event_id")), F.lit(".jsonl"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("event_id"), name, _bytes(content))), "event_id")


@query
def yaml_text(spark, folder):
    rows = table(spark, folder, "supplier")
    content = _lines(
        F.concat(F.lit("nation: "), _text(F.col("s_nationkey"))), F.lit("kinds: [b, a]"),
        F.concat(F.lit("key: "), _text(F.col("s_suppkey"))),
    )
    name = F.concat(_text(F.col("s_suppkey")), F.lit(".yml"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("s_suppkey"), name, _bytes(content))), "s_suppkey")


@query
def toml_text(spark, folder):
    """Valid files, and every third one not valid, which stays as it is."""
    rows = table(spark, folder, "supplier")
    value = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(
        F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))
    )
    content = _lines(
        F.concat(F.lit("name = "), value), F.lit("[place]"), F.concat(F.lit("nation = "), _text(F.col("s_nationkey")))
    )
    name = F.concat(_text(F.col("s_suppkey")), F.lit(".toml"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("s_suppkey"), name, _bytes(content))), "s_suppkey")


@query
def xml_text(spark, folder):
    rows = table(spark, folder, "part")
    content = F.concat(
        F.lit("<?xml version='1.0'?><part>\n <name>"), "p_name", F.lit("</name><!-- c --><brand>"), "p_brand",
        F.lit("</brand><type a='1'>"), "p_type", F.lit("</type></part>"),
    )
    name = F.concat(_text(F.col("p_partkey")), F.lit(".xml"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("p_partkey"), name, _bytes(content))), "p_partkey")


@query
def eml_text(spark, folder):
    """A message per conversation turn."""
    rows = table(spark, folder, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    content = F.concat(
        F.lit("From: "), "role", F.lit("@example.com\nSubject: conversation "), _text(F.col("conv_id")),
        F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n"),
    )
    name = F.concat(_text(F.col("key")), F.lit(".eml"))
    return _one_page(extract.extract_parsed(_as_files(rows, F.col("key"), name, _bytes(content))), "message_id")


# Files made before they are sent on.
_BUILT_AT_ONCE = 64


def _built_files(df: DataFrame, key: str, ext: str, build) -> DataFrame:
    """Files made by ``build(values)`` from the other columns of each row."""
    inputs = [c for c in df.columns if c != key]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _BUILT_AT_ONCE):
                batch = whole.slice(at, _BUILT_AT_ONCE)
                made = [build(*values) for values in zip(*(batch.column(c).to_pylist() for c in inputs))]
                names = [f"f{k}.{ext}" for k in batch.column(key).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(names), pa.array([ext] * len(made)), pa.array(made, pa.binary())],
                    names=["file_id", "source_file", "ext", "content"],
                )

    return spread(df).mapInArrow(run, "file_id long, source_file string, ext string, content binary")


@query
def docx_text(spark, folder):
    """A file per document: a paragraph per line, and a table with its language and source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    made = _built_files(
        docs, "doc_id", "docx", lambda t, lang, source: sample_files.docx(t.split("\n"), [[[lang, " ", source]]])
    )
    return _one_page(extract.extract_parsed(made), "doc_id")


@query
def pptx_text(spark, folder):
    """A file per part: a slide with its names and a table, an empty slide, and a slide with its brand."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    made = _built_files(
        rows, "p_partkey", "pptx",
        lambda name, kind, brand: sample_files.pptx([[name, kind], [], [brand]], [["type", kind]]),
    )
    return _one_page(extract.extract_parsed(made), "p_partkey")


def _workbook(name: str, balance: str, nation: int) -> dict:
    return {
        "main": [["name", "balance", "note"], [name, float(balance), None], [None, None, None]],
        "empty": [],
        "nation": [["nation"], [nation]],
    }


def _workbook_rows(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", _text(_money(F.col("c_acctbal"))).alias("balance"), "c_nationkey"
    )


@query
def xlsx_text(spark, folder):
    """A workbook per customer with an empty sheet in the middle."""
    made = _built_files(
        _workbook_rows(spark, folder), "c_custkey", "xlsx", lambda *row: sample_files.xlsx(_workbook(*row))
    )
    return _page_texts(extract.extract_parsed(made), "c_custkey")


@query
def ods_text(spark, folder):
    made = _built_files(
        _workbook_rows(spark, folder), "c_custkey", "ods", lambda *row: sample_files.ods(_workbook(*row))
    )
    return _page_texts(extract.extract_parsed(made), "c_custkey")


@query
def odt_text(spark, folder):
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", "text"
    )
    made = _built_files(turns, "message_id", "odt", lambda role, t: sample_files.odt([role, t]))
    return _one_page(extract.extract_parsed(made), "message_id")


@query
def epub_text(spark, folder):
    """A book per part, with chapters out of name order and an empty one."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    made = _built_files(
        rows, "p_partkey", "epub",
        lambda name, brand: sample_files.epub(
            {"c3.xhtml": f"<p>{brand}</p>", "c1.html": f"<title>{name}</title><style>p</style>", "c2.htm": "<p> </p>"}
        ),
    )
    return _one_page(extract.extract_parsed(made), "p_partkey")


@query
def extract_errors(spark, folder):
    """Parts as files of a known kind without a reader, an unknown kind, broken, or blank: what went wrong."""
    rows = table(spark, folder, "part")
    turn = (F.col("p_partkey") % 4).cast("int") + 1
    ext = F.element_at(F.array(*[F.lit(e) for e in (".ppt", ".bin", ".docx", ".txt")]), turn)
    content = F.when(turn == 4, " \n ").otherwise(F.col("p_name"))
    made = _as_files(rows, F.col("p_partkey"), F.concat(_text(F.col("p_partkey")), ext), _bytes(content))
    found = extract.extract(made).withColumn("path", F.col("source_file"))
    return extract.to_errors(found).select("path", "stage", F.substring_index("reason", ":", 1).alias("reason"))


# ---- tables ---------------------------------------------------------------------------------------------


def _customer_line() -> dict[str, Column]:
    return {
        "c_custkey": F.col("c_custkey"),
        "c_name": F.col("c_name"),
        "c_nationkey": F.col("c_nationkey"),
        "c_acctbal": _money(F.col("c_acctbal")),
        "c_mktsegment": F.col("c_mktsegment"),
    }


@query
def serialise_customer(spark, folder):
    rows = table(spark, folder, "customer")
    return tabular.serialise_rows(rows, _customer_line(), ["c_custkey"])


@query
def serialise_part(spark, folder):
    """With blanks: small parts have no brand, and large ones a type of spaces only."""
    rows = table(spark, folder, "part")
    columns = {
        "p_name": F.concat(F.lit(" "), "p_name", F.lit("\t")),
        "p_brand": F.when(F.col("p_size") > 10, F.col("p_brand")),
        "p_type": F.when(F.col("p_size") < 40, F.col("p_type")).otherwise("  "),
        "p_retailprice": _money(F.col("p_retailprice")),
    }
    return tabular.serialise_rows(rows, columns, ["p_partkey"])


@query
def table_chunks(spark, folder):
    """Customers as one sheet per nation."""
    rows = spread(table(spark, folder, "customer"))
    lines = tabular.serialise_rows(rows, _customer_line(), ["c_nationkey", "c_custkey"])
    return tabular.chunk_lines(lines, ["c_nationkey"], position="c_custkey")


@query
def table_chunks_large(spark, folder):
    """Orders as one sheet per status: few, very long tables."""
    rows = spread(table(spark, folder, "orders"))
    columns = {
        "order": F.col("o_orderkey"),
        "customer": F.col("o_custkey"),
        "price": _money(F.col("o_totalprice")),
        "ordered": F.to_date("o_orderdate"),
        "priority": F.col("o_orderpriority"),
    }
    lines = tabular.serialise_rows(rows, columns, ["o_orderstatus", "o_orderkey"])
    return tabular.chunk_lines(lines, ["o_orderstatus"], position="o_orderkey")


@query
def corpus_from_table(spark, folder):
    """Parts as documents, one per row."""
    rows = table(spark, folder, "part")
    columns = {c: F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")}
    return ingest.chunk_table(rows, F.concat(F.lit("part_"), _text(F.col("p_partkey"))), columns=columns)


# ---- names and requests ---------------------------------------------------------------------------------


def _stripped_url() -> Column:
    return F.regexp_replace("url", "^https?://", "")


@query
def doc_id_slug(spark, folder):
    urls = table(spark, folder, "pages").select(F.col("url").alias("path"))
    names = table(spark, folder, "part").select(F.concat(F.lit("Ünïts/"), "p_name", F.lit(".tar.gz")).alias("path"))
    dashes = table(spark, folder, "nation").select(F.concat(F.lit("n/"), _text(F.col("n_nationkey")), F.lit("/--.txt")).alias("path"))
    every = urls.unionByName(names).unionByName(dashes)
    return every.select("path", paths.make_doc_id(F.col("path")).alias("doc_id"))


@query
def path_parts(spark, folder):
    name = paths.file_name(F.col("url"))
    return table(spark, folder, "pages").select(
        "page_id", name.alias("name"), paths.stem(name).alias("stem"), paths.suffix(name).alias("suffix"),
        F.size(paths.path_parts(F.col("url"))).alias("parts"),
    )


@query
def doc_id_collisions(spark, folder):
    docs = table(spark, folder, "pages").select(
        F.regexp_extract("url", "^https?://[^/]*/([a-z]*)/", 1).alias("client_id"),
        F.col("url").alias("rel_path"),
        paths.make_doc_id(F.col("url")).alias("doc_id"),
    )
    return catalog.doc_id_collisions(docs, ["client_id"])


@query
def safe_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", paths.safe_name(F.concat("url", F.lit('\\*"<>|'))).alias("saved_name")
    )


@query
def safe_str(spark, folder):
    turn = F.col("p_partkey") % 3
    value = F.when(turn == 0, "  \n").when(turn == 1, F.concat(F.lit("\t "), "p_name", F.lit(" ")))
    return table(spark, folder, "part").select(
        "p_partkey",
        text.safe_str(value).alias("value"),
        text.safe_str(value, "none").alias("value_or_none"),
        text.safe_str(F.col("p_size")).alias("size_text"),
    )


@query
def text_cleanup(spark, folder):
    """Unicode white space around each text, and runs of newlines inside."""
    padded = F.concat(F.lit("  \t "), "text", F.lit("　\x1f\x85\n"))
    stripped = text.strip(padded)
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n\n"))
    return table(spark, folder, "documents").select(
        "doc_id",
        stripped.alias("stripped"),
        text.collapse_newlines(spaced).alias("collapsed"),
        text.preview(stripped).alias("preview"),
    )


@query
def client_key(spark, folder):
    client = F.concat(F.lit("\t "), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(""), F.lit(" "))
    name = F.concat(F.lit("some/folder/"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).otherwise(" "))
    return table(spark, folder, "customer").select(
        "c_custkey",
        paths.client_key(client).alias("client_id"),
        paths.client_object_key(F.lit("raw"), client, name).alias("object_key"),
    )


@query
def request_checks(spark, folder):
    key = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("directory"), F.lit("drive"), F.lit("sharepoint")), (key % 3).cast("int") + 1)
    place = (
        F.when(key % 5 == 0, "  ")
        .when(key % 2 == 0, F.concat(F.lit("https://corp.SharePoint.com/sites/"), "c_name"))
        .otherwise(F.concat(F.lit(" /data/"), "c_name"))
    )
    requests = table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 11 > 0, F.concat(F.lit(" "), "c_mktsegment")).alias("client_id"), kind.alias("kind"),
        place.alias("place"),
    )
    return files.check_requests(requests).select("c_custkey", "client_key", "place_key", "problem")


# ---- files and objects ----------------------------------------------------------------------------------


@query
def scan_sizes(spark, folder):
    listing = table(spark, folder, "pages").select(
        F.concat(_stripped_url(), F.when(F.col("page_id") % 2 == 0, ".HTML").otherwise(".bin")).alias("rel_path"),
        F.octet_length("html").alias("length"),
    )
    return files.describe_listing(listing)


@query
def supported_filter(spark, folder):
    endings = [*files.FOLDER_EXTENSIONS, "bin", "log", "mp4"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("p_partkey") % len(endings)).cast("int") + 1)
    return table(spark, folder, "part").select(
        "p_partkey", F.concat("p_name", F.lit("."), F.upper(ending)).alias("name")
    ).select(
        "p_partkey",
        files.supported(F.col("name")).alias("from_folder"),
        files.supported(F.col("name"), files.UPLOAD_EXTENSIONS).alias("from_upload"),
    )


@query
def upload_gate(spark, folder):
    key = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in (".TXT", ".exe", ".pdf", "", ".md")]), (key % 5).cast("int") + 1)
    uploads = table(spark, folder, "documents").select(
        "doc_id",
        F.when(key % 7 > 0, F.col("source")).otherwise(" ").alias("client_id"),
        F.concat(F.lit("d"), _text(key), ending).alias("filename"),
        (F.col("n_chars") * 8192).alias("size_bytes"),
    )
    return files.upload_gate(uploads).select("doc_id", "accepted", "reject_code", "reject_reason")


@query
def content_sha256(spark, folder):
    return table(spark, folder, "documents").select("doc_id", paths.sha256_hex(_bytes(F.col("text"))).alias("sha256"))


def _page_objects(spark, folder) -> DataFrame:
    """Pages as stored objects under three of the four prefixes."""
    key = F.col("page_id")
    prefix = F.element_at(F.array(F.lit("raw/"), F.lit("chunks/"), F.lit("meta/")), (key % 3).cast("int") + 1)
    ending = F.element_at(F.array(F.lit(".html"), F.lit(".jsonl"), F.lit(".json")), (key % 3).cast("int") + 1)
    return table(spark, folder, "pages").select(
        F.concat(prefix, _text(key % 10), F.lit("/"), _text(key), ending).alias("name"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.timestamp_seconds(key * 3600).alias("modified"),
    )


@query
def object_listing(spark, folder):
    return objects.describe_objects(objects.with_prefix(_page_objects(spark, folder), "raw/"))


@query
def object_exists(spark, folder):
    keys = table(spark, folder, "documents").select(F.concat(F.lit("raw/"), _text(F.col("doc_id"))).alias("name"))
    stored = table(spark, folder, "labels").select(F.concat(F.lit("raw/"), _text(F.col("doc_id"))).alias("name"))
    return objects.which_exist(keys, stored)


@query
def put_objects(spark, folder):
    """All documents put beside stored benchmark items and over the labelled documents, with and without overwriting."""
    name = F.concat(F.lit("raw/"), _text(F.col("doc_id"))).alias("name")
    item = F.concat(F.lit("raw/item/"), _text(F.col("item_id"))).alias("name")
    stored = table(spark, folder, "labels").select(name, F.lit(0).cast("long").alias("size_bytes"))
    items = table(spark, folder, "benchmark").select(item, F.length("text").cast("long").alias("size_bytes"))
    stored = stored.unionByName(items)
    incoming = table(spark, folder, "documents").select(name, F.col("n_chars").cast("long").alias("size_bytes"))
    parts = []
    for overwrite in (True, False):
        after, results = objects.put_objects(stored, incoming, overwrite)
        joined = after.join(results, F.col("name") == F.col("blob_name"), "left")
        parts.append(joined.select(F.lit(overwrite).alias("overwrite"), "name", "size_bytes", "success", "error"))
    return parts[0].unionByName(parts[1])


@query
def object_round_trip(spark, folder):
    """Documents put as objects, some of them again with and without overwriting, and read back by key.

    Every result is a row: the puts with what went wrong, and what is stored in the end.
    """
    root = scratch_path(spark, "objects")
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    name = F.concat(F.lit("raw/"), F.col("lang"), F.lit("/"), _text(F.col("doc_id")), F.lit(".txt")).alias("name")
    objects.write_objects(docs.select(name, _bytes(F.col("text")).alias("content")), root).count()
    puts = []
    for overwrite, rest in ((False, 0), (True, 1)):
        part = docs.filter(F.col("doc_id") % 3 == rest)
        fresh = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new/"), name)).otherwise(name).alias("name")
        content = _bytes(F.concat(F.lit(f"{overwrite} "), "text")).alias("content")
        done = objects.write_objects(part.select(fresh, content), root, overwrite)
        puts.append(done.select(F.lit("put").alias("what"), "blob_name", "success", F.col("error").alias("detail")))
    keys = docs.select(name).unionByName(docs.select(F.concat(F.lit("new/"), name).alias("name")))
    read = objects.read_objects(keys, root).select(
        F.lit("read").alias("what"), F.col("name").alias("blob_name"), F.lit(True).alias("success"), F.sha2("content", 256).alias("detail")
    )
    return puts[0].unionByName(puts[1]).unionByName(read)


@query
def list_hidden(spark, folder):
    """Pages as files, some with hidden names or in hidden folders and some without a byte: the listing of the folder."""
    root = scratch_path(spark, "tree")
    key = F.col("page_id")
    name = F.concat(
        F.when(key % 3 == 0, "_drafts/").when(key % 3 == 1, "a/.cache/").otherwise("a/"),
        F.when(key % 2 == 0, "_p").otherwise("p"), _text(key), F.lit(".html"),
    ).alias("name")
    content = F.when(key % 5 == 0, F.lit(b"")).otherwise(_bytes(F.col("html"))).alias("content")
    objects.write_objects(spread(table(spark, folder, "pages").select("page_id", "html")).select(name, content), root).count()
    return files.scan_directory(spark, root)


@query
def document_meta_files(spark, folder):
    """Metadata files written as objects, a broken one for every seventh, and read back."""
    root = scratch_path(spark, "meta")
    about = ("source_file", "total_pages", "total_chunks", "total_chars")
    meta = _conversation_meta(spark, folder).select(F.concat(F.lit("conv_"), "conv_id").alias("doc_id"), *about)
    text_ = F.to_json(F.struct(*meta.columns))
    broken = F.when(F.col("total_chars") % 7 == 0, F.substr(text_, F.lit(1), F.length(text_) - 1)).otherwise(text_)
    name = F.concat(F.lit("acme/"), "doc_id", F.lit("_meta.json")).alias("name")
    objects.write_objects(spread(meta.select(name, _bytes(broken).alias("content"))), root).count()
    return records.read_document_meta(spark, root).select(*meta.columns)


@query
def utc_now(spark, folder):
    """The time of the query beside each event: well formed, and not before the event's stamp of 2020 or after."""
    now = text.utc_now_iso()
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?\+00:00$"
    return table(spark, folder, "events").select("event_id", now.rlike(shape).alias("well_formed"), (now >= "2024").alias("recent"))


@query
def public_url(spark, folder):
    url = paths.public_url(F.lit("account"), F.lit("container"), F.col("name"))
    return _page_objects(spark, folder).select("name", url.alias("url"))


@query
def storage_status(spark, folder):
    return catalog.storage_status(_page_objects(spark, folder))


@query
def delete_prefix(spark, folder):
    stored = _page_objects(spark, folder)
    gone = catalog.delete_prefix_count(stored, "chunks/").select(F.lit("deleted").alias("what"), F.col("deleted").alias("objects"))
    left = catalog.without_prefix(stored, "chunks/").agg(F.count(F.lit(1)).alias("objects"))
    return gone.unionByName(left.select(F.lit("kept").alias("what"), "objects"))


@query
def coverage_gap(spark, folder):
    listed, loaded = table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels")
    return files.not_loaded(listed, loaded, ["doc_id"])


# ---- remote listings ------------------------------------------------------------------------------------

_ROOT = "root"
_DRIVE_MIME = (
    "application/pdf", "application/vnd.google-apps.document", "application/octet-stream", "image/png", "text/plain",
)


def _remote_folders(spark, folder) -> DataFrame:
    """Regions as folders of the root, nations as folders of regions."""
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("r"), _text(F.col("r_regionkey"))).alias("id"), F.lit(_ROOT).alias("parent_id"),
        F.col("r_name").alias("name"),
    )
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("n"), _text(F.col("n_nationkey"))).alias("id"),
        F.concat(F.lit("r"), _text(F.col("n_regionkey"))).alias("parent_id"),
        F.concat("n_name", F.lit(":*")).alias("name"),
    )
    return regions.unionByName(nations)


def _remote_files(spark, folder) -> DataFrame:
    """Customers as files in their nation's folder."""
    ending = F.element_at(
        F.array(*[F.lit(e) for e in (".PDF", ".draft", "", ".CSV", ".exe")]), (F.col("c_custkey") % 5).cast("int") + 1
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("c"), _text(F.col("c_custkey"))).alias("id"),
        F.concat(F.lit("n"), _text(F.col("c_nationkey"))).alias("parent_id"),
        F.concat("c_name", ending).alias("name"),
        F.col("c_custkey").alias("key"),
    )


@query
def drive_manifest(spark, folder):
    mime = F.element_at(F.array(*[F.lit(m) for m in _DRIVE_MIME]), (F.floor(F.col("key") / 5) % 5).cast("int") + 1)
    items = _remote_files(spark, folder).select("id", "parent_id", "name", mime.alias("mime"))
    folders = _remote_folders(spark, folder).withColumn("mime", F.lit(manifest.FOLDER_MIME))
    return manifest.plan_drive(folders.unionByName(items), _ROOT)


@query
def sharepoint_manifest(spark, folder):
    url = F.when(F.col("key") % 3 > 0, F.concat(F.lit("https://dl/"), "id"))
    items = _remote_files(spark, folder).select(
        "id", "parent_id", "name", F.lit(False).alias("is_folder"), url.alias("download_url")
    )
    folders = _remote_folders(spark, folder).select(
        "*", F.lit(True).alias("is_folder"), F.lit(None).cast("string").alias("download_url")
    )
    return manifest.plan_sharepoint(folders.unionByName(items), _ROOT)


@query
def sharepoint_site(spark, folder):
    """Suppliers ask for a nation's site; the search returns all sites of some region."""
    suppliers = table(spark, folder, "supplier")
    requests = suppliers.select(
        F.col("s_suppkey").alias("request_id"),
        F.concat(F.lit("https://corp.sharepoint.com/sites/nation_"), _text(F.col("s_suppkey") % 10), F.lit("/")).alias("site_url"),
    )
    nations = table(spark, folder, "nation")
    sites = suppliers.join(nations, F.col("s_suppkey") % 5 == F.col("n_regionkey")).select(
        F.col("s_suppkey").alias("request_id"), F.col("n_nationkey").alias("position"),
        F.concat(F.lit("s"), _text(F.col("n_nationkey"))).alias("site_id"), F.concat(F.lit("Team "), "n_name").alias("name"),
    )
    return manifest.choose_site(requests, sites)


@query
def sharepoint_drive(spark, folder):
    """Customers as drives of their nation's site; some bear a document library's name."""
    name = F.when(F.col("c_custkey") % 40 == 7, "Shared Documents").otherwise(F.col("c_name"))
    drives = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("site_id"), F.col("c_custkey").alias("position"),
        F.concat(F.lit("d"), _text(F.col("c_custkey"))).alias("drive_id"), name.alias("name"),
    )
    return manifest.choose_drive(drives)


@query
def library_paths(spark, folder):
    turn = F.col("p_partkey") % 3
    path = (
        F.when(turn == 0, F.concat(F.lit("/Shared Documents/"), "p_name", F.lit("/")))
        .when(turn == 1, "shared documents/")
        .otherwise(F.concat("p_name", F.lit("/Shared Documents/x")))
    )
    return table(spark, folder, "part").select("p_partkey", manifest.library_folder(path).alias("folder"))


# ---- vectors --------------------------------------------------------------------------------------------


def _embedded(spark, folder, dimension: int) -> DataFrame:
    """Document chunks with vectors and a numeric id."""
    chunks = _document_chunks(spark, folder).select(
        "doc_id", "chunk_index", "chunk_id", "text"
    )
    embedded = embedding.embed(chunks, factory=_hashing(dimension)).withColumn("all", F.lit(0))
    return vectors.assign_vector_ids(embedded, ["all"], "doc_id", [F.col("doc_id")])


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _hashing(dimension: int):
    return partial(embedding.HashingEmbedder, dimension)


@query
def hash_embedding(spark, folder):
    """The non-zero entries of each document's vector."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vectors_ = embedding.embed(docs, factory=_hashing(embedding.DIMENSION))
    return (
        vectors_.select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
        .filter("value != 0")
        .select("doc_id", "bucket", F.round(F.col("value").cast("double"), 5).alias("value"))
    )


@query
def embedding_unit(spark, folder):
    scaled = F.transform("embedding", lambda x: x * (F.col("label") + 2).cast("float"))
    unit = embedding.unit_vector(scaled)
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode(unit).alias("pos", "value"))
        .select("vec_id", "pos", F.round("value", 6).alias("value"))
    )


@query
def vector_stats(spark, folder):
    return vectors.vector_stats(table(spark, folder, "embeddings"), ["label"])


@query
def vector_ids(spark, folder):
    """Positions of the chunks of each language's documents."""
    chunks = _document_chunks(spark, folder).select(
        F.col("extra_metadata")["lang"].alias("lang"),
        F.concat(F.col("extra_metadata")["source"], F.lit("/"), _text(F.col("doc_id")), F.lit(".txt")).alias("rel_path"),
        "chunk_index",
    )
    return vectors.assign_vector_ids(chunks, ["lang"], "rel_path", [paths.path_parts(F.col("rel_path"))])


def _self_search(spark, folder) -> DataFrame:
    corpus = table(spark, folder, "embeddings")
    return vectors.search(corpus, corpus.select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query
def knn_l2(spark, folder):
    return _self_search(spark, folder).withColumn("distance", F.round("distance", 6))


@query
def knn_blocks(spark, folder):
    """The same search with room for 64 query vectors at a time."""
    corpus = table(spark, folder, "embeddings")
    asked = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search(corpus, asked, 5, block_bytes=64 * 64 * 8).withColumn("distance", F.round("distance", 6))


@query
def knn_pivots(spark, folder):
    """The same search by an index that leaves out blocks of vectors too far away."""
    corpus = table(spark, folder, "embeddings")
    asked = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vectors.search_pivots(vectors.build_pivot_index(corpus), asked, 5, block_bytes=256 * 64 * 8)
    return hits.withColumn("distance", F.round("distance", 6))


@query
def knn_chunk_join(spark, folder):
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    return vectors.attach_chunks(_self_search(spark, folder), labels, ["vec_id"]).select(
        "query_id", "rank", "vec_id", "label"
    )


@query
def search_chunks(spark, folder):
    """The three chunks nearest to each benchmark text."""
    asked = embedding.embed(table(spark, folder, "benchmark"), factory=_hashing(64))
    corpus = _embedded(spark, folder, 64)
    corpus = _stored(corpus.select("vec_id", "chunk_id", "embedding"), "search")
    hits = vectors.search(corpus, asked.withColumnRenamed("item_id", "query_id"), 3)
    return vectors.attach_chunks(hits, corpus.select("vec_id", "chunk_id"), ["vec_id"]).select(
        "query_id", "rank", "chunk_id", F.round("distance", 5).alias("distance")
    )


# ---- records and reports --------------------------------------------------------------------------------


@query
def chunk_jsonl_roundtrip(spark, folder):
    """Chunks to JSON lines and back, with an extra key and without a vector."""
    chunks = _document_chunks(spark, folder).select(
        _text(F.col("doc_id")).alias("doc_id"), "chunk_id", "chunk_index", "page", "text",
        F.lit("f.txt").alias("source_file"), F.lit("local").alias("source_type"), F.lit("2024").alias("uploaded_at"),
        "char_count", F.lit(None).cast("array<float>").alias("embedding"), "extra_metadata",
    )
    read = metadata.parse_chunk_lines(chunks.select(metadata.chunk_json().alias("value")))
    return read.select(
        *[c for c in read.columns if c not in ("extra_metadata", "embedding")],
        F.col("extra_metadata")["lang"].alias("lang"),
        F.col("extra_metadata")["source"].alias("source"),
        F.col("embedding").isNull().alias("no_vector"),
    )


@query
def chunk_defaults(spark, folder):
    """Chunk lines with missing fields, blank or malformed lines."""
    key = _text(F.col("event_id"))
    turn = F.col("event_id") % 6
    line = (
        F.when(turn == 0, "{}")
        .when(turn == 1, F.concat(F.lit('{"doc_id": "e'), key))
        .when(turn == 2, "  ")
        .when(turn == 3, F.concat(F.lit('{"doc_id": "e'), key, F.lit('", "chunk_index": 7, "text": "é'), key, F.lit('", "kind": "x"}')))
        .when(turn == 4, F.concat(F.lit('{"chunk_id": "", "page": 3, "embedding": [0.5, 1], "extra": '), "props", F.lit("}")))
        .otherwise(F.concat(F.lit('{"chunk_id": "c'), key, F.lit('", "uploaded_at": "", "source_type": "upload", "char_count": 99}')))
    )
    rows = table(spark, folder, "events").select("event_id", line.alias("value"))
    read = metadata.with_upload_time(metadata.parse_chunk_lines(rows, keep=["event_id"]), _RUN_TIME)
    return read.select(
        *[c for c in read.columns if c not in ("extra_metadata", "embedding")],
        F.col("extra_metadata")["kind"].alias("kind"),
        F.replace(F.col("extra_metadata")["extra"], F.lit(" "), F.lit("")).alias("extra"),
        F.size("embedding").alias("vector_size"),
    )


def _conversation_meta(spark, folder) -> DataFrame:
    documents = metadata.count_pages(_turns(spark, folder), ["conv_id"]).withColumn(
        "source_file", F.concat(F.lit("conv "), _text(F.col("conv_id")), F.lit(".eml"))
    )
    return metadata.document_meta(documents, _conversation_chunks(spark, folder), ["conv_id"], F.lit("2024-01-01"))


@query
def document_meta(spark, folder):
    return _conversation_meta(spark, folder)


@query
def object_urls(spark, folder):
    """Stored objects of each conversation with their addresses."""
    meta = _conversation_meta(spark, folder)
    keys = metadata.object_keys(F.lit(" Acme "), F.col("source_file"), paths.make_doc_id(F.col("source_file")))
    return meta.select("conv_id", F.explode(metadata.object_urls(keys, "account", "container")).alias("kind", "url"))


@query
def per_document_summary(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    return metadata.per_document(documents, _document_chunks(spark, folder), ["doc_id"])


def _uploads(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("source", "doc_id", (F.col("n_chars") < 5000).alias("success"))


@query
def run_summary(spark, folder):
    """A run per source; long documents fail to upload."""
    documents = table(spark, folder, "documents").select("source", "doc_id")
    loaded = metadata.per_document(documents, _document_chunks(spark, folder), ["doc_id"])
    return metadata.run_summary(loaded, _uploads(spark, folder), ["source"], 1.005)


@query
def upload_results(spark, folder):
    client = F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(" ")
    stored = table(spark, folder, "customer").select(
        "c_custkey", paths.client_object_key(F.lit("raw"), client, F.col("c_name")).alias("object_name")
    )
    return metadata.upload_results(stored, "account", "container")


@query
def run_errors(spark, folder):
    return metadata.upload_errors(_uploads(spark, folder))


@query
def run_status(spark, folder):
    failed = table(spark, folder, "documents").groupBy("lang").agg(
        F.count_if(F.col("n_chars") > 20_000).alias("uploads_failed"), (F.count_if(F.col("n_chars") > 30_000) > 0).alias("broken")
    )
    return failed.select("lang", "uploads_failed", metadata.run_status(F.col("broken"), F.col("uploads_failed")).alias("status"))


@query
def ingestion_log(spark, folder):
    label = F.when(F.col("value") > 10, F.concat(F.lit("batch "), "event_type"))
    client = F.concat(F.lit(" "), F.upper("event_type"))
    return table(spark, folder, "events").select(
        "event_id", metadata.run_label(label, client).alias("label"), metadata.log_key(client, F.col("ts")).alias("object_name")
    )


# ---- catalogue ------------------------------------------------------------------------------------------


@query
def list_documents(spark, folder):
    meta = _conversation_meta(spark, folder).withColumn("doc_id", paths.make_doc_id(F.col("source_file")))
    key = paths.client_object_key(F.lit("meta"), F.lit("acme"), F.concat("doc_id", F.lit("_meta.json")))
    return catalog.list_documents(meta, paths.public_url(F.lit("account"), F.lit("container"), key))


@query
def get_document(spark, folder):
    return catalog.get_document(_conversation_meta(spark, folder), _conversation_chunks(spark, folder), ["conv_id"])


@query
def get_chunks_page(spark, folder):
    chunks = _conversation_chunks(spark, folder)
    return catalog.get_chunks(chunks, page=2, columns=["conv_id", "chunk_id", "chunk_index", "page", "char_count", "text"])


def _stored_documents(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Toxic documents to delete, and objects: chunks and metadata of labelled documents, some raw files."""
    labels = table(spark, folder, "labels")
    doc = F.concat(F.lit("d"), _text(F.col("doc_id")))
    targets = table(spark, folder, "documents").join(labels, "doc_id", "left").filter(
        (F.col("toxic") == 1) | (F.col("lang") == "es")
    ).select(F.lit("acme").alias("client_id"), doc.alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(doc, F.lit(".txt"))).alias("source_file"))
    names = F.array(
        F.concat(F.lit("chunks/acme/"), doc, F.lit("_chunks.jsonl")), F.concat(F.lit("meta/acme/"), doc, F.lit("_meta.json")),
        F.concat(F.lit("raw/acme/"), doc, F.lit(".txt")),
    )
    return targets, labels.select(F.explode(names).alias("name"))


@query
def delete_document(spark, folder):
    targets, stored = _stored_documents(spark, folder)
    return catalog.delete_report(targets, stored).drop("client_id")


@query
def delete_survivors(spark, folder):
    toxic = table(spark, folder, "labels").filter("toxic = 1")
    return catalog.without_documents(_document_chunks(spark, folder).select("doc_id", "chunk_id"), toxic, ["doc_id"])


def _rebuild_classes(spark, folder) -> DataFrame:
    meta = table(spark, folder, "documents").select("lang", "doc_id")
    chunks = table(spark, folder, "labels").join(meta, "doc_id").select("lang", "doc_id")
    return catalog.rebuild_classes(meta, chunks, ["lang", "doc_id"])


@query
def rebuild_classes(spark, folder):
    return _rebuild_classes(spark, folder)


@query
def rebuild_status(spark, folder):
    failed = (F.col("action") == "rebuild") & (F.col("lang") == "de")
    outcomes = _rebuild_classes(spark, folder).select(
        F.when(failed, "error").when(F.col("action") == "rebuild", "rebuilt").otherwise("skipped").alias("action")
    )
    return catalog.rebuild_status(outcomes)


def _job_events(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"),
        F.col("props").alias("detail"),
    )


@query
def job_status(spark, folder):
    return catalog.job_status(_job_events(spark, folder))


@query
def job_lookup(spark, folder):
    asked = table(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"))
    return catalog.lookup_jobs(asked, _job_events(spark, folder))


@query
def last_write_wins(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return catalog.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


# ---- whole jobs -----------------------------------------------------------------------------------------


def _landed_documents(spark, folder) -> str:
    """The documents as JSON lines in a fresh folder, half of them in .json and half in .txt files."""
    root = scratch_path(spark, "landed")
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    even = F.col("doc_id") % 2 == 0
    docs.filter(even).write.option("maxRecordsPerFile", 500).json(f"{root}/json")
    lines = docs.filter(~even).select(F.to_json(F.struct(*docs.columns)).alias("value"))
    lines.write.option("maxRecordsPerFile", 500).text(f"{root}/txt")
    return root


def _ingested_documents(store: Store, chunks: DataFrame | None = None) -> DataFrame:
    """Each ingested document once, by the fingerprint of its text, found in the stored chunks.

    Chunks without overlap hold every line of a file once, and every line is a document.
    """
    chunks = store.current("chunks") if chunks is None else chunks
    lines = chunks.select(F.explode(F.split("text", "\n")).alias("line"))
    record = F.from_json("line", "doc_id long, text string")
    return lines.select(record.alias("r")).select(
        "r.doc_id", paths.sha256_hex(_bytes(F.col("r.text"))).alias("sha256"), F.length("r.text").alias("n_chars")
    )


def _run() -> ingest.Run:
    return ingest.Run("Acme", started=_RUN_TIME, overlap=0, factory=_hashing(64), model="hashing-64")


@query
def ingest_directory(spark, folder):
    """A folder through every stage: archive, text, chunks, vectors and metadata."""
    store = Store(spark, scratch_path(spark, "store"))
    ingest.ingest_directory(store, _landed_documents(spark, folder), _run())
    return _ingested_documents(store)


_BUCKETS = 4


def _named_files(spark, docs: DataFrame) -> str:
    """``docs`` as JSON lines in the files ``part0.txt`` to ``part3.txt`` of a fresh folder, by document id."""
    return _shared_files(spark, docs, 1)[0]


# Bytes of an uploaded file on average: below what the gate lets pass, as shares differ a little.
_UPLOAD_BYTES = 28 << 20


def _named_line() -> Column:
    # Padded: a file whose only line has no more characters than a chunk must exceed would give none.
    return F.to_json(F.struct("doc_id", F.lit("." * chunking.MIN_CHARS).alias("pad"), "text"))


def _shared_files(spark, docs: DataFrame, shares: int) -> list[str]:
    """The same in ``shares`` folders, each with a share of the documents."""
    root = scratch_path(spark, "named")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares)).alias("share")
    lines = docs.select(share, F.pmod("doc_id", F.lit(_BUCKETS)).alias("b"), _named_line().alias("value"))
    lines.repartition("share", "b").write.partitionBy("share", "b").text(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in range(shares):
        for b in range(_BUCKETS):
            for status in fs.globStatus(path(f"{root}/share={s}/b={b}/part-*")) or []:
                fs.rename(status.getPath(), path(f"{root}/share={s}/part{b}.txt"))
            fs.delete(path(f"{root}/share={s}/b={b}"), True)
    return [f"{root}/share={s}" for s in range(shares)]


def _ingested(spark, folder) -> tuple[Store, str]:
    store = Store(spark, scratch_path(spark, "store"))
    root = _named_files(spark, table(spark, folder, "documents"))
    ingest.ingest_directory(store, root, _run())
    return store, root


@query
def reingest_changed(spark, folder):
    """Two files ingested again, one with every text changed and one turned blank: what is current and searchable."""
    store, _ = _ingested(spark, folder)
    bucket = F.pmod("doc_id", F.lit(_BUCKETS))
    docs = table(spark, folder, "documents").filter(bucket.isin(1, 2))
    changed = docs.filter(bucket == 1).select("doc_id", F.concat(F.lit("new "), "text").alias("text"))
    root = _named_files(spark, changed)
    blank = docs.filter(bucket == 2).select(F.lit(" ").alias("value")).coalesce(1)
    blank.write.text(f"{root}/blank")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(path(f"{root}/blank/part-*"))[0].getPath(), path(f"{root}/part2.txt"))
    fs.delete(path(f"{root}/blank"), True)
    later = replace(_run(), started=_RUN_TIME + timedelta(days=1), replace_index=False)
    ingest.ingest_directory(store, root, later)
    return _ingested_documents(store, _indexed(store))


def _indexed(store: Store) -> DataFrame:
    """The current chunks that the current index holds."""
    key = ["client_id", "run_id", "rel_path", "chunk_id"]
    return store.current("chunks").join(store.current("vectors").select(*key), key)


@query
def ingest_file(spark, folder):
    """Each of some files uploaded by itself, by as many clients as it takes for the gate to let all files pass."""
    store = Store(spark, scratch_path(spark, "store"))
    docs = table(spark, folder, "documents")
    length = F.octet_length(_named_line()) + 1
    sizes = docs.groupBy(F.pmod("doc_id", F.lit(_BUCKETS)).alias("b")).agg(F.sum(length).alias("bytes"))
    clients = max(1, -(-(sizes.agg(F.max("bytes")).first()[0] or 0) // _UPLOAD_BYTES))
    roots = _shared_files(spark, docs, clients)

    def uploads(client: int, root: str) -> list[tuple]:
        # One after another, as each adds to the client's index.
        rows = []
        for b in range(_BUCKETS):
            run = replace(_run(), client_id=f"Acme{client}", suffix=str(b), replace_index=False, source_type="upload")
            rows.append(tuple(ingest.ingest_file(store, f"{root}/part{b}.txt", run).select("filename", "doc_id", "status").first()))
        return rows

    # Clients upload independently of each other. An upload is a row that one task works on, and about as long in the
    # driver as in tasks, so that two per core keep the cores busy.
    with ThreadPoolExecutor(min(clients, 2 * spark.sparkContext.defaultParallelism)) as pool:
        rows = [row for found in pool.map(uploads, range(clients), roots) for row in found]
    results = spark.createDataFrame(rows, "filename string, doc_id string, status string").distinct()
    stamps = store.current("chunks").select(F.col("doc_id").alias("file"), "uploaded_at").distinct()
    files_ = results.select("filename", F.col("doc_id").alias("file"), "status").join(stamps, "file")
    found = _ingested_documents(store).withColumn("file", F.concat(F.lit("part"), F.pmod("doc_id", F.lit(_BUCKETS))))
    return found.join(files_, "file").drop("file")


@query
def ingest_sharepoint(spark, folder):
    """A library folder whose files have been fetched, next to one that was not asked for."""
    store = Store(spark, scratch_path(spark, "store"))
    root = _named_files(spark, table(spark, folder, "documents"))
    items = table(spark, folder, "documents").filter(F.pmod("doc_id", F.lit(_BUCKETS)) > 0).select(
        F.concat(F.lit("part"), F.pmod("doc_id", F.lit(_BUCKETS)), F.lit(".txt")).alias("name")
    ).distinct().select(
        F.col("name").alias("id"), F.lit(_ROOT).alias("parent_id"), "name", F.lit(False).alias("is_folder"),
        F.concat(F.lit("https://example.com/"), "name").alias("download_url"),
    )
    ingest.ingest_sharepoint(store, "job", items, _ROOT, root, _run())
    state = catalog.job_status(spark.read.parquet(store.path("jobs"))).select("request_id", F.col("status").alias("job"))
    return _ingested_documents(store).withColumn("request_id", F.lit("job")).join(state, "request_id").drop("request_id")


@query
def delete_stored(spark, folder):
    """An ingested folder after two of its documents have been deleted and their rows compacted away."""
    store, _ = _ingested(spark, folder)
    targets = spark.createDataFrame([("acme", "part1"), ("acme", "part3"), ("acme", "ghost")], "client_id string, doc_id string")
    report = maintenance.delete_documents(store, targets)
    left = _stored(_ingested_documents(store, _indexed(store)), "left")
    maintenance.compact(store)
    kept = store.read("chunks").select(F.col("doc_id").alias("file")).distinct()
    states = report.select(F.col("doc_id").alias("file"), "status").join(kept.withColumn("stored", F.lit(True)), "file", "full")
    rows = states.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("file").alias("sha256"), F.lit(None).cast("int").alias("n_chars"),
        F.coalesce("status", F.lit("kept")).alias("status"), F.coalesce("stored", F.lit(False)).alias("stored"),
    )
    return left.withColumn("status", F.lit("kept")).withColumn("stored", F.lit(True)).unionByName(rows)


@query
def rebuild_document(spark, folder):
    """The size of the vectors behind every document of an ingested folder once one file was embedded again."""
    store, _ = _ingested(spark, folder)
    maintenance.rebuild(store, "acme", doc_id="part2", factory=_hashing(32), model="hashing-32")
    key = ["client_id", "run_id", "rel_path", "chunk_id"]
    sizes = store.current("vectors").select(*key, F.size("embedding").alias("vector_size"))
    chunks = store.current("chunks").join(sizes, key)
    lines = chunks.select("vector_size", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.from_json("line", "doc_id long").alias("r"), "vector_size").select("r.doc_id", "vector_size")


@query
def rebuild_folded(spark, folder):
    """Vector sizes after one file was embedded again twice and another once, before and after these were folded in.

    ``stored`` is the size that the chunk table itself holds.
    """
    store, _ = _ingested(spark, folder)
    for doc, size in (("part1", 16), ("part2", 32), ("part1", 8)):
        maintenance.rebuild(store, "acme", doc_id=doc, factory=_hashing(size), model=f"hashing-{size}")
    parts = []
    for folded in (False, True):
        if folded:
            maintenance.compact(store)
        key = ["client_id", "run_id", "rel_path", "chunk_id"]
        raw = store.read("chunks").select(*key, F.size("embedding").alias("stored"))
        index = store.current("vectors").select(*key, F.size("embedding").alias("vector_size"))
        rows = store.current("chunks").select(*key, "model", "text").join(index, key).join(raw, key)
        lines = rows.select("model", "vector_size", "stored", F.explode(F.split("text", "\n")).alias("line"))
        found = lines.select(F.lit(folded).alias("folded"), F.from_json("line", "doc_id long")["doc_id"].alias("doc_id"), "model", "vector_size", "stored")
        parts.append(_stored(found, "renewed"))
    return parts[0].unionByName(parts[1])


@query
def exact_dedup(spark, folder):
    """Which documents repeat the text of an earlier one."""
    docs = table(spark, folder, "documents")
    return catalog.exact_duplicates(docs, F.col("text"), ["doc_id"]).select("doc_id", "kept", F.col("first.doc_id").alias("first_id"))


@query
def ingest_vectors(spark, folder):
    """Per client of an ingested folder: whether vectors, chunks and metadata agree."""
    store = Store(spark, scratch_path(spark, "store"))
    ingest.ingest_directory(store, _landed_documents(spark, folder), _run())
    found = store.read("vectors").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high")
    )
    totals = store.current("document_meta").groupBy("client_id").agg(F.sum("total_chunks").alias("chunks"))
    return found.join(totals, "client_id").select(
        "client_id", (F.col("n") == F.col("chunks")).alias("all_chunks"),
        ((F.col("ids") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("dense_ids"),
    )


@query
def ingest_drive(spark, folder):
    """The same folder as a drive listing whose files have been fetched, with job states."""
    store = Store(spark, scratch_path(spark, "store"))
    landed = _landed_documents(spark, folder)
    listing = files.read_files(spark, landed, ("json", "txt")).drop("content")
    items = listing.select(
        F.col("rel_path").alias("id"), F.element_at(paths.path_parts(F.col("rel_path")), 1).alias("parent_id"),
        F.col("source_file").alias("name"), F.lit("application/octet-stream").alias("mime"),
    )
    folders = items.select("parent_id").distinct().select(
        F.col("parent_id").alias("id"), F.lit(_ROOT).alias("parent_id"), F.col("parent_id").alias("name"),
        F.lit(manifest.FOLDER_MIME).alias("mime"),
    )
    # What else lands in the folder is not part of the job.
    stray = table(spark, folder, "documents").select(
        F.to_json(F.struct((-1 - F.col("doc_id")).alias("doc_id"), "text")).alias("value")
    )
    stray.write.text(f"{landed}/stray")
    ingest.ingest_drive(store, "job", folders.unionByName(items), _ROOT, landed, _run())
    state = catalog.job_status(spark.read.parquet(store.path("jobs"))).select("request_id", F.col("status").alias("job"))
    return _ingested_documents(store).withColumn("request_id", F.lit("job")).join(state, "request_id").drop("request_id")


@query
def rebuild_index(spark, folder):
    """All documents of an ingested folder embedded again with another model."""
    store = Store(spark, scratch_path(spark, "store"))
    ingest.ingest_directory(store, _landed_documents(spark, folder), _run())
    outcome = maintenance.rebuild(store, "acme", factory=_hashing(32), model="hashing-32")
    size = F.size("embedding")
    chunks = store.current("chunks").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min(size).alias("low"), F.max(size).alias("high")
    )
    index = store.current("vectors").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("vectors"), F.min(size).alias("index_low"), F.max(size).alias("index_high")
    )
    status = catalog.rebuild_status(outcome).select(F.lit("acme").alias("client_id"), "status", "skipped", "errors")
    sized = [F.col(c) == 32 for c in ("low", "high", "index_low", "index_high")]
    return chunks.join(index, "client_id").join(status, "client_id").select(
        "client_id", "status", "skipped", "errors", (F.col("chunks") == F.col("vectors")).alias("all_chunks"),
        (sized[0] & sized[1] & sized[2] & sized[3]).alias("all_new"),
    )


@query
def stream_ingest(spark, folder):
    """The same folder as a stream of micro-batches."""
    store = Store(spark, scratch_path(spark, "store"))
    landed = _landed_documents(spark, folder)
    stream = stream_folder(store, landed, scratch_path(spark, "stream"), _run(), files_per_batch=1000)
    stream.awaitTermination()
    return _ingested_documents(store)


@query
def stream_rewritten(spark, folder):
    """A stream of file versions: one file is rewritten between two triggers. What is current, and how often each was read."""
    store = Store(spark, scratch_path(spark, "store"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    root, checkpoint = _named_files(spark, docs), scratch_path(spark, "stream")
    stream_changes(store, root, checkpoint, _run()).awaitTermination()
    part = docs.filter(F.pmod("doc_id", F.lit(_BUCKETS)) == 1)
    fresh = _named_files(spark, part.select("doc_id", F.concat(F.lit("new "), "text").alias("text")))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}/part1.txt"), False)
    fs.rename(path(f"{fresh}/part1.txt"), path(f"{root}/part1.txt"))
    stream_changes(store, root, checkpoint, _run()).awaitTermination()
    read = store.read("documents").groupBy("rel_path").agg(F.count("*").alias("versions"))
    versions = read.select(F.regexp_extract("rel_path", r"part(\d+)", 1).cast("int").alias("b"), "versions")
    found = _ingested_documents(store).withColumn("b", F.pmod("doc_id", F.lit(_BUCKETS)).cast("int"))
    return found.join(versions, "b").drop("b")


@query
def ingest_long(spark, folder):
    """Documents as lines of a few files, all read in splits as if too long to be read whole."""
    store = Store(spark, scratch_path(spark, "store"))
    root = _named_files(spark, table(spark, folder, "documents"))
    ingest.ingest_directory(store, root, replace(_run(), split_above=1000))
    return _ingested_documents(store)
