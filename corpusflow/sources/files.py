"""Folders and files as DataFrames."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.paths import extension, file_name, path_parts
from corpusflow.functions.text import strip
from corpusflow.sources.tree import list_tree, open_files, passed_over

# Extensions read from folders, by kind.
DOCUMENTS = ("pdf", "docx", "doc", "txt", "rtf", "odt")
SPREADSHEETS = ("xlsx", "xls", "ods", "csv", "tsv")
PRESENTATIONS = ("pptx", "ppt")
MARKUP = ("html", "htm", "xml", "md", "markdown", "rst")
DATA = ("json", "jsonl", "yaml", "yml", "toml")
CODE = (
    "py", "js", "ts", "jsx", "tsx", "java", "cpp", "c", "h", "cs", "go", "rb", "php", "swift", "kt", "r", "sql",
    "sh", "bash", "ps1",
)
FOLDER_EXTENSIONS = (*DOCUMENTS, *SPREADSHEETS, *PRESENTATIONS, *MARKUP, *DATA, *CODE, "epub", "eml")

# Extensions accepted from uploads and remote folders, and the upload limit.
UPLOAD_EXTENSIONS = ("pdf", "pptx", "txt", "docx", "xlsx", "xls", "csv", "json", "html", "xml", "md", "rtf")
MAX_UPLOAD_MB = 50

FILE_COLUMNS = ("path", "rel_path", "source_file", "ext", "length", "modified")


def any_case_glob(extensions: Iterable[str]) -> str:
    """A glob for the extensions in any case, so that the listing itself leaves other files out."""

    def letters(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*.{" + ",".join(letters(e) for e in extensions) + "}"


def locate(spark: SparkSession, root: str) -> tuple[str, bool, bool]:
    """The qualified form of ``root``, whether it exists, and whether it is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(path)
    exists = fs.exists(full)
    return full.toString(), exists, exists and fs.getFileStatus(full).isDirectory()


def supported(name: Column, extensions: Iterable[str] = FOLDER_EXTENSIONS) -> Column:
    return extension(name).isin(*extensions)


def file_reader(reader, extensions: Iterable[str] = FOLDER_EXTENSIONS):
    """``binaryFile`` options shared by batch and streaming reads."""
    return (
        reader.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case_glob(extensions))
    )


def describe_files(files: DataFrame, root: str) -> DataFrame:
    """Adds path facts to ``binaryFile`` rows. ``root`` is the qualified folder the files lie under."""
    base = root.rstrip("/") + "/"
    rel = F.substr(F.col("path"), F.lit(len(base) + 1))
    kept = ["content"] if "content" in files.columns else []
    return files.select(
        "path",
        rel.alias("rel_path"),
        file_name(rel).alias("source_file"),
        extension(file_name(rel)).alias("ext"),
        "length",
        F.col("modificationTime").alias("modified"),
        *kept,
    )


def read_files(spark: SparkSession, root: str, extensions: Iterable[str] = FOLDER_EXTENSIONS) -> DataFrame:
    """Files below ``root`` with their bytes: by Spark's own source, and those that it passes over by name.

    One of the latter that no row can hold has no content.
    """
    full, exists, is_folder = locate(spark, root)
    if not is_folder:
        raise ValueError(f"Invalid directory path: {root}")
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    shown = describe_files(file_reader(spark.read, extensions).load(full), full)
    others = list_files(spark, root, extensions).filter(passed_over(F.col("rel_path"), F.col("length")))
    return shown.unionByName(open_files(others, full, most))


def list_files(spark: SparkSession, root: str, extensions: Iterable[str] = FOLDER_EXTENSIONS) -> DataFrame:
    """All files below ``root`` with these extensions, as ``read_files`` shows them but for their bytes; none is opened."""
    full, _, is_folder = locate(spark, root)
    if not is_folder:
        raise ValueError(f"Invalid directory path: {root}")
    return describe_tree(list_tree(spark, full), full, extensions)


def describe_tree(listed: DataFrame, root: str, extensions: Iterable[str]) -> DataFrame:
    """Path facts of a listing of the folder ``root``."""
    rel = F.col("rel_path")
    rows = listed.select(
        F.concat(F.lit(root.rstrip("/") + "/"), rel).alias("path"), rel, file_name(rel).alias("source_file"),
        extension(file_name(rel)).alias("ext"), "length", "modified",
    )
    return rows.filter(F.col("ext").isin(*extensions))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, as ``read_files`` would show it below its own folder."""
    full, exists, is_folder = locate(spark, path)
    if not exists or is_folder:
        raise ValueError(f"File not found: {path}")
    files = spark.read.format("binaryFile").load(full)
    return describe_files(files, full.rsplit("/", 1)[0])


def size_kb(length: Column) -> Column:
    """Kilobytes with two decimals, ties rounded to even."""
    return F.bround(length / 1024, 2)


def describe_listing(files: DataFrame) -> DataFrame:
    """Listing rows (file name, type, size, subfolder) of files with ``rel_path`` and ``length``, in path order."""
    name = file_name(F.col("rel_path"))
    folder = F.substr(F.col("rel_path"), F.lit(1), F.length("rel_path") - F.length(name) - 1)
    return (
        files.filter(supported(name))
        .orderBy(path_parts(F.col("rel_path")))
        .select(
            name.alias("filename"),
            extension(name).alias("file_type"),
            size_kb(F.col("length")).alias("size_kb"),
            folder.alias("subfolder"),
        )
    )


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """The supported files below ``root``, without reading them; no rows for a folder that does not exist."""
    _, _, is_folder = locate(spark, root)
    if not is_folder:
        return spark.createDataFrame([], "filename string, file_type string, size_kb double, subfolder string")
    return describe_listing(list_files(spark, root))


def upload_gate(
    uploads: DataFrame,
    client_id: str = "client_id",
    name: str = "filename",
    size: str = "size_bytes",
    limit_mb: int = MAX_UPLOAD_MB,
) -> DataFrame:
    """Adds ``accepted``, ``reject_code`` and ``reject_reason``: blank client, wrong type, too large, in this order."""
    kind = extension(F.col(name))
    dotted = F.when(kind == "", "").otherwise(F.concat(F.lit("."), kind))
    megabytes = F.format_string("%.1f", F.bround(F.col(size) / 1024 / 1024, 1))
    code = (
        F.when(F.coalesce(strip(F.col(client_id)), F.lit("")) == "", 400)
        .when(~supported(F.col(name), UPLOAD_EXTENSIONS), 415)
        .when(F.col(size) > limit_mb * 1024 * 1024, 413)
    )
    reason = (
        F.when(F.col("reject_code") == 400, "client_id is required")
        .when(F.col("reject_code") == 415, F.concat(F.lit("Unsupported file type '"), dotted, F.lit("'")))
        .when(
            F.col("reject_code") == 413,
            F.concat(F.lit("File size "), megabytes, F.lit(f" MB exceeds limit of {limit_mb} MB.")),
        )
    )
    return (
        uploads.withColumn("reject_code", code)
        .withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_code").isNull())
    )


def check_requests(
    requests: DataFrame, client_id: str = "client_id", place: str = "place", kind: str = "kind"
) -> DataFrame:
    """Adds the normalised ``client_key`` and ``place_key`` and the ``problem`` of an ingestion request, if any.

    ``kind`` is ``directory``, ``drive`` or ``sharepoint``; ``place`` is the folder, folder id or site URL.
    """
    client = F.lower(strip(F.coalesce(F.col(client_id), F.lit(""))))
    where = strip(F.coalesce(F.col(place), F.lit("")))
    problem = (
        F.when(client == "", "client_id must not be empty")
        .when((F.col(kind) == "directory") & (where == ""), "directory_path must not be empty")
        .when((F.col(kind) == "drive") & (where == ""), "folder_id must not be empty")
        .when(
            (F.col(kind) == "sharepoint") & ~F.contains(F.lower(where), F.lit("sharepoint.com")),
            "site_url must be a valid SharePoint URL",
        )
    )
    return requests.select(
        "*", client.alias("client_key"), where.alias("place_key"), problem.alias("problem")
    )


def not_loaded(listing: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Listed files that gave no document."""
    return listing.join(documents.select(*keys), keys, "left_anti")
