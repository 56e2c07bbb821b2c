"""Download plans for remote folders, from listings given as tables.

A listing has one row per item: ``id``, ``parent_id``, ``name`` and what kind of item it is. Folders are resolved to
paths first, on the folder rows alone; files then meet the folder table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.paths import safe_name, stem, suffix
from corpusflow.functions.text import strip
from corpusflow.session import truncate_lineage
from corpusflow.sources.files import UPLOAD_EXTENSIONS

# Remote content types.
FOLDER_MIME = "application/vnd.google-apps.folder"
NATIVE_MIME_EXTENSION = {
    "application/json": ".json",
    "application/pdf": ".pdf",
    "application/rtf": ".rtf",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "text/csv": ".csv",
    "text/html": ".html",
    "text/markdown": ".md",
    "text/plain": ".txt",
    "text/rtf": ".rtf",
}
EXPORT_MIME = {
    "application/vnd.google-apps.document": (
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        ".docx",
    ),
    "application/vnd.google-apps.presentation": (
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        ".pptx",
    ),
    "application/vnd.google-apps.spreadsheet": (
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        ".xlsx",
    ),
}
LIBRARY_NAMES = ("documents", "shared documents")

_ACCEPTED = [f".{e}" for e in UPLOAD_EXTENSIONS]


# Folders are rarely nested deeper. Beyond it, what runs in circles is left out before its paths grow further.
_DEEP = 64


def _ending_at(folders: DataFrame, root: str, limit: int) -> DataFrame:
    """``id`` of the folders from which parents lead to ``root``, without their paths."""
    climbing = folders.filter(F.col("id") != root).select("id", F.col("parent_id").alias("top"))
    reach = 1
    while reach <= limit:
        above = climbing.select(F.col("id").alias("top"), F.col("top").alias("next_top"))
        climbing = truncate_lineage(
            climbing.join(above, "top", "left").select("id", F.coalesce("next_top", "top").alias("top"))
        )
        reach *= 2
    return climbing.filter(F.col("top") == root).select("id")


def folder_paths(folders: DataFrame, root: str) -> DataFrame:
    """``id`` and ``path`` (names joined by ``/``) of ``root`` and every folder below it.

    Each folder knows its parent; joining that table to itself doubles the reach of every row, so depth d takes
    log2(d) rounds. A round ends when no row can climb further. Rows that end elsewhere, or run in a circle, are
    not below the root.
    """
    spark = folders.sparkSession
    climbing = truncate_lineage(
        folders.filter(F.col("id") != root).select("id", F.col("parent_id").alias("top"), F.col("name").alias("path"))
    )
    limit = climbing.count()
    reach = 1
    while reach <= limit:
        above = climbing.select(
            F.col("id").alias("top"), F.col("top").alias("next_top"), F.col("path").alias("upper")
        )
        climbing = truncate_lineage(
            climbing.join(above, "top", "left").select(
                "id",
                F.coalesce("next_top", "top").alias("top"),
                F.when(F.col("upper").isNull(), F.col("path"))
                .otherwise(F.concat("upper", F.lit("/"), "path"))
                .alias("path"),
                F.col("upper").isNotNull().alias("climbed"),
            )
        )
        reach *= 2
        if climbing.filter("climbed").isEmpty():
            break
        climbing = climbing.drop("climbed")
        if reach == _DEEP:
            climbing = truncate_lineage(climbing.join(_ending_at(folders, root, limit), "id", "left_semi"))
    start = spark.createDataFrame([(root, "")], "id string, path string")
    return start.unionByName(climbing.filter(F.col("top") == root).select("id", "path"))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _target(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def plan_drive(items: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """What to do with each file of a drive listing (``id, parent_id, name, mime``) below ``root``.

    Adds ``action`` (``export``, ``download`` or ``skip``), ``export_mime`` and ``target``, the path to save under.
    A download whose name lacks the planned extension gets it appended.
    """
    is_folder = F.col("mime").eqNullSafe(FOLDER_MIME)
    files = items.filter(~is_folder)
    if recursive:
        named = items.filter(is_folder).withColumn("name", safe_name(F.col("name")))
        places = folder_paths(named, root).select(F.col("id").alias("parent_id"), F.col("path").alias("_folder"))
        placed = files.join(places, "parent_id")
    else:
        placed = files.filter(F.col("parent_id") == root).withColumn("_folder", F.lit(""))
    own = F.lower(suffix(F.col("name")))
    export_mime = _lookup({m: target for m, (target, _) in EXPORT_MIME.items()}, F.col("mime"))
    export_ext = _lookup({m: ext for m, (_, ext) in EXPORT_MIME.items()}, F.col("mime"))
    planned = F.coalesce(_lookup(NATIVE_MIME_EXTENSION, F.col("mime")), own)
    action = (
        F.when(export_mime.isNotNull(), "export").when(planned.isin(_ACCEPTED), "download").otherwise("skip")
    )
    saved = (
        F.when(F.col("action") == "export", F.concat(safe_name(stem(F.col("name"))), export_ext))
        .when((F.col("action") == "download") & own.isin(_ACCEPTED), safe_name(F.col("name")))
        .when(F.col("action") == "download", F.concat(safe_name(F.col("name")), planned))
    )
    return (
        placed.withColumn("action", action)
        .withColumn("export_mime", export_mime)
        .withColumn("target", _target(F.col("_folder"), saved))
        .drop("_folder")
    )


def library_folder(path: Column) -> Column:
    """A library path without outer slashes and without the leading library name."""
    bare = F.btrim(path, F.lit("/"))
    return F.when(F.lower(bare) == "shared documents", "").otherwise(
        F.regexp_replace(bare, "(?i)^shared documents/", "")
    )


def site_name(url: Column) -> Column:
    """The last part of a site URL's path."""
    path = F.regexp_extract(url, r"^[^/:]+://[^/?#]*([^?#]*)", 1)
    return F.substring_index(F.btrim(path, F.lit("/")), "/", -1)


def _first(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row per key by an aggregate, which combines before the shuffle."""
    ranked = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns)).alias("_best")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def choose_site(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Per request (``request_id, site_url``), the first site whose name contains the requested one.

    ``sites`` holds the search results of each request: ``request_id, position, site_id, name``.
    """
    wanted = requests.withColumn("site_name", site_name(F.col("site_url")))
    found = wanted.join(sites, "request_id").filter(
        F.contains(F.lower(F.col("name")), F.lower(F.col("site_name")))
    )
    best = _first(found, ["request_id"], [F.col("position")], ["site_id"])
    return wanted.join(best, "request_id", "left")


def choose_drive(drives: DataFrame) -> DataFrame:
    """Per site, the first drive with a document library's name, else its first drive (``site_id, position, drive_id, name``)."""
    other = (~F.lower(F.coalesce("name", F.lit(""))).isin(*LIBRARY_NAMES)).cast("int")
    return _first(drives, ["site_id"], [other, F.col("position")], ["drive_id"])


def plan_sharepoint(items: DataFrame, root: str) -> DataFrame:
    """The files to fetch from a library listing (``id, parent_id, name, is_folder, download_url``) below ``root``.

    Adds ``action`` (``download`` or ``skip``), ``reason`` of a skip, and ``target``.
    """
    named = items.filter("is_folder").withColumn("name", safe_name(F.col("name")))
    places = folder_paths(named, root).select(F.col("id").alias("parent_id"), F.col("path").alias("_folder"))
    own = F.lower(suffix(F.col("name")))
    reason = F.when(~own.isin(_ACCEPTED), "unsupported type").when(
        F.coalesce(strip(F.col("download_url")), F.lit("")) == "", "no download URL"
    )
    return (
        items.filter(~F.col("is_folder"))
        .join(places, "parent_id")
        .withColumn("reason", reason)
        .withColumn("action", F.when(reason.isNull(), "download").otherwise("skip"))
        .withColumn("target", F.when(reason.isNull(), _target(F.col("_folder"), safe_name(F.col("name")))))
        .drop("_folder")
    )
