"""Stored objects: listing, reading, writing and existence by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.paths import content_type
from corpusflow.functions.text import utc_iso
from corpusflow.session import scratch_path, ship_package
from corpusflow.sources.files import locate
from corpusflow.sources.tree import EXISTS, UNFINISHED, list_tree, open_files, present_files, write_files


def describe_objects(objects: DataFrame) -> DataFrame:
    """Listing entries of rows with ``name``, ``size_bytes`` and ``modified``."""
    return objects.select(
        "name",
        "size_bytes",
        utc_iso(F.date_trunc("second", "modified")).alias("last_modified"),
        content_type(F.col("name")).alias("content_type"),
    )


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects below ``root`` whose key starts with ``prefix``; their bytes are not read."""
    full, _, is_folder = locate(spark, root)
    if not is_folder:
        raise ValueError(f"Invalid directory path: {root}")
    named = list_tree(spark, full).select(
        F.col("rel_path").alias("name"), F.col("length").alias("size_bytes"), "modified"
    ).filter(~F.endswith("name", F.lit(UNFINISHED)))
    return describe_objects(with_prefix(named, prefix))


def with_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.filter(F.startswith(F.col("name"), F.lit(prefix)))


def read_objects(keys: DataFrame, root: str) -> DataFrame:
    """The rows of ``keys`` (column ``name``) with the bytes of the object of that name; a missing one gives no row.

    Objects are opened where their rows are.
    """
    ship_package(keys.sparkSession)
    full, _, _ = locate(keys.sparkSession, root)
    return open_files(keys, full, name="name").filter(F.col("content").isNotNull())


def write_objects(incoming: DataFrame, root: str, overwrite: bool = True) -> DataFrame:
    """Puts the ``content`` of each row of ``incoming`` at its ``name`` below ``root``; ``success, blob_name, error`` per row.

    Objects are written where their rows are, under temporary names first. Without ``overwrite`` one whose name is taken stays
    as it was, and the result is an error. What is taken is settled before anything is written, so that a task that
    is run again gives the same answer; another writer's object put meanwhile is kept too. Names are unique.
    """
    spark = incoming.sparkSession
    ship_package(spark)
    full, _, _ = locate(spark, root)
    results, path = [], scratch_path(spark, "put")
    if not overwrite:
        before = scratch_path(spark, "present")
        present_files(incoming.select("name"), full, "name").write.parquet(before)
        present = spark.read.parquet(before)
        incoming, taken = (incoming.join(present, "name", kind) for kind in ("left_anti", "left_semi"))
        results.append(taken.select(F.lit(False).alias("success"), F.col("name").alias("blob_name"), F.lit(EXISTS).alias("error")))
    write_files(incoming, full, "name", overwrite).write.parquet(path)
    done = spark.read.schema("success boolean, blob_name string, error string").parquet(path)
    for more in results:
        done = done.unionByName(more)
    return done


def which_exist(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of ``keys`` (column ``name``) with an ``exists`` flag."""
    present = objects.select("name").distinct().withColumn("exists", F.lit(True))
    return keys.join(present, "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def put_objects(stored: DataFrame, incoming: DataFrame, overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """What is stored once ``incoming`` (the same columns, names unique) is put, and a result per incoming object.

    Without ``overwrite`` an object whose name is taken stays as it was, and its result is an error.
    """
    if overwrite:
        kept, taken = stored.join(incoming.select("name"), "name", "left_anti"), incoming
    else:
        kept, taken = stored, incoming.join(stored.select("name"), "name", "left_anti")
    after = kept.select(*stored.columns).unionByName(taken.select(*stored.columns))
    done = F.lit(True) if overwrite else ~F.col("exists")
    results = which_exist(incoming.select("name"), stored).select(
        done.alias("success"),
        F.col("name").alias("blob_name"),
        F.when(~done, EXISTS).alias("error"),
    )
    return after, results
