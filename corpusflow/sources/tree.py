"""Folder trees as tables: a parallel listing, and files opened and written where their rows are.

Spark's file sources pass over names that begin with ``_`` or ``.`` and over empty files, and need the driver to list. The
listing here leaves nothing out, opens nothing, and runs in tasks: the driver walks down only until there are
folders enough to share out. Places are named as Spark names them; ``pyarrow`` reaches local folders and object stores.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from datetime import timezone
from hashlib import sha256
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusflow.session import ship_package

FORMAT = "folder_tree"
SCHEMA = "rel_path string, length long, modified timestamp"

# Folders that the driver looks for before it shares them out, and rows of a batch.
FOLDERS = 64
_ROWS = 8192
# Bytes read before a batch is sent on.
_FLUSH_BYTES = 32 << 20
# The ending of names that objects have while they are written.
UNFINISHED = ".unfinished"


def file_system(root: str):
    """The file system that holds ``root``, and the folder's path in it."""
    from pyarrow import fs

    place = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", root))
    system, path = fs.FileSystem.from_uri(place if "://" in place else f"file://{os.path.abspath(place)}")
    return system, path.rstrip("/")


def _entries(system, folder: str):
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return (
        [x for x in found if x.type == fs.FileType.File],
        [x.path for x in found if x.type == fs.FileType.Directory],
    )


class Folders(InputPartition):
    def __init__(self, given: list[tuple[str, bool]]):
        #: Paths, and whether what lies below them belongs to the partition too.
        self.given = given


class _Tree:
    def __init__(self, options):
        self.root = options["path"]
        self.wanted = int(options.get("folders", FOLDERS))

    def _partitions(self) -> list[Folders]:
        system, path = file_system(self.root)
        open_, passed = [path], []
        while open_ and len(open_) < self.wanted:
            passed += open_
            open_ = [x for folder in open_ for x in _entries(system, folder)[1]]
        shares: list[list] = [[] for _ in range(max(1, min(self.wanted, len(open_) + len(passed))))]
        for i, share in enumerate([*[(x, True) for x in open_], *[(x, False) for x in passed]]):
            shares[i % len(shares)].append(share)
        return [Folders(x) for x in shares]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, path = file_system(self.root)
        waiting, rows = list(partition.given), []
        while waiting:
            folder, deep = waiting.pop()
            files, below = _entries(system, folder)
            waiting += [(x, True) for x in below] if deep else []
            rows += [(x.path[len(path) + 1 :], x.size, x.mtime.astimezone(timezone.utc)) for x in files]
            while len(rows) >= _ROWS:
                yield _batch(rows[:_ROWS])
                rows = rows[_ROWS:]
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"))
    columns = [pa.array(v, t) for v, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["rel_path", "length", "modified"])


class TreeReader(_Tree, DataSourceReader):
    def partitions(self):
        return self._partitions()


class TreeStreamReader(_Tree, DataSourceStreamReader):
    """The whole tree at every trigger: what is new in it is for the stream to tell."""

    def initialOffset(self):
        return {"seen": 0}

    def latestOffset(self):
        return {"seen": time.time_ns()}

    def partitions(self, start, end):
        return self._partitions()

    def commit(self, end):
        pass


class FolderTree(DataSource):
    """``rel_path, length, modified`` of all files below the folder ``path``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def _registered(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FolderTree)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, length, modified`` of all files below ``root``, hidden and empty ones included; none is opened."""
    _registered(spark)
    return spark.read.format(FORMAT).load(root)


def stream_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same listing as a stream, whole at every trigger."""
    _registered(spark)
    return spark.readStream.format(FORMAT).load(root)


def passed_over(rel_path: Column, length: Column) -> Column:
    """Whether Spark's file sources leave a file out: a hidden name on its path, or no bytes."""

    def hidden(name: Column) -> Column:
        marked = (F.startswith(name, F.lit("_")) & ~F.contains(name, F.lit("="))) | F.startswith(name, F.lit("."))
        summary = F.startswith(name, F.lit("_metadata")) | F.startswith(name, F.lit("_common_metadata"))
        return (marked | F.endswith(name, F.lit("._COPYING_"))) & ~summary

    return F.exists(F.split(rel_path, "/"), hidden) | (length == 0)


def open_files(files: DataFrame, root: str, most: int = 2**31 - 1, name: str = "rel_path", start: int | None = None) -> DataFrame:
    """``files`` with the ``content`` of the file at ``root/<name>``, opened where the row is.

    Null where there is no such file, the name leads out of the folder, or the file has more than ``most`` bytes; of
    files to be read in part, the first ``start`` bytes.
    """
    schema = T.StructType([*files.schema, T.StructField("content", T.BinaryType())])

    def content(system, path: str, key: str | None) -> bytes | None:
        info = system.get_file_info(f"{path}/{key}") if valid_key(key) else None
        if info is None or not info.is_file or (info.size > most and start is None):
            return None
        try:
            with system.open_input_file(info.path) as stream:
                return stream.read(info.size if start is None else start)
        except FileNotFoundError:  # gone meanwhile
            return None

    def run(batches):
        system, path = file_system(root)
        for batch in batches:
            read, size, first = [], 0, 0
            for i, key in enumerate(batch.column(name).to_pylist()):
                read.append(content(system, path, key))
                size += len(read[-1] or b"")
                if size > _FLUSH_BYTES or i == batch.num_rows - 1:
                    columns = [batch.column(c).slice(first, len(read)) for c in batch.schema.names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(read, pa.binary())], names=schema.names)
                    read, size, first = [], 0, i + 1

    return files.mapInArrow(run, schema)


def present_files(files: DataFrame, root: str, name: str = "rel_path") -> DataFrame:
    """The rows of ``files`` with a file at ``root/<name>``; none is opened."""

    def run(batches):
        system, path = file_system(root)
        for batch in batches:
            keys = batch.column(name).to_pylist()
            found = iter(system.get_file_info([f"{path}/{key}" for key in keys if valid_key(key)]))
            yield batch.filter(pa.array([valid_key(key) and next(found).is_file for key in keys], pa.bool_()))

    return files.mapInArrow(run, files.schema)


def open_parts(files: DataFrame, root: str, part_bytes: int) -> DataFrame:
    """The bytes of ``files`` (``rel_path, length``) below ``root`` in pieces: a row per ``part``, from 0, with its ``content``.

    Pieces of one file are read by any number of tasks, which hold one piece at a time.
    """
    last = F.greatest(F.floor((F.col("length") - 1) / part_bytes), F.lit(0))
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = parts.repartition(files.sparkSession.sparkContext.defaultParallelism, "rel_path", "part")
    schema = T.StructType([*parts.schema, T.StructField("content", T.BinaryType())])

    def run(batches):
        system, path = file_system(root)
        for batch in batches:
            for i, (key, part) in enumerate(zip(batch.column("rel_path").to_pylist(), batch.column("part").to_pylist())):
                with system.open_input_file(f"{path}/{key}") as stream:
                    content = stream.read_at(part_bytes, part * part_bytes)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names=schema.names)

    return parts.mapInArrow(run, schema)


def file_sha256(files: DataFrame, root: str, step: int = 8 << 20) -> DataFrame:
    """``rel_path, sha256`` of ``files`` below ``root``, whose bytes a task reads piece by piece."""

    def run(batches):
        system, path = file_system(root)
        for batch in batches:
            digests = []
            for key in batch.column("rel_path").to_pylist():
                digest = sha256()
                with system.open_input_file(f"{path}/{key}") as stream:
                    while piece := stream.read(step):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(digests, pa.string())], names=["rel_path", "sha256"])

    return files.select("rel_path").repartition("rel_path").mapInArrow(run, "rel_path string, sha256 string")


def valid_key(key: str | None) -> bool:
    """Whether a key names a place below its root."""
    return bool(key) and not key.startswith("/") and all(p not in ("", ".", "..") for p in key.split("/"))


def write_file(system, path: str, key: str, content: bytes, overwrite: bool, staging: str | None = None) -> str | None:
    """Puts an object in its place at once, from a temporary name. The reason if it could not be put.

    Without ``overwrite`` a file that is there stays. One with the same bytes is taken for what an earlier attempt of the
    same task has put. Local folders create the name atomically; object stores are asked before.

    The temporary name lies in the folder ``staging``; beside the object where there is none, or it cannot serve, such as
    one on another device.
    """
    from pyarrow import fs

    target = f"{path}/{key}"
    folder = target.rsplit("/", 1)[0]
    if staging is None:
        system.create_dir(folder, recursive=True)
    temporary = f"{staging or folder}/.{uuid.uuid4().hex}{UNFINISHED}"
    with system.open_output_stream(temporary) as stream:
        stream.write(content)
    try:
        try:
            return _settle(system, temporary, target, content, overwrite)
        except FileNotFoundError:  # the first object of its folder
            system.create_dir(folder, recursive=True)
            return _settle(system, temporary, target, content, overwrite)
    except OSError:
        if staging is None:
            raise
        return write_file(system, path, key, content, overwrite)
    finally:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)


def _settle(system, temporary: str, target: str, content: bytes, overwrite: bool) -> str | None:
    from pyarrow import fs

    folder = target.rsplit("/", 1)[0]
    local = isinstance(system, fs.LocalFileSystem)
    if overwrite and (not local or temporary.rsplit("/", 1)[0] == folder):
        system.move(temporary, target)
        return None
    if local:
        try:
            os.link(temporary, target)
            return None
        except FileExistsError:
            if overwrite:
                _replace(temporary, target, f"{folder}/{temporary.rsplit('/', 1)[1]}")
                return None
    elif system.get_file_info(target).type == fs.FileType.NotFound:
        system.move(temporary, target)
        return None
    with system.open_input_file(target) as stream:
        same = stream.size() == len(content) and stream.read() == content
    return None if same else EXISTS


def _replace(temporary: str, target: str, beside: str) -> None:
    """A move within the folder of ``target``: one from another folder waits for every other such move on the device."""
    os.link(temporary, beside)
    try:
        os.replace(beside, target)
    except OSError:
        os.remove(beside)
        raise


# Fixed value: the answer for a name that is taken.
EXISTS = "The specified blob already exists."
BAD_KEY = "The name of the blob is not valid."


def write_files(files: DataFrame, root: str, name: str = "name", overwrite: bool = True) -> DataFrame:
    """Puts each row's ``content`` at ``root/<name>``, where the row is; ``success, blob_name, error`` per row.

    Lazy: every evaluation puts the objects again, so store the result. Names are unique. A null content is empty.

    A folder changes for one task at a time, and the slower the more it holds. So objects are written in a folder of the
    task's own, and their folders are only touched to put them there.
    """

    def run(batches):
        system, path = file_system(root)
        staging, made = f"{path}/.{uuid.uuid4().hex}{UNFINISHED}", False
        try:
            for batch in batches:
                keys = batch.column(name).to_pylist()
                if not made and any(map(valid_key, keys)):
                    system.create_dir(staging, recursive=True)
                    made = True
                errors = [
                    write_file(system, path, key, content.as_py() or b"", overwrite, staging) if valid_key(key) else BAD_KEY
                    for key, content in zip(keys, batch.column("content"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e is None for e in errors]), batch.column(name), pa.array(errors, pa.string())],
                    names=["success", "blob_name", "error"],
                )
        finally:
            if made:
                system.delete_dir(staging)

    return files.select(name, "content").mapInArrow(run, "success boolean, blob_name string, error string")
