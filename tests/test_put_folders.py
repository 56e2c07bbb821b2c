"""What putting objects does to the folders that tasks share."""

from __future__ import annotations

import errno
import os

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from corpusflow.sources import objects, tree


class Local(fs.LocalFileSystem):
    """A local file system that notes what it is asked to make."""

    def __init__(self):
        super().__init__()
        self.asked = []

    def create_dir(self, path, **options):
        self.asked.append(("create_dir", path))
        super().create_dir(path, **options)

    def open_output_stream(self, path, **options):
        self.asked.append(("open_output_stream", path))
        return super().open_output_stream(path, **options)


class Store:
    """The same, taken for an object store."""

    def __init__(self):
        self.local, self.asked = fs.LocalFileSystem(), []

    def __getattr__(self, call):
        def ask(path, *args, **options):
            if call in ("create_dir", "open_output_stream"):
                self.asked.append((call, path))
            return getattr(self.local, call)(path, *args, **options)

        return ask


class Rows:
    """Stands for the rows of one task: what is to be done with them is handed back."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture(params=[Local, Store])
def put(tmp_path, monkeypatch, request):
    system = request.param()
    monkeypatch.setattr(tree, "file_system", lambda root: (system, str(tmp_path)))

    def run(names, batches=1, text="", overwrite=True):
        batch = pa.RecordBatch.from_pydict({"name": names, "content": [f"{text}{n}".encode() for n in names]})
        done = list(tree.write_files(Rows(), str(tmp_path), overwrite=overwrite)([batch] * batches))
        return [e for b in done for e in b.column("error").to_pylist()], system.asked

    return run


def stored(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_a_folder_changes_once_for_each_object(tmp_path, put):
    names = [f"raw/en/{i}" for i in range(50)]
    errors, asked = put(names, batches=2)
    assert errors == [None] * 100 and stored(tmp_path) == {n: n for n in names}
    assert put(names, text="new ")[0] == [None] * 50 and stored(tmp_path) == {n: f"new {n}" for n in names}
    assert put(names, text="newer ", overwrite=False)[0] == [tree.EXISTS] * 50 and stored(tmp_path) == {n: f"new {n}" for n in names}
    touched = [call for call, path in asked if f"{path}/".startswith(f"{tmp_path}/raw/")]
    assert touched == ["create_dir"]  # not once for each object, and no temporary names
    assert [p.name for p in tmp_path.iterdir()] == ["raw"]


def test_a_folder_that_cannot_be_linked_to(tmp_path, put, monkeypatch):
    """Such as one on another device."""

    def link(source, target, *, given=os.link):
        if "/far" in target:
            raise OSError(errno.EXDEV, "another device")
        given(source, target)

    monkeypatch.setattr(os, "link", link)
    names = ["far/a", "near/b", "far/c"]
    for text in ("", "new "):
        errors, _ = put([*names, "../up", None], text=text)
        assert errors == [None, None, None, tree.BAD_KEY, tree.BAD_KEY] and stored(tmp_path) == {n: text + n for n in names}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["far", "near"]


@pytest.mark.parametrize("name", ["file/below", "folder"])
def test_a_put_that_fails_leaves_nothing(tmp_path, put, name):
    (tmp_path / "file").write_bytes(b"")
    (tmp_path / "folder").mkdir()
    with pytest.raises(OSError):
        put(["a", name])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == ["a", "file", "folder"]


def test_taken_names_are_found_without_opening(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_bytes(b"")
    (tmp_path / "a/shut").write_bytes(b"s")
    (tmp_path / "a/shut").chmod(0)
    names = ["a/x", "a/shut", "a", "none", "a/x/y", "../x", "", None]
    keys = spark.createDataFrame([(n,) for n in names], "name string").repartition(2)
    assert {r.name for r in tree.present_files(keys, str(tmp_path), "name").collect()} == {"a/x", "a/shut"}
    incoming = keys.filter("name like 'a/%' and name <> 'a/x/y'").withColumn("content", F.lit(b"new"))
    done = objects.write_objects(incoming, str(tmp_path), overwrite=False).collect()
    assert sorted((r.blob_name, r.error) for r in done) == [("a/shut", tree.EXISTS), ("a/x", tree.EXISTS)]
