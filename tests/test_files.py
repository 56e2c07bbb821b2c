"""Folders, extraction jobs and object listings on real files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import paths, text
from corpusflow.sources import extract, files, objects, sample_files, tree
from corpusflow.sources.formats import Page


@pytest.fixture
def folder(tmp_path):
    contents = {
        "a.txt": b"x" * 128,
        "a/b.txt": "caf\xe9 latin".encode("latin-1"),
        "a/Main.PY": b"print(1)\r\n",
        "a/c/notes.md": b"# t \xff",
        "a/c/e.txt": b" \n ",
        "data set.JSON": b'{"a":1}',
        "w.docx": sample_files.docx(["hello"]),
        "bad.xlsx": b"no zip",
        "x.bin": b"zz",
        "noext": b"zz",
        "_hidden.txt": b"zz",
        ".cache/x=1/_y.md": b"deep and hidden",
        "empty.txt": b"",
        "u.txt": "\U0001f600 wide".encode("utf-16"),
        "old.ppt": b"zz",
    }
    for name, content in contents.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "root")


def test_scan_lists_in_path_order_without_content(spark, folder):
    scanned = files.scan_directory(spark, folder)
    rows = [tuple(r) for r in scanned.collect()]
    assert [(r[3], r[0]) for r in rows] == [
        (".cache/x=1", "_y.md"),
        ("", "_hidden.txt"),
        ("a", "Main.PY"),
        ("a", "b.txt"),
        ("a/c", "e.txt"),
        ("a/c", "notes.md"),
        ("", "a.txt"),
        ("", "bad.xlsx"),
        ("", "data set.JSON"),
        ("", "empty.txt"),
        ("", "old.ppt"),
        ("", "u.txt"),
        ("", "w.docx"),
    ]
    assert rows[2][1] == "py" and rows[6][2] == 0.12 and rows[9][2] == 0
    assert "content" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_missing_folder(spark, tmp_path):
    assert files.scan_directory(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.read_file(spark, str(tmp_path))


def test_extraction_and_errors(spark, folder):
    found = extract.extract_folder(spark, folder).cache()
    docs = {r.rel_path: r for r in extract.to_documents(found).collect()}
    texts = {k: r.pages[0].text for k, r in docs.items()}
    assert texts == {
        "a.txt": "x" * 128,
        "a/b.txt": "café latin",
        "a/Main.PY": "# Language: PY\n\nprint(1)",
        "a/c/notes.md": "# t \ufffd",
        "data set.JSON": '{\n  "a": 1\n}',
        "w.docx": "hello",
        "u.txt": "\U0001f600 wide",
        "_hidden.txt": "zz",
        ".cache/x=1/_y.md": "deep and hidden",
    }
    assert docs["data set.JSON"].doc_id == "data_set" and docs["w.docx"].total_pages == 1
    errors = {r.path.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in extract.to_errors(found).collect()}
    assert errors == {"e.txt": "no text", "empty.txt": "no text", "bad.xlsx": "BadZipFile", "old.ppt": "MissingReader"}
    missing = files.not_loaded(files.list_files(spark, folder), extract.to_documents(found), ["rel_path"])
    assert {r.rel_path for r in missing.collect()} == {"a/c/e.txt", "bad.xlsx", "old.ppt", "empty.txt"}


def test_readers_can_be_added_and_replaced(spark, folder):
    readers = {"bin": lambda content, name: [Page(1, "bin!")], "txt": lambda content, name: [Page(2, name)]}
    found = {r.rel_path: r.pages for r in extract.extract_folder(spark, folder, readers).collect()}
    assert found["x.bin"][0].text == "bin!" and found["a/b.txt"][0].page == 2 and found["a/b.txt"][0].text == "b.txt"


def test_single_file(spark, folder):
    row = extract.extract(files.read_file(spark, f"{folder}/a/b.txt")).first()
    assert row.rel_path == "b.txt" and row.pages[0].text == "café latin"


def test_objects(spark, folder):
    listed = {r.name: r for r in objects.list_objects(spark, folder, "a/").collect()}
    assert set(listed) == {"a/b.txt", "a/Main.PY", "a/c/notes.md", "a/c/e.txt"}
    assert listed["a/c/notes.md"].content_type == "text/markdown" and listed["a/b.txt"].size_bytes == 10
    assert listed["a/b.txt"].last_modified.endswith("+00:00")
    asked = [(k,) for k in ("a.txt", "none", "a", "a.txt/x", "../root/a.txt", "_hidden.txt", "empty.txt", None, "")]
    read = objects.read_objects(spark.createDataFrame(asked, "name string"), folder).collect()
    assert {(r.name, len(r.content)) for r in read} == {("a.txt", 128), ("_hidden.txt", 2), ("empty.txt", 0)}
    keys = spark.createDataFrame([("a.txt",), ("none",)], "name string")
    flags = objects.which_exist(keys, objects.list_objects(spark, folder)).collect()
    assert {r.name: r.exists for r in flags} == {"a.txt": True, "none": False}


def test_listing_shares_out_folders_and_misses_none(spark, tmp_path):
    wanted = set()
    for i in range(300):
        name = "/".join([f"d{i % 7}", f"_e{i % 5}", f".f{i % 3}"][: i % 4] + [f"{'.' * (i % 2)}n{i}.txt"])
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (i % 3))
        wanted.add((name, i % 3))
    (tmp_path / "no files").mkdir()
    for folders in (1, 4, 1000):
        tree.list_tree(spark, str(tmp_path))
        listed = spark.read.format(tree.FORMAT).option("folders", folders).load(str(tmp_path))
        rows = listed.collect()
        assert {(r.rel_path, r.length) for r in rows} == wanted and len(rows) == 300
    assert listed.rdd.getNumPartitions() > 20
    assert {r.rel_path for r in files.read_files(spark, str(tmp_path)).collect()} == {n for n, _ in wanted}


def test_objects_are_put_whole_and_taken_names_kept(spark, tmp_path):
    root = tmp_path / "bucket"
    root.mkdir()
    rows = [("a/1", b"one"), ("a/2", None), ("b", b"x" * 100_000), ("../up", b"no"), ("", b"no"), (None, b"no"), ("/abs", b"no"), ("a//3", b"no")]
    incoming = spark.createDataFrame([(n, c and bytearray(c)) for n, c in rows], "name string, content binary").repartition(3)

    def put(df, overwrite):
        return sorted(((r.blob_name or "", r.success, r.error) for r in objects.write_objects(df, str(root), overwrite).collect()))

    def stored():
        return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}

    bad = [(n, False, tree.BAD_KEY) for n in ("", "", "../up", "/abs", "a//3")]
    assert put(incoming, False) == sorted([*bad, ("a/1", True, None), ("a/2", True, None), ("b", True, None)])
    assert stored() == {"a/1": b"one", "a/2": b"", "b": b"x" * 100_000}
    later = spark.createDataFrame([("a/1", bytearray(b"uno")), ("c", bytearray(b"3"))], "name string, content binary")
    assert put(later, False) == [("a/1", False, tree.EXISTS), ("c", True, None)]
    assert stored()["a/1"] == b"one"
    assert put(later, True) == [("a/1", True, None), ("c", True, None)]
    assert stored() == {"a/1": b"uno", "a/2": b"", "b": b"x" * 100_000, "c": b"3"}


def test_a_repeated_put_gives_the_same_answer(tmp_path):
    """A task that is run again meets its own object; another writer's is kept."""
    system, path = tree.file_system(str(tmp_path))
    for _ in range(2):
        assert tree.write_file(system, path, "k/x", b"mine", overwrite=False) is None
    assert tree.write_file(system, path, "k/x", b"other", overwrite=False) == tree.EXISTS
    assert (tmp_path / "k/x").read_bytes() == b"mine" and len(list(tmp_path.rglob("*"))) == 2


def test_path_functions(spark):
    names = ["a.tar.gz", ".bashrc", "a.", "noext", "x/y.TXT", "..a", "x/"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(
        "p", paths.suffix(paths.file_name(F.col("p"))).alias("suffix"), paths.stem(paths.file_name(F.col("p"))).alias("stem")
    )
    from pathlib import PurePosixPath

    for r in rows.collect():
        expected = PurePosixPath(r.p)
        if not r.p.endswith("."):
            assert (r.suffix, r.stem) == (expected.suffix, expected.stem), r.p
    assert {r.p: (r.suffix, r.stem) for r in rows.collect()}["a."] == ("", "a.")


def test_strip_equals_python(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2028\u2029\u202f\u205f\u3000"
    values = [blanks + "a b" + blanks, blanks, "\u200bx\u200b", "", "\x00a"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.strip(F.col("v")).alias("s"))
    assert all(r.s == r.v.strip() for r in rows.collect())


def test_upload_gate_rounds_half_even(spark):
    rows = [("c", "a.pdf", 50 * 1024 * 1024), ("c", "a.pdf", 52690944), ("c", "a.pdf", 50 * 1024 * 1024 + 262144), (None, "a.exe", 1), ("c", ".pdf", 1)]
    got = files.upload_gate(spark.createDataFrame(rows, "client_id string, filename string, size_bytes long")).collect()
    assert [r.reject_code for r in got] == [None, 413, 413, 400, 415]
    assert got[1].reject_reason == f"File size {52690944 / 1024 / 1024:.1f} MB exceeds limit of 50 MB."
    assert got[2].reject_reason.startswith(f"File size {50.25:.1f} MB")
