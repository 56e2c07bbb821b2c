"""Remote listings: folder paths, download plans and the choice of site and drive."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.sources import manifest

ITEM = "id string, parent_id string, name string, mime string"
FOLDER = manifest.FOLDER_MIME


def test_deep_orphaned_and_circular_folders(spark):
    chain = [(f"f{i}", f"f{i - 1}" if i else "root", f"n{i}") for i in range(21)]
    odd = [("o", "nowhere", "orphan"), ("p", "o", "below"), ("x", "y", "x"), ("y", "x", "y")]
    folders = spark.createDataFrame(chain + odd, "id string, parent_id string, name string")
    got = {r.id: r.path for r in manifest.folder_paths(folders, "root").collect()}
    assert got == {"root": "", **{f"f{i}": "/".join(f"n{j}" for j in range(i + 1)) for i in range(21)}}


def test_drive_plan(spark):
    items = [
        ("a", "root", "A/B", FOLDER),
        ("b", "a", "deep", FOLDER),
        ("1", "root", "report", "application/pdf"),
        ("2", "b", "x:y.docx", "application/octet-stream"),
        ("3", "b", "Notes v1.2", "application/vnd.google-apps.document"),
        ("4", "b", "pic.png", "image/png"),
        ("5", "elsewhere", "z.txt", "text/plain"),
        ("6", "a", "data.CSV", "text/csv"),
        ("7", "a", "page.htm", "text/html"),
    ]
    df = spark.createDataFrame(items, ITEM)
    got = {r.id: (r.action, r.target) for r in manifest.plan_drive(df, "root").collect()}
    assert got == {
        "1": ("download", "report.pdf"),
        "2": ("download", "A_B/deep/x_y.docx"),
        "3": ("export", "A_B/deep/Notes v1.docx"),
        "4": ("skip", None),
        "6": ("download", "A_B/data.CSV"),
        "7": ("download", "A_B/page.htm.html"),
    }
    flat = manifest.plan_drive(df, "root", recursive=False).collect()
    assert [(r.id, r.target) for r in flat] == [("1", "report.pdf")]


def test_sharepoint_plan(spark):
    items = [
        ("a", "root", "HR", True, None),
        ("1", "a", "p.pdf", False, "u"),
        ("2", "a", "p.exe", False, "u"),
        ("3", "a", "q.txt", False, None),
    ]
    df = spark.createDataFrame(items, "id string, parent_id string, name string, is_folder boolean, download_url string")
    got = {r.id: (r.action, r.reason, r.target) for r in manifest.plan_sharepoint(df, "root").collect()}
    assert got == {
        "1": ("download", None, "HR/p.pdf"),
        "2": ("skip", "unsupported type", None),
        "3": ("skip", "no download URL", None),
    }


def test_site_and_drive(spark):
    requests = spark.createDataFrame(
        [(1, "https://c.sharepoint.com/sites/HR/?x=1"), (2, "https://c.sharepoint.com/sites/none")],
        "request_id int, site_url string",
    )
    sites = spark.createDataFrame(
        [(1, 0, "s0", "Finance"), (1, 1, "s1", "The hr team"), (1, 2, "s2", "HR"), (2, 0, "s3", "Other")],
        "request_id int, position int, site_id string, name string",
    )
    got = {r.request_id: (r.site_name, r.site_id) for r in manifest.choose_site(requests, sites).collect()}
    assert got == {1: ("HR", "s1"), 2: ("none", None)}
    drives = spark.createDataFrame(
        [("a", 0, "d0", "Photos"), ("a", 1, "d1", "DOCUMENTS"), ("b", 0, "d2", "Photos"), ("b", 1, "d3", None)],
        "site_id string, position int, drive_id string, name string",
    )
    assert {r.site_id: r.drive_id for r in manifest.choose_drive(drives).collect()} == {"a": "d1", "b": "d2"}


def test_library_folder(spark):
    values = {"/Shared Documents/Policies/": "Policies", "shared documents": "", "Policies": "Policies", "/": ""}
    rows = spark.createDataFrame([(v,) for v in values], "p string")
    got = {r.p: r.f for r in rows.select("p", manifest.library_folder(F.col("p")).alias("f")).collect()}
    assert got == values


def test_circles_of_folders_keep_short_paths(spark):
    circle = [(f"c{i}", f"c{(i + 1) % 150}", "n" * 100) for i in range(150)]
    chain = [("d0", "root", "d")] + [(f"d{i}", f"d{i - 1}", "d") for i in range(1, 100)]
    df = spark.createDataFrame(circle + chain, "id string, parent_id string, name string")
    found = {r.id: r.path for r in manifest.folder_paths(df, "root").collect()}
    assert set(found) == {"root", *(i for i, _, _ in chain)}
    assert found["d99"] == "/".join(["d"] * 100)


def test_items_without_type_are_planned(spark):
    items = spark.createDataFrame([("1", "root", "a.txt", None)], "id string, parent_id string, name string, mime string")
    assert [(r.name, r.action) for r in manifest.plan_drive(items, "root").collect()] == [("a.txt", "download")]
