import gzip
import hashlib
import os
import random

import pytest

from corpusflow.llm import warc
from corpusflow.llm.warc import parse_archive, read_archives, write_archives
from corpusflow.session import scratch_path

PAGE = "page_id long, url string, html string"


def test_round_trip_and_revisits(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(chr(rng.randrange(33, 1200)) for _ in range(n))
    long, big = "é" * 600, noise(400_000)
    rows = [(i, f"http://x/{i}", noise(rng.randrange(0, 3000))) for i in range(80)]
    rows += [(100 + i, "http://long", long) for i in range(5)] + [(200 + i, "s", "x" * 999) for i in range(3)]
    rows += [(300, None, None), (301, "u\r\nX: y z", ""), (2**60 + 1, "b", big), (2**60 + 3, "b", big), (90, "again", "dup"), (90, "again", "dup")]
    rows += [(None, "none", "no id"), (None, "none", long)]
    pages = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 as digest", "2 as shard", "3 as latest")
    seen = []
    for _ in range(2):
        path = scratch_path(spark, "warc-test")
        manifest = write_archives(pages, path, shards=4, limit=30_000)
        seen.append(sorted((r.archive, r.bytes, r.sha1) for r in manifest.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 6
    got = read_archives(spark, path).collect()
    payload = {}
    for i, _, h in rows:
        payload.setdefault(i, set()).add((h or "").encode())
    assert len(got) == len(rows)
    for r in got:
        assert r.payload_digest in {hashlib.sha1(p).hexdigest() for p in payload[r.page_id]}
        if r.record_type == "response":
            assert r.payload in payload[r.page_id] and len(r.payload) == r.payload_bytes
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {
        (100, 104), (101, 104), (102, 104), (103, 104), (None, 104), (2**60 + 1, 2**60 + 3),
    }
    folder = path.removeprefix("file:")
    names = sorted(n for n in os.listdir(folder) if n.endswith(".warc.gz"))
    assert names == [n for n, _, _ in seen[0]] and not any("temporary" in n for n in os.listdir(folder))
    ids = []
    for n in names:
        data = open(f"{folder}/{n}", "rb").read()  # noqa: SIM115
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        ids += [int(x["X-Page-ID"]) for x in parse_archive(data) if x["X-Page-ID"]]
        assert len(data) <= 30_000 or sum(1 for _ in parse_archive(data)) == 1
    assert ids == sorted(ids)


def test_record_of_many_megabytes(spark):
    rng = random.Random(2)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1 << 16)) * 300
    pages = spark.createDataFrame([(1, "u", noise), (2, "u", "small")], PAGE)
    path = scratch_path(spark, "warc-big")
    write_archives(pages, path)
    assert {(r.page_id, r.payload_bytes) for r in read_archives(spark, path).collect()} == {(1, len(noise)), (2, 5)}


def test_run_after_one_that_died_before_its_manifest(spark):
    path = scratch_path(spark, "warc-again")
    folder = path.removeprefix("file:")
    write_archives(spark.createDataFrame([(i, "old", f"old {i}") for i in range(50)], PAGE), path, shards=4)
    os.rename(f"{folder}/manifest", f"{folder}-manifest-gone")
    pages = spark.createDataFrame([(i, "new", f"new {i}") for i in range(5)], PAGE)
    manifest = write_archives(pages, path, shards=2)
    assert {(r.page_id, r.url) for r in read_archives(spark, path).collect()} == {(i, "new") for i in range(5)}
    for r in manifest.collect():
        data = open(f"{folder}/{r.archive}", "rb").read()  # noqa: SIM115
        assert (len(data), hashlib.sha1(data).hexdigest()) == (r.bytes, r.sha1)
    with pytest.raises(FileExistsError):
        write_archives(pages, path)


def test_shards_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 1000)
    pages = spark.createDataFrame([(i, "u", "x" * 400) for i in range(100)], PAGE)
    manifest = write_archives(pages, scratch_path(spark, "warc-shards"))
    assert len({r.archive.split("-")[1] for r in manifest.collect()}) > 2 * warc.SHARDS


def test_empty_table(spark):
    path = scratch_path(spark, "warc-empty")
    assert write_archives(spark.createDataFrame([], PAGE), path).count() == 0
    assert read_archives(spark, path).count() == 0
