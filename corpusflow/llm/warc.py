"""Sharded web archives: written in order, rolled by compressed size, read back and checked.

Records are sorted by page number over ranges that depend on the data alone. Each is a gzip member of its own, with headers
and digests made anew. A task concatenates members and closes an archive when the next one would pass the size limit.
Spark's own writer stores archives under temporary names. The manifest is made from these; then they get their final names,
and the manifest is put in its place last. Readers only take archives that it names. What a run that died before that has
left in the folder is replaced or ignored; a folder that has a manifest is not written again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import staged, with_python

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
#: Bytes of html for each task that writes archives, and how many tasks write at least.
SHARD_BYTES, SHARDS = 256 << 20, 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: of equal payloads of ``least`` bytes or more all but the
    one with the largest page_id refer to it. Smaller ones stand alone.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.filter(F.octet_length("html") >= least)
    latest = staged(
        long.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "latest",
    )
    return rows.join(latest, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.expr("case when not (page_id <=> latest) then latest end").alias("refers_to"),
    )


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url: str, html: str, digest: str, refers_to, date: str) -> bytes:
    """A gzip member with one record. The same page gives the same bytes."""
    payload = html.encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    data = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0)


def _members(bounds: np.ndarray, date: str):
    def run(batches):
        for batch in batches:
            # Numbers come as strings: beside nulls pandas would make them floating point.
            ids = [None if x is None else int(x) for x in batch["page_id"]]
            others = [None if x is None else int(x) for x in batch["refers_to"]]
            member = [
                record(p, u, h, d, r, date)
                for p, u, h, d, r in zip(ids, batch["url"], batch["html"], batch["digest"], others, strict=True)
            ]
            place = np.array([-(1 << 63) if x is None else x for x in ids], np.int64)
            shard = np.searchsorted(bounds, place, side="right").astype(np.int32)
            yield pd.DataFrame({"shard": shard, "place": place, "member": member})

    return run


def _archives(limit: int):
    """Whole archives without their last byte, which is zero and which the writer adds."""

    def closed(parts: list[bytes]) -> pd.DataFrame:
        data = b"".join(parts)
        if data[-1]:  # only after a record of 16 MB or more: an empty member ends with zero
            data += gzip.compress(b"", mtime=0)
        return pd.DataFrame({"value": [data[:-1]]})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for member in batch["member"]:
                if parts and size + len(member) > limit:
                    yield closed(parts)
                    parts, size = [], 0
                parts.append(member)
                size += len(member)
        if parts:
            yield closed(parts)

    return run


def range_bounds(pages: DataFrame, shards: int) -> np.ndarray:
    """Upper bounds of all shards but the last, from a sample that the page numbers alone determine."""
    rows = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("p"))
    every = max(1, rows.count() // (200 * shards))
    taken = np.sort(rows.filter(F.expr(f"pmod(xxhash64(p), {every}) = 0")).toPandas()["p"].to_numpy(np.int64))
    if not len(taken):
        return np.zeros(0, np.int64)
    return np.unique(taken[[len(taken) * k // shards for k in range(1, shards)]])


def write_archives(
    pages: DataFrame,
    path: str,
    shards: int | None = None,
    limit: int = ARCHIVE_BYTES,
    least: int = LEAST_REVISIT,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` (page_id, url, html, any other columns) as archives below ``path`` and return the manifest:
    ``archive, bytes, sha1``.

    Reruns over the same rows write the same archives. ``shards`` tasks write them, by default one for every
    ``SHARD_BYTES`` of html and ``SHARDS`` at least. A folder that has a manifest is refused. Null html is an empty payload, a null url an empty address, rows
    without page_id come first; rows that repeat are records of their own. A single record may pass ``limit``.
    """
    spark = pages.sparkSession
    with_python(spark)
    manifest_at = f"{path.rstrip('/')}/manifest"
    if _exists(spark, manifest_at):
        raise FileExistsError(manifest_at)
    if shards is None:
        total = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
        shards = max(SHARDS, -(-total // SHARD_BYTES))
    bounds = range_bounds(pages, shards)
    rows = with_revisits(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    made = rows.mapInPandas(_members(bounds, date), "shard int, place long, member binary")
    dealt = made.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("place", "member")
    files = dealt.mapInPandas(_archives(limit), "value binary").select(F.col("value").cast("string").alias("value"))
    temporary = f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(temporary)
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(temporary)
    part = F.element_at(F.split("path", "/"), -1)
    manifest = written.select(
        F.concat(
            F.lit("pages-"), F.regexp_extract(part, _PART, 1), F.lit("-"), F.regexp_extract(part, _PART, 2), F.lit(".warc.gz")
        ).alias("archive"),
        F.col("length").alias("bytes"),
        F.sha1("content").alias("sha1"),
    )
    listed = staged(manifest, "manifest")
    _rename(spark, temporary, path)
    listed.write.parquet(manifest_at)
    return spark.read.parquet(manifest_at)


#: Names of Spark's part files: the task, and which of its files.
_PART = r"^part-(\d+)-.*-c(\d+)\.txt$"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _rename(spark: SparkSession, temporary: str, path: str) -> None:
    """Names by shard and order in place of Spark's. Moves entries of the file system only, an entry per archive.

    An archive of the same name was left by a run that died before its manifest, and gives way.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(temporary)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(place):
        if m := re.match(_PART, status.getPath().getName()):
            final = jvm.org.apache.hadoop.fs.Path(path, f"pages-{m[1]}-{m[2]}.warc.gz")
            files.delete(final, False)
            if not files.rename(status.getPath(), final):
                raise OSError(f"{status.getPath()} could not be named {final}")
    files.delete(place, True)


def _headers(data: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data.decode("utf-8").split("\r\n")[1:])


def parse_archive(data: bytes):
    """Dictionaries of each record's headers and its ``block``. Digests that do not fit raise an error."""
    while data:
        unzip = zlib.decompressobj(31)
        whole = unzip.decompress(data) + unzip.flush()
        data = unzip.unused_data
        if not whole:
            continue
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = _headers(head)
        block = rest[: int(fields["Content-Length"])]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        yield fields | {"block": block}


def _read(batches):
    for batch in batches:
        for content in batch["content"]:
            out = []
            for fields in parse_archive(content):
                http, _, payload = fields["block"].partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                page, other = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                out.append(
                    (
                        int(page) if page else None,
                        fields["WARC-Target-URI"],
                        fields["WARC-Type"],
                        digest,
                        int(_headers(http)["Content-Length"]),
                        int(other) if other else None,
                        payload if fields["WARC-Type"] == "response" else None,
                    )
                )
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that the manifest below ``path`` names:
    ``page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload`` (null for revisits).
    """
    with_python(spark)
    named = spark.read.parquet(f"{path.rstrip('/')}/manifest").select("archive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(named, "archive", "left_semi")
    rows = files.select("content").mapInPandas(
        _read,
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long,"
        " payload binary",
    )
    return rows
