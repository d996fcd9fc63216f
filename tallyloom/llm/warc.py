"""WARC records in ZIP-packaged archives: written in tasks, read back by range.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.cdxj``, a line of JSON
with offset and length for each record. The reader finds both through the
central directory (ZIP64 too), reads the index, and then reads runs of records
by range, each run in a task of its own.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the largest page_id is a response, the others are revisits, which hold the HTTP
head and the digest but no payload, and name that response.

A task streams records into archives of about ``ARCHIVE_BYTES`` of payload, and of
``ARCHIVE_RECORDS`` records at most (their index is held until the end), under
names of its own in the shared folder and returns a row for each; those rows are
written as a table, so an attempt that was lost leaves files that nothing names.
Payloads move once, by page and digest, so no group of equal pages meets in a
task; the groups themselves are combined digests.

Defined results: null html is an empty payload; a null url is left out; a null
page_id is below all others; rows that share page_id and payload are alike, and
if theirs is the largest page_id of the group all of them are responses; an
empty table gives no archive and an empty result; a very long payload is one
record, and one run; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import same, saved, shared_path, tidy
from tallyloom.llm.zip_reader import BadArchive, data_offset, members

REVISIT_BYTES = 1000
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 100_000
RUN_BYTES = 4 << 20
#: A task reads several runs where there are more of them.
MOST_TASKS = 20_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response) for each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    named = saved(full.select("page_id", digest.alias("digest"), F.octet_length("html").alias("bytes")), "page-digests")
    groups = named.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    copies = named.join(groups.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()), "digest").filter(~same(F.col("page_id"), F.col("refers_to")))
    copies = copies.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").dropDuplicates(["_id", "_digest"])
    full = full.withColumn("digest", digest)
    return full.join(copies, same(F.col("page_id"), F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def page_of(data: bytes) -> dict:
    """A record as a row; the digest of a response is checked against its payload."""
    headers, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} is not whole")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"page_id": number("x-page"), "url": headers.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page"), "payload": payload if kind == "response" else None}


class _Out:
    """A stream that only goes forward, as stores offer it."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def write(self, data) -> int:
        self.raw.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ArchiveWriter:
    """One archive: records first, then the index that was gathered meanwhile."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.stream = uri, store.open_output_stream(path)
        self.out = _Out(self.stream)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = self.payload = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 4, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"page": page_id, "digest": digest, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.payload += len(payload)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.uri, self.out.at, len(self.index)


def _write(folder: str, archive_bytes: int, archive_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in x], ["path", "bytes", "records"])

        writer = None
        for batch in batches:
            html = batch.column("html").cast(pa.binary())
            for i, (page_id, url, digest, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")), strict=True)):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                writer.add(page_id, url, html[i].as_py(), digest, refers_to)
                if writer.payload >= archive_bytes or len(writer.index) >= archive_records:
                    yield row(writer.close())
                    writer = None
        if writer is not None:
            yield row(writer.close())

    return run


def write_archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """path, bytes, records of each archive: a written table."""
    folder = shared_path(plan.sparkSession, "archives")
    return saved(plan.mapInArrow(tidy(_write(folder, archive_bytes, archive_records)), "path string, bytes long, records long"), "manifest")


def _range_reader(handle):
    def read(offset: int, length: int) -> bytes:
        return handle.read_at(length, offset)

    return read


def _runs(run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                store, place = _store(path)
                with store.open_input_file(place) as handle:
                    read = _range_reader(handle)
                    found = members(read, size)
                    data, index = found[DATA], found[INDEX]
                    if not (data.stored and index.stored):
                        raise BadArchive(f"members of {path} are compressed")
                    base = data_offset(read, data)
                    lines = [json.loads(x) for x in read(data_offset(read, index), index.size).decode().split("\n") if x]
                rows, first, lengths, total = [], None, [], 0
                for x in lines:
                    if first is not None and (total + x["length"] > run_bytes or x["offset"] != first + total):
                        rows.append((path, base + first, lengths))
                        first = None
                    if first is None:
                        first, lengths, total = x["offset"], [], 0
                    lengths.append(x["length"])
                    total += x["length"]
                if first is not None:
                    rows.append((path, base + first, lengths))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    return run


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(payload: bool):
    names = [c.split()[0] for c in PAGE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                store, place = _store(path)
                with store.open_input_file(place) as handle:
                    data, at, rows = handle.read_at(sum(lengths), start), 0, []
                for n in lengths:
                    row = page_of(zlib.decompress(data[at : at + n], 31))
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    at += n
                arrays = [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)]
                if payload:
                    arrays.append(pa.array([r["payload"] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *(["payload"] if payload else [])])

    return run


def read_archives(manifest: DataFrame, payload: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The records of the archives (path, bytes); payload: with those of responses.

    The numbers of tasks follow from the bytes of the archives, not of the rows that
    name them, which are so few that adaptive execution would put them in one task.
    """
    archives, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(MOST_TASKS, 1 + size // run_bytes)
    runs = manifest.select("path", "bytes").repartition(max(1, min(archives, tasks)), "path").mapInArrow(tidy(_runs(run_bytes)), "path string, start long, lengths array<long>")
    return runs.repartition(tasks, "path", "start").mapInArrow(tidy(_read(payload)), PAGE + (", payload binary" if payload else ""))
