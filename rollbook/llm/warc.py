"""WARC archives as a table of record chunks.

Writing streams each payload through a gzip member of its own, a chunk at a time; reading streams the archives
back as rows (record, chunk number, bytes) that carry the SHA-256 of the payload so far, so neither side ever
builds a second copy of a whole record, however large. Of equal payloads one becomes a response, the others
revisits that refer to it.

Archives go to the shared folder by whatever file system its URI names, under names that no other attempt of a
task uses; only the files that a finished attempt lists in the manifest are read.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.sources.shared import shared_dir, written

CHUNK_BYTES = 1 << 20
#: An archive is closed once so much payload is in it.
ARCHIVE_BYTES = 32 << 20
#: Smaller payloads are never revisits.
LEAST_PAYLOAD = 100
DATE = "1970-01-01T00:00:00Z"
_BATCH_BYTES = 4 << 20
_URN = "urn:x-page:"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
_CHUNKS = pa.schema([("path", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("sha256", pa.string()), ("last", pa.bool_())])
_CHUNKS_DDL = "path string, record bigint, page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, chunk bigint, data binary, sha256 string, last boolean"


def _open(path: str, write: bool = False) -> BinaryIO:
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if write:
        system.create_dir(os.path.dirname(at), recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def write_record(out: BinaryIO, page_id: int | None, url: str | None, payload: memoryview | bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
    """One record, a gzip member of its own. A revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))
    if not revisit:
        payload = memoryview(payload)
        for at in range(0, len(payload), CHUNK_BYTES):
            out.write(member.compress(payload[at : at + CHUNK_BYTES]))
    out.write(member.compress(b"\r\n\r\n"))
    out.write(member.flush())


def _headers(file: BinaryIO) -> tuple[str, dict[str, str]] | None:
    first = file.readline()
    if not first:
        return None
    out = {}
    while (line := file.readline().rstrip(b"\r\n")):
        key, _, value = line.decode().partition(":")
        out[key.lower()] = value.strip()
    return first.decode().strip(), out


def _id(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_URN)
    return int(digits) if digits else None


def read_records(path: str) -> Iterator[dict]:
    """The chunks of an archive's records in order. Every record has at least one; a damaged payload raises."""
    with _open(path) as raw, gzip.GzipFile(fileobj=raw) as file:
        record = 0
        while (top := _headers(file)) is not None:
            version, head = top
            if not version.startswith("WARC/"):
                raise ValueError(f"{path}: record {record} starts with {version!r}")
            start = file.tell()
            _, http = _headers(file)
            left = int(head["content-length"]) - (file.tell() - start)
            revisit, given = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha256:")
            url = head.get("warc-target-uri")
            row = {"path": path, "record": record, "page_id": _id(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to")), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "payload_bytes": int(http["content-length"])}
            digest, chunk = hashlib.sha256(), 0
            while True:
                data = file.read(min(left, CHUNK_BYTES))
                if left and not data:
                    raise ValueError(f"{path}: record {record} is cut short")
                left -= len(data)
                digest.update(data)
                if not left and not revisit and digest.hexdigest() != given:
                    raise ValueError(f"{path}: record {record} has another payload digest")
                yield row | {"chunk": chunk, "data": data, "sha256": given if revisit else digest.copy().hexdigest(), "last": not left}
                chunk += 1
                if not left:
                    break
            file.read(4)
            record += 1


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all pages in the folder; returns the manifest (path, n_records), already written.

    pages needs page_id, url and html; other columns are ignored. A null html is an empty payload, a null url is
    left out, a null id stays null. Of rows with equal payloads of at least LEAST_PAYLOAD bytes, those with the
    smallest id are responses and the others revisits. An empty table gives no archives.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = records.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n").withColumn("copied", F.lit(True))
    records = records.join(copies, "digest", "left")
    records = records.withColumn("revisit", F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).drop("copied")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, path, size, n, files = None, "", 0, 0, []
        for batch in batches:
            payloads = batch["payload"]
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                if out is None:
                    path = f"{name}-{len(files):04d}.warc.gz"
                    out, size, n = _open(path, write=True), 0, 0
                data = memoryview(payloads[i].as_buffer())
                write_record(out, row["page_id"], row["url"], data, row["digest"], row["refers_to"], row["revisit"])
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    files.append({"path": path, "n_records": n})
                    out = None
        if out is not None:
            out.close()
            files.append({"path": path, "n_records": n})
        yield pa.RecordBatch.from_pylist(files, _MANIFEST)

    return written(records.mapInArrow(write, "path string, n_records bigint"), "manifest")


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunked record table of the archives in the manifest: path and record (its number there) name a record.

    sha256 is that of the payload up to and with the chunk; in the row that is last it is that of the whole
    payload. A revisit has one row without bytes, with the full payload's size and digest. An empty manifest
    gives no rows.
    """
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                for row in read_records(path):
                    rows.append(row)
                    size += len(row["data"]) + 500
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    return manifest.select("path").repartition(files).mapInArrow(read, _CHUNKS_DDL)


def new_folder(pages: DataFrame) -> str:
    return f"{shared_dir(pages.sparkSession)}/rollbook/warc-{uuid.uuid4().hex}"
