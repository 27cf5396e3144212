"""WARC archives: write captures, read records, assemble transactions.

A capture is three records: a response (or a revisit, when an earlier one has
the same payload), its request and its metadata, the latter two naming the
first by WARC-Concurrent-To.  Files are WARC 1.1 with one gzip member for each
record.  Reading gives a row for each record; assembling joins the records of a
transaction through the concurrent-to identifiers into one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import new_folder, store, with_row_id

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = ("file string, offset bigint, record_id string, type string, concurrent_to string, target_uri string, "
          "refers_to string, payload_digest string, payload_bytes bigint, fields map<string,string>")


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}/{number}')}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member; header values keep to a line."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(rid, of_rid) of rows whose payload, of ``min_bytes`` at least, an earlier row has.

    The earliest is that with the smallest id (nulls last; of repeated rows the first).
    """
    payload = F.coalesce(payload_col, F.lit(""))
    keyed = with_row_id(pages.select(F.col(id_col).alias("id"), F.sha1(payload.cast("binary")).alias("digest"),
                                     F.octet_length(payload).alias("bytes"))).where(F.col("bytes") >= min_bytes)
    first = (keyed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", F.col("first.rid").alias("of_rid")))
    return keyed.join(first, "digest").where("rid <> of_rid").select("rid", "of_rid")


def write_captures(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                   id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write three records for each row of ``pages`` (a stored table); returns the stored list of files.

    The payload is the text in UTF-8, null for empty; a null url leaves out the
    target.  One file for each task attempt; only files of finished attempts are listed.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    copies = store(revisits(pages, min_bytes, id_col, payload_col), "revisits")
    rows = with_row_id(pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"),
                                    F.col(payload_col).alias("payload"))).join(copies, "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        name, count, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("rid", "id", "url", "payload", "of_rid")]
            for lo in range(0, batch.num_rows, 256):
                for rid, page, url, payload, of in zip(*(c.slice(lo, 256).to_pylist() for c in columns)):
                    out = out or target.open_output_stream(f"{root}/{name}", compression=None)
                    body = (payload or "").encode()
                    own, digest = record_id("capture", rid), f"sha1:{digest32(body)}"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    kind = "response" if of is None else "revisit"
                    out.write(record([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
                                      ("WARC-Payload-Digest", digest),
                                      ("WARC-Profile", None if of is None else
                                       "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                      ("WARC-Refers-To", None if of is None else record_id("capture", of)),
                                      ("Content-Type", "application/http; msgtype=response")],
                                     http + body if of is None else http))
                    out.write(record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", rid)), ("WARC-Date", date),
                                      ("WARC-Target-URI", url), ("WARC-Concurrent-To", own),
                                      ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"))
                    out.write(record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", rid)), ("WARC-Date", date),
                                      ("WARC-Target-URI", url), ("WARC-Concurrent-To", own),
                                      ("Content-Type", "application/warc-fields")],
                                     b"" if page is None else f"page-id: {' '.join(page.split())}\r\n".encode()))
                    count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["file", "captures"])
    return store(rows.mapInArrow(run, "file string, captures bigint"), "warc-files")


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, headers in lower case, block) of each record of an opened, decompressed file."""
    number = 0
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number}: no WARC version line")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {number}: cut short")
        yield number, headers, block
        number += 1


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in pairs}, body


def read_records(files: DataFrame, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """A row for each record of the listed files, read as streams; see ``RECORD``.

    payload_digest and payload_bytes of responses are computed from the payload;
    those of revisits are what their headers state.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    kinds = [("file", pa.string()), ("offset", pa.int64()), *((x, pa.string()) for x in
             ("record_id", "type", "concurrent_to", "target_uri", "refers_to", "payload_digest")),
             ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))]
    kinds = pa.schema(kinds + ([("payload", pa.binary())] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out():
            nonlocal rows, held
            batch = pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows), kinds)], schema=kinds)
            rows, held = [], 0
            return batch
        for batch in batches:
            for file in batch.column("file").to_pylist():
                source, path = fs.FileSystem.from_uri(file)
                with source.open_input_stream(path, compression=None) as raw, \
                        gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 20) as stream:
                    for number, head, block in parse(stream):
                        kind, body, digest, size, fields = head.get("warc-type"), None, head.get("warc-payload-digest"), None, {}
                        if kind == "response":
                            _, body = _http(block)
                            digest, size = digest32(body), len(body)
                        elif kind == "revisit":
                            http, _ = _http(block)
                            digest = digest.partition(":")[2] if digest else None
                            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                        elif head.get("content-type") == "application/warc-fields":
                            lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)
                            fields = {k.strip(): v.strip() for k, _, v in lines}
                        rows.append((file, number, head.get("warc-record-id"), kind, head.get("warc-concurrent-to"),
                                     head.get("warc-target-uri"), head.get("warc-refers-to"), digest, size, list(fields.items()),
                                     *([body] if payloads else [])))
                        held += (len(body) if payloads and body else 0) + 500
                        if held >= batch_bytes:
                            yield out()
        if rows:
            yield out()
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file").repartition(parts, "file").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, requests and metadata.

    Requests and metadata belong to the capture that their concurrent-to names;
    those that name none, or one that isn't there, belong to no row.  A capture
    without them has empty arrays; null ids join nothing.
    """
    captures = records.where("type in ('response', 'revisit')").select(
        "record_id", F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("capture"))
    side = records.where("type in ('request', 'metadata') and concurrent_to is not null").groupBy(
        F.col("concurrent_to").alias("record_id")).agg(
        F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"))
    empty = side.schema
    return captures.join(side, "record_id", "left").select(
        "record_id", "capture", F.coalesce("requests", F.array().cast(empty["requests"].dataType)).alias("requests"),
        F.coalesce("metadata", F.array().cast(empty["metadata"].dataType)).alias("metadata"))
