"""Archive sources: ZIP files → one row per selected member.

Two ways in:

* ``list_members`` + ``read_members`` (files on shared storage): ``binaryFile``
  lists the archives without reading them (the content column is pruned),
  one small task per archive reads the ZIP central directory, once, and emits
  each member's name and place; chunks of consecutive members, cut by number
  and bytes, are then spread over tasks, which read a member's own bytes at
  its place and never the directory again.  So one huge archive is unpacked
  by many tasks and never has to fit in one row.
* ``archive_entries`` (bytes already in a DataFrame, e.g. an upload or a
  ``binaryFile`` scan of small archives): members are unpacked from the
  content column.

Member selection (extension, resource-fork folder) happens before any bytes
are read, and the ordinal counts selected members in archive order.  A member
that cannot be read gets an ``error`` instead of failing the job.
"""

from __future__ import annotations

import bz2
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.text import DEFAULT_EXTENSIONS, SKIPPED_PREFIX
from shortlist.schemas import ENTRY_SCHEMA

#: Consecutive members of an archive that one task reads together.
CHUNK_MEMBERS = 256
#: Packed bytes of consecutive members that one task reads together, about.
CHUNK_BYTES = 32 << 20
#: Bytes or characters of member content gathered before a batch leaves the task.
BATCH_SIZE = 4 << 20

#: place: start of the member's local header; packed: its packed bytes; before: those of the members before it.
MEMBER_COLUMNS = ("archive", "idx", "name", "error", "place", "packed", "method", "flags", "crc", "before")
MEMBER_LIST_SCHEMA = ("archive string, idx bigint, name string, error string, place bigint, packed bigint, "
                      "method int, flags int, crc bigint, before bigint")
#: Fixed values of the ZIP format: signature and size of a local header, where it tells the sizes of name and
#: extra field, and the flag of encryption.
LOCAL_HEADER, LOCAL_HEADER_SIZE, LOCAL_SIZES_AT = b"PK\x03\x04", 30, 26
ENCRYPTED = 1


def selected(name: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
             skipped_prefix: str = SKIPPED_PREFIX) -> bool:
    """Python twin of ``functions.text.entry_selected`` for use inside tasks."""
    low = name.lower()
    return any(low.endswith(e.lower()) for e in extensions) and not name.startswith(skipped_prefix)


def read_archives(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.zip",
                  recursive: bool = False) -> DataFrame:
    """``binaryFile`` scan of archive files: (path, modificationTime, length, content)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(list(paths) if not isinstance(paths, str) else paths)


def archives_from_bytes(spark: SparkSession, items: Sequence[tuple[str, bytes]]) -> DataFrame:
    """In-memory archives (name, bytes) as a DataFrame with the ``binaryFile`` columns."""
    pdf = pd.DataFrame({"path": [n for n, _ in items],
                        "length": [len(b) for _, b in items],
                        "content": [bytes(b) for _, b in items]})
    return spark.createDataFrame(pdf, "path string, length long, content binary")


def _open_path(path: str):
    """Open a file on any filesystem pyarrow knows (local, HDFS, S3, GCS...)."""
    from pyarrow import fs as pafs
    if path.startswith("file://"):
        return pafs.LocalFileSystem().open_input_file(path[len("file://"):])
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path[len("file:"):])
    if "://" in path:
        filesystem, inner = pafs.FileSystem.from_uri(path)
        return filesystem.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def _failed(archive: str, exc: Exception) -> tuple:
    """One error row for an unreadable archive; the job goes on."""
    return (archive, 0, "", f"{type(exc).__name__}: {exc}", None, None, None, None, None, 0)


def _list_zip(archive: str, source, extensions: Sequence[str]) -> list[tuple]:
    try:
        with zipfile.ZipFile(source) as zf:
            found = [m for m in zf.infolist() if selected(m.filename, extensions)]
    except Exception as exc:
        return [_failed(archive, exc)]
    out, before = [], 0
    for i, m in enumerate(found, start=1):
        out.append((archive, i, m.filename, None, m.header_offset, m.compress_size, m.compress_type, m.flag_bits, m.CRC, before))
        before += m.compress_size
    return out


def _unpacked(data: bytes, method: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -zlib.MAX_WBITS)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(data)
    raise NotImplementedError(f"compression method {method}")


def read_member(archive, place: int, packed: int, method: int, flags: int, crc: int) -> bytes:
    """A member's bytes from an open archive file, by two ranged reads."""
    if flags & ENCRYPTED:
        raise RuntimeError("the member is encrypted")
    archive.seek(place)
    head = archive.read(LOCAL_HEADER_SIZE)
    if head[:len(LOCAL_HEADER)] != LOCAL_HEADER or len(head) < LOCAL_HEADER_SIZE:
        raise zipfile.BadZipFile("no local header at the member's place")
    archive.seek(place + LOCAL_HEADER_SIZE + sum(struct.unpack_from("<HH", head, LOCAL_SIZES_AT)))
    data = _unpacked(archive.read(packed), method)
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("bad CRC-32")
    return data


def list_members(archives: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Name and place of every selected member (``MEMBER_COLUMNS``), reading each ZIP directory once."""
    exts = tuple(extensions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with _open_path(path) as fh:
                        rows.extend(_list_zip(path, fh, exts))
                except OSError as exc:
                    rows.append(_failed(path, exc))
            frame = pd.DataFrame(rows, columns=list(MEMBER_COLUMNS))
            yield frame.astype({c: "Int64" for c in MEMBER_COLUMNS[4:]})

    return archives.select("path").mapInPandas(run, MEMBER_LIST_SCHEMA)


def _batches(rows: Iterator[tuple], columns: Sequence[str], content: int) -> Iterator[pd.DataFrame]:
    """Rows in frames of about ``BATCH_SIZE`` of the column at index ``content``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[content] or ()) + 64
        if size >= BATCH_SIZE:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_members(members: DataFrame, extractor=None, partitions: int | None = None,
                 chunk: int = CHUNK_MEMBERS) -> DataFrame:
    """Spread chunks of members over tasks, then read and decode each member.

    ``members`` is what ``list_members`` gives.  Consecutive members of an
    archive stay in one task up to ``chunk`` of them or ``CHUNK_BYTES`` packed
    bytes; the task opens the archive file about once per chunk and reads the
    members' own bytes only.
    Returns (archive, idx, name, raw_text, error).  ``extractor`` maps member
    bytes to text (default: UTF-8 text, HTML stripped to text); a failure gives
    raw_text '' and an error message, and errors of the listing are passed on.
    """
    from shortlist.sources.extractors import default_extractor
    extract = extractor or default_extractor
    n = partitions or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = members.repartition(n, F.col("archive"), F.floor((F.col("idx") - 1) / F.lit(chunk)),
                                 F.floor(F.col("before") / F.lit(CHUNK_BYTES)))
    columns = ["archive", "idx", "name", "raw_text", "error"]

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        opened, fh = None, None
        try:
            for pdf in batches:
                for archive, idx, name, known, *place, _before in pdf.itertuples(index=False):
                    if isinstance(known, str):   # an archive or member that could not be listed stays an error
                        yield archive, idx, name, "", known
                        continue
                    try:
                        if archive != opened:
                            if fh is not None:
                                fh.close()
                            opened, fh = None, None
                            fh = _open_path(archive)
                            opened = archive
                        text = extract(name, read_member(fh, *map(int, place)))
                    except Exception as exc:
                        yield archive, idx, name, "", f"{type(exc).__name__}: {exc}"
                    else:
                        yield archive, idx, name, text, None
        finally:
            if fh is not None:
                fh.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batches(texts(batches), columns, 3)

    return spread.select(*MEMBER_COLUMNS).mapInPandas(
        run, "archive string, idx bigint, name string, raw_text string, error string")


def archive_entries(archives: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                    path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Archives with their bytes in a column → (archive, idx, name, content, error)."""
    exts = tuple(extensions)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for archive, blob in zip(pdf[path_col], pdf[content_col]):
                try:
                    zf = zipfile.ZipFile(io.BytesIO(blob))
                except Exception as exc:
                    yield archive, 0, "", None, f"{type(exc).__name__}: {exc}"
                    continue
                with zf:
                    names = [n for n in zf.namelist() if selected(n, exts)]
                    for i, name in enumerate(names, start=1):
                        try:
                            with zf.open(name) as f:
                                data = f.read()
                        except Exception as exc:
                            yield archive, i, name, None, f"{type(exc).__name__}: {exc}"
                        else:
                            yield archive, i, name, data, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batches(members(batches), [f.name for f in ENTRY_SCHEMA.fields], 3)

    return archives.select(path_col, content_col).mapInPandas(run, ENTRY_SCHEMA)


def entry_texts(entries: DataFrame, extractor=None, partitions: int | None = None) -> DataFrame:
    """(archive, idx, name, content, error) → (archive, idx, name, raw_text, error).

    Members are hash-spread on (archive, idx) first so one big archive is
    decoded by many tasks.
    """
    from shortlist.sources.extractors import default_extractor
    extract = extractor or default_extractor
    n = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = entries.repartition(n, "archive", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for name, blob, err in zip(pdf["name"], pdf["content"], pdf["error"]):
                if err is not None or blob is None:
                    texts.append("")
                    errors.append(err)
                    continue
                try:
                    texts.append(extract(name, blob))
                    errors.append(None)
                except Exception as exc:
                    texts.append("")
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({"archive": pdf["archive"], "idx": pdf["idx"], "name": pdf["name"],
                                "raw_text": texts, "error": errors})

    return spread.mapInPandas(run, "archive string, idx bigint, name string, raw_text string, error string")
