"""WARC archives in Zstandard: one frame a record, behind a skippable frame with the shared dictionary.

Pages whose payload another page has too become revisit records, which name that page and carry the HTTP header alone.
Writers put each archive under a name of their own into the shared folder and report it in a manifest; the manifest is
checkpointed, and readers open what it lists, so an archive of a task that was lost and run again is never read twice.
Both sides stream: a task holds one record and the file buffer.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8_000, 48_000
ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """A RECORD row; `problem` says what is wrong with a record that doesn't hold together."""
    try:
        head, mark, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not mark or not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC version line")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise ValueError(f"not a header: {line[:60]}")
            fields[name.strip().lower()] = value.strip()
        for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
            if name not in fields:
                raise ValueError(f"{name} is missing")
        kind, length = fields["warc-type"], int(fields["content-length"])
        if kind not in ("response", "revisit"):
            raise ValueError(f"unknown type {kind[:20]}")
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"content-length {length}, block and end {len(rest)}")
        http, mark, payload = rest[:length].partition(b"\r\n\r\n")
        if not mark or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        sizes = [int(h.partition(b":")[2]) for h in http.split(b"\r\n")[1:] if h.lower().startswith(b"content-length:")]
        if len(sizes) != 1:
            raise ValueError("no single HTTP content-length")
        known = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != sizes[0] or digest(payload) != known):
            raise ValueError("payload differs from its length or digest")
        if kind == "revisit" and (payload or "warc-refers-to" not in fields):
            raise ValueError("a revisit with a payload or without its target")
        number = lambda urn: None if urn == _urn(None) else int(urn.removeprefix("<urn:page:").removesuffix(">"))
        refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
        return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, payload if kind == "response" else None, sizes[0], known, None
    except (ValueError, UnicodeDecodeError) as error:
        return None, None, None, None, None, None, None, str(error)[:200]


class Archive:
    """Writes one archive to a stream."""

    def __init__(self, out: BinaryIO, dictionary: bytes, level: int = 3) -> None:
        self.out, self.size = out, 8 + len(dictionary)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.size += len(frame)


def read_records(source: BinaryIO) -> Iterator[bytes]:
    """Decompressed records of an archive, frame by frame; ValueError if the archive itself is broken."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary frame ends early")
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = source.read(CHUNK)
    while rest:
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as error:
                raise ValueError(f"a broken frame: {error}") from error
            if frame.eof:
                break
            rest = source.read(CHUNK)
            if not rest:
                raise ValueError("the last frame ends early")
        yield b"".join(parts)
        rest = frame.unused_data or source.read(CHUNK)


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from SAMPLE_PAGES pages, SAMPLE_CHARS characters of each; it affects sizes only."""
    sample = [r[0].encode() for r in pages.select(F.substring(html, 1, SAMPLE_CHARS)).filter(F.length(html) > 0).limit(SAMPLE_PAGES).collect()]
    blank = record_bytes(0, "https://example.org/", b"", None, False) + record_bytes(0, "https://example.org/", b"", 0, True)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [blank + s for s in sample]).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples: a raw dictionary
        return (blank + b"".join(sample))[-DICTIONARY_BYTES:]


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages to archives under a folder all executors reach; returns the manifest (path, records).

    Of pages with equal payloads the one with the largest id is the response and the others revisit it; null payloads are
    empty, null ids come after all others and revisit where an id exists. Rows that share the largest id are all
    responses. Other columns are not written.
    """
    shared_folder(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    first = rows.groupBy("key").agg(F.max("page_id").alias("response"))
    rows = rows.join(first, "key").select("page_id", "url", "html", "response", F.coalesce((F.col("page_id") < F.col("response")) | (F.col("page_id").isNull() & F.col("response").isNotNull()), F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        archive = out = path = None
        records = 0
        for batch in batches:
            for page, link, text, response, revisit in zip(*(batch.column(i) for i in range(5))):
                if archive is None:
                    path, records = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path)
                    archive = Archive(out, dictionary)
                archive.add(record_bytes(page.as_py(), link.as_py(), text.as_py().encode(), response.as_py(), revisit.as_py()))
                records += 1
                if archive.size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records])], names=["path", "records"])
                    archive = None
        if archive is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records])], names=["path", "records"])

    return rows.mapInArrow(write, "path string, records long").checkpoint()


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = True, strict: bool = False) -> DataFrame:
    """RECORD rows of all archives of a manifest. A record that doesn't hold together has its `problem` set and nulls; with
    `strict` it is an error.

    An archive without dictionary, with a broken frame, or with another number of records than the manifest says is an
    error.
    """
    columns = [c for c in ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "problem") if keep_payload or c != "payload"]
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "problem": pa.string()}
    schema = ", ".join(part.strip() for part in RECORD.split(",") if part.split()[0] in columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        all_columns = list(types)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[all_columns.index(c)] for r in rows], types[c]) for c in columns], names=columns)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path) as source:
                    for raw in read_records(source):
                        rows.append(parse_record(raw))
                        if strict and rows[-1][-1] is not None:
                            raise ValueError(f"{path}, record {seen}: {rows[-1][-1]}")
                        seen += 1
                        size += len(raw)
                        if size > 4_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{path}: {seen} records, {records} in the manifest")
                if rows:
                    yield batch_of(rows)

    return manifest.select("path", "records").mapInArrow(read, schema)


def archive_folder(spark) -> str:
    """A new folder for archives beside the checkpoints."""
    shared_folder(spark)
    folder = spark.sparkContext.getCheckpointDir()
    store, root = fs.FileSystem.from_uri(folder)
    name = f"warc-{uuid.uuid4().hex}"
    store.create_dir(f"{root}/{name}", recursive=True)
    return f"{folder.rstrip('/')}/{name}"
