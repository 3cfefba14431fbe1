"""WARC archives of individually compressed records that share a dictionary.

Each archive begins with a Zstandard skippable frame that holds a dictionary
trained on its first records; every record is a frame of its own, compressed
with that dictionary, so that a reader can start at any record.  Equal payloads
of at least ``revisit_from`` bytes are stored once: the record with the largest
id is the response, the others are revisits that name it.

Spark decides the record types and deals the records; a task streams its rows
into archives of about ``archive_bytes`` in a folder that all executors share
and writes them under names of its own attempt.  Only archives listed in the
manifest count, so a lost or repeated task leaves nothing wrong behind.

A null page is an empty payload, a null url an empty target.  Null ids are kept:
they are not eligible as the response of a group unless it has no other.  Of rows
that share the largest id and the payload, all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.texts import prepare
from skyweave.session import cut_lineage, scratch_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bound of a dictionary, and of the leading records it is trained on.
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 2 << 20
#: Payload bytes after which the next archive begins.
ARCHIVE_BYTES = 64 << 20
#: Payloads of fewer bytes are always stored.
REVISIT_FROM = 1000


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1)


def record_types(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, url, html, refers_to``: null for responses, the response's id for revisits.

    The payloads are grouped by digest and length without being moved; only
    groups of several records are joined back.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    sized = rows.withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "size": F.octet_length("html").cast("bigint")})
    groups = (
        sized.filter(F.col("size") >= revisit_from)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "size", "first_id")
    )
    return sized.join(groups, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def _number(value: int | None) -> str:
    return "null" if value is None else str(value)


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP header, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the sample records, or nothing where they are too few to train on."""
    total = sum(map(len, samples))
    size = min(size, total // 8)
    if size < 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Archives of one task; the dictionary is trained when the first records have come in."""

    def __init__(self, folder: str, level: int, archive_bytes: int):
        self.filesystem, self.folder = pafs.FileSystem.from_uri(folder)
        self.scheme_folder = folder
        self.level, self.archive_bytes = level, archive_bytes
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.stream = None

    def add(self, record: bytes) -> Iterator[tuple[str, int, int]]:
        if self.stream is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= TRAINING_BYTES:
                self._open()
        else:
            self._write(record)
        if self.raw_bytes_written() >= self.archive_bytes:
            yield self._close()

    def finish(self) -> Iterator[tuple[str, int, int]]:
        if self.waiting:
            self._open()
        if self.stream is not None:
            yield self._close()

    def raw_bytes_written(self) -> int:
        return self.raw if self.stream is not None else 0

    def _open(self) -> None:
        self.filesystem.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.stream = self.filesystem.open_output_stream(f"{self.folder}/{self.name}")
        self.records = self.raw = self.size = 0
        dictionary = trained_dictionary(self.waiting)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=shared)
        for record in self.waiting:
            self._write(record)
        self.waiting, self.waiting_bytes = [], 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _write(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1
        self.raw += len(record)

    def _close(self) -> tuple[str, int, int]:
        self.stream.close()
        self.stream = None
        return f"{self.scheme_folder}/{self.name}", self.records, self.size


def write_archives(
    records: DataFrame, folder: str, level: int = 3, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as archives; the manifest ``archive, records, bytes``.

    The manifest is written before it is returned: reading it again never writes archives again.
    """
    target = _uri(folder)

    def run(batches):
        writer = ArchiveWriter(target, level, archive_bytes)

        def told(done):
            for name, count, size in done:
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                record = _record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                yield from told(writer.add(record))
        yield from told(writer.finish())

    columns = records.select("page_id", "url", "html", "refers_to")
    return cut_lineage(columns.mapInArrow(run, "archive string, records bigint, bytes bigint"))


def _records(stream, dictionary: zstandard.ZstdCompressionDict | None) -> Iterator[bytes]:
    """The records of an archive, frame by frame, with one buffer of input at a time."""
    own = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        frame, parts = own.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                rest = frame.unused_data
                break
            data = stream.read(1 << 20)
            if not data:
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def archive_records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP header and payload of every record of an open archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive begins with its dictionary")
    dictionary = stream.read(size) if size else b""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    for record in _records(stream, shared):
        head, _, block = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record begins with {lines[0]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        if block[length:] != b"\r\n\r\n":
            raise ValueError("a record is longer or shorter than it says")
        http, _, payload = block[:length].partition(b"\r\n\r\n")
        yield fields, http, payload


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


PAGE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, html string"


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record; a response's payload is hashed again and held against its header.

    ``html`` is null for revisits, and for all records without ``payloads``.
    """
    archives = manifest.select("archive")
    if (count := manifest.count()) > 1:
        archives = archives.repartition(count)
    names = [c.split()[0] for c in PAGE.split(", ")]

    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                filesystem, path = pafs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with filesystem.open_input_stream(path) as stream:
                    for fields, http, payload in archive_records(stream):
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
                            raise ValueError(f"{archive}: the payload of {fields['WARC-Record-ID']} is damaged")
                        refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        html = payload.decode() if payloads and kind == "response" else None
                        url = fields["WARC-Target-URI"]
                        rows.append((_page(fields["WARC-Record-ID"]), length, digest, kind, refers, url, html))
                        size += len(payload)
                        if len(rows) >= 1000 or size >= 8 << 20:
                            yield _page_batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _page_batch(rows, names)

    return archives.mapInArrow(run, PAGE)


def _page_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archived_pages(pages: DataFrame, folder: str | None = None, revisit_from: int = REVISIT_FROM, payloads: bool = True) -> DataFrame:
    """Write every page to archives and read the archives back."""
    spark = pages.sparkSession
    prepare(spark)
    manifest = write_archives(record_types(pages, revisit_from), folder or scratch_path(spark, "warc"))
    return read_archives(spark, manifest, payloads)

