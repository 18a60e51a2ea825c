"""Zstandard web archives: a dictionary in the leading skippable frame, then one frame per record.

Archives are real files below a folder that all executors share; Spark lists and reads them. Records are
WARC 1.1. A page whose payload another page has already brought is a ``revisit`` record without the payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, written

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_SHARED_BYTES = 1000
# A new archive is begun when one has so many bytes.
ARCHIVE_BYTES = 32 << 20
# The dictionary is trained on at most so many pages picked by hash, none longer than so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 65_536, 32_768
# Frames are looked for in pieces of so many bytes.
PIECE = 1 << 16


class ArchiveError(ValueError):
    """An archive or a record that doesn't hold together."""


@dataclass
class Record:
    """Headers with lower-case names, and the block."""

    headers: dict[str, str]
    block: bytes


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """One whole record; version, headers, length and end are checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError(f"not a WARC record: {data[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"no {name} header")
    if not headers["content-length"].isdigit():
        raise ArchiveError(f"bad length: {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, the header says {length}")
    block = rest[:length]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ArchiveError("the block doesn't have its digest")
    return Record(headers, block)


class ArchiveWriter:
    """Collects one archive's bytes."""

    def __init__(self, dictionary: bytes | None):
        loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=loaded, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        self.parts, self.size, self.records = [head], len(head), 0

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)
        self.records += 1

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def read_frames(archive: bytes) -> Iterator[bytes]:
    """The content of each frame; other skippable frames are passed over."""
    view, at, loaded = memoryview(archive), 0, None
    while at < len(view):
        if at + 8 > len(view):
            raise ArchiveError("cut off at a frame's head")
        magic, length = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + length > len(view):
                raise ArchiveError("cut off in a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                content = bytes(view[8 : 8 + length])
                if struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                loaded = zstandard.ZstdCompressionDict(content)
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        frame = zstandard.ZstdDecompressor(dict_data=loaded).decompressobj()
        parts = []
        try:
            while not frame.eof:
                piece = view[at : at + PIECE]
                if not len(piece):
                    raise ArchiveError("cut off in a frame")
                parts.append(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data)
        except zstandard.ZstdError as error:
            raise ArchiveError(f"damaged frame: {error}") from error
        yield b"".join(parts)


def read_archive(archive: bytes) -> Iterator[Record]:
    for data in read_frames(archive):
        yield decode_record(data)


def _http(payload_bytes: int, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    return head.encode() + payload


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A page's record: ``first`` is the page that has the payload when this one revisits it."""
    block = _http(len(payload), payload if first is None else b"")
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return encode_record(headers, block)


def _page_number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn or "<urn:page:>")
    if not found:
        raise ArchiveError(f"not a page's name: {urn!r}")
    return int(found[1]) if found[1] else None


def decode_page(record: Record) -> dict:
    """What a page's record says; the payload's length and digest are checked where the payload is there."""
    head, mark, payload = record.block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: (\d+)", head)
    if not mark or not length:
        raise ArchiveError("no HTTP head")
    kind, digest = record.headers["warc-type"], record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    refers = None
    if kind == "revisit":
        refers = _page_number(record.headers.get("warc-refers-to"))
        if payload:
            raise ArchiveError("a revisit with a payload")
    elif kind != "response" or len(payload) != int(length[1]) or hashlib.sha1(payload).hexdigest() != digest:
        raise ArchiveError("the payload doesn't have its length or digest")
    return {
        "page_id": _page_number(record.headers["warc-record-id"]),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers,
        "url": record.headers.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def train_dictionary(pages: DataFrame, key: str = "page_id", page: str = "html") -> bytes | None:
    """A compression dictionary from a bounded sample; None where there is too little text for one."""
    picked = (
        pages.filter(F.octet_length(page).between(1, SAMPLE_BYTES))
        .select(F.xxhash64(key, F.octet_length(page)).alias("draw"), page)
        .orderBy("draw")
        .limit(SAMPLE_PAGES)
        .toArrow()
    )
    texts = sorted(t.encode() for t in picked.column(page).to_pylist())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 10 else None
    except zstandard.ZstdError:
        return None


def with_revisits(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is set where a page revisits another's payload."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col("url"),
        F.coalesce(F.col(page), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.filter(F.octet_length("payload") >= MIN_SHARED_BYTES)
        .groupBy(F.col("digest"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    joined = rows.join(written(shared, "shared"), "digest", "left")
    return joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages from ``with_revisits`` below ``folder``; returns ``path, records, bytes`` of each archive.

    A task writes archives of about ``archive_bytes``. Their names come from the task's partition and the
    attempt; a file is moved to its name when whole, and only the returned paths belong to the result, so lost or
    repeated attempts leave nothing that is read.
    """
    dictionary = train_dictionary(pages.select("page_id", F.col("payload").cast("string").alias("html")))
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)
    base = folder if "://" in folder or not folder.startswith("file:") else folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, root = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), base)
        where.create_dir(root)
        done = 0

        def flush(archive: ArchiveWriter) -> pa.RecordBatch:
            nonlocal done
            name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{done:05d}.warc.zst"
            with where.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(archive.bytes())
            where.move(f"{root}/.{name}", f"{root}/{name}")
            done += 1
            return pa.RecordBatch.from_pylist([{"name": name, "records": archive.records, "bytes": archive.size}])

        archive = ArchiveWriter(shared.value)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                archive.add(page_record(*(x.as_py() for x in row)))
                if archive.size >= archive_bytes:
                    yield flush(archive)
                    archive = ArchiveWriter(shared.value)
        if archive.records:
            yield flush(archive)

    sent = pages.select("page_id", "url", "payload", "digest", "first")
    return written(sent.mapInArrow(run, "name string, records long, bytes long"), "archives")


def read_archives(spark, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """The page records of the archives below ``folder``: what ``decode_page`` returns, by archive.

    ``archives`` may name those that count. A damaged archive fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    if archives is not None:
        files = files.join(F.broadcast(archives.select("name")), "name", "left_semi")
    fields = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )
    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa.schema(
        zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in read_archive(content.as_buffer().to_pybytes()):
                    held.append(decode_page(record))
                    size += len(record.block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("content").mapInArrow(run, fields)


def archive_round_trip(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Write every page as a record and read the archives back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` for each row. A null page is an empty
    payload. Of equal payloads of at least 1000 bytes the one with the largest id is the response; rows that share
    that id all are, and so are payloads that only rows without an id have.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    archives = write_archives(with_revisits(pages, key, page), folder)
    if archives.isEmpty():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    return read_archives(spark, folder, archives).drop("url", "payload")
