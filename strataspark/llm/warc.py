"""Operator 2: WARC files with a Zstandard dictionary.

Every file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then comes one
Zstandard frame a record, each compressed on its own with that dictionary, so that any record can be
read from its offset alone. The first record is a ``warcinfo``. The dictionary is trained on all records of the file itself
(fast cover with segments of ``SEGMENT`` bytes). Each partition of the input writes its own files of about
``file_bytes`` before compression, without a shuffle. Files, record ids and dates depend on the records alone, and
a file appears whole or not at all, so a task that runs again leaves the same files.

Defined results: a null page is archived as an empty body, a null URL as ``urn:page:<id>``; control
characters in URLs are percent-encoded; the table has no time of capture, so that all records have the date given; repeated
rows are archived each time; an empty table writes no file; where the
records are too few or too short to train on, the file has no dictionary frame. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, store

SKIPPABLE = 0x184D2A5D
MAGIC = 0xFD2FB528
FILE_BYTES, DICT_BYTES, SEGMENT, LEVEL, DATE = 32_000_000, 65_536, 1024, 3, "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, body: bytes, date: str = DATE) -> tuple[bytes, str]:
    """A resource record and the digest of its body."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else f"urn:page:{page_id}"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target} {digest}")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\nWARC-Block-Digest: {digest}\r\nWARC-Page-ID: {'' if page_id is None else page_id}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n", digest


def info(date: str = DATE) -> bytes:
    """The record that tells what the file is."""
    body = b"software: strataspark\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {date}")
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes], dict_bytes: int = DICT_BYTES) -> zstandard.ZstdCompressionDict | None:
    size = min(dict_bytes, max(256, sum(map(len, records)) // 10))
    try:
        return zstandard.train_dictionary(size, records, k=min(SEGMENT, size // 8), d=8, split_point=1.0, level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return None


def pack(records: list[bytes], dict_bytes: int = DICT_BYTES, level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """A file of the records; offset and length of each one's frame."""
    trained = dictionary(records, dict_bytes)
    out, places = [], []
    at = 0
    if trained is not None:
        data = trained.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(data)) + data)
        at = len(out[0])
        trained.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in records:
        frame = packer.compress(r)
        out.append(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return b"".join(out), places


def dictionary_of(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary at the head of a file and where the records begin."""
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == SKIPPABLE:
            return zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    return None, 0


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by the sizes in its headers."""
    magic, flags = struct.unpack_from("<IB", data, at)
    if magic != MAGIC:
        raise ValueError(f"no Zstandard frame at {at}")
    single = flags >> 5 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + (4 if flags >> 2 & 1 else 0)


def unpack(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record."""
    trained, at = dictionary_of(data)
    reader = zstandard.ZstdDecompressor(dict_data=trained)
    view = memoryview(data)
    while at < len(data):
        end = frame_end(data, at)
        yield at, reader.decompress(view[at:end])
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


PLACES = "page_id long, url string, file string, offset long, length long, bytes long, digest string"


def written(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, dict_bytes: int = DICT_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write the pages below ``path``; gives where each record went. Written once, when called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            name = f"{path}/part-{part:06d}-{n:04d}.warc.zst"
            data, places = pack([info(date), *(r for r, *_ in held)], dict_bytes, level)
            files.write(name, data)
            rows = [{"page_id": i, "url": u, "file": name, "offset": a, "length": b, "bytes": len(r), "digest": d} for (r, d, i, u), (a, b) in zip(held, places[1:])]
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_pylist(rows, schema=ARROW)

        for b in batches:
            for i, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                r, digest = record(i, url, (page or "").encode("utf-8", "surrogatepass"), date)
                held.append((r, digest, i, url))
                size += len(r)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return store.cut(plain.mapInArrow(run, PLACES), "places")


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, date, digest, file, offset) of all records below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for at, content in unpack(data):
                    head, body = parse(content)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    rows.append({"page_id": int(head["WARC-Page-ID"]) if head["WARC-Page-ID"] else None, "url": head["WARC-Target-URI"], "html": body.decode("utf-8", "replace"), "date": head["WARC-Date"], "digest": head["WARC-Block-Digest"], "file": name, "offset": at})
                yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content").mapInArrow(run, "page_id long, url string, html string, date string, digest string, file string, offset long")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64())])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages in the shared folder; a row for each record. The file's name within the archive is kept."""
    places = written(spark.read.parquet(f"{sf_dir}/pages.parquet"), store.fresh_path(spark, "warc"))
    return places.withColumn("file", F.substring_index("file", "/", -1))
