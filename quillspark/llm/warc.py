"""WARC archives with dictionary-compressed records.

An archive begins with a skippable Zstandard frame that holds a dictionary trained
on its first records; every record is a frame of its own, compressed with that
dictionary, so any record can be read alone by its offset. Equal payloads are
stored once: the others are revisit records that refer to the stored one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Output, open_input
from .util import Tables, new_path, sized

#: The magic number of the leading frame, among those that decoders skip.
SKIPPABLE = 0x184D2A5D
#: Bytes of the dictionary, bytes of records it is trained on (a bounded sample of each archive), largest archive.
DICTIONARY_BYTES = 32 << 10
TRAIN_BYTES = 2 << 20
ARCHIVE_BYTES = 512 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. A revisit has no payload but tells its length and digest."""
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    lines.append(f"WARC-Payload-Length: {len(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    body = b"" if revisit else http + payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {a.lower(): b for a, _, b in (line.partition(": ") for line in lines)}
    body = rest[: int(fields["content-length"])]
    if fields["warc-type"] == "response":
        body = body.partition(b"\r\n\r\n")[2]
    return fields, body


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from archived records; too few records for training give one of their raw content."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Archive:
    """Writes one archive: records are held back until there are enough to train the dictionary on."""

    def __init__(self, url: str):
        self.url, self.out, self.held, self.held_bytes, self.places = url, Output(url), [], 0, []

    def add(self, raw: bytes) -> None:
        if self.held is None:
            self._put(raw)
            return
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= TRAIN_BYTES:
            self._start()

    def _start(self) -> None:
        # a very long record counts with its head and tail only: training needs samples, not one giant
        dictionary = train([r if len(r) <= 1 << 17 else r[: 1 << 16] + r[-(1 << 16) :] for r in self.held])
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        held, self.held = self.held, None
        for raw in held:
            self._put(raw)

    def _put(self, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.places.append((self.out.write(frame), len(frame)))

    def close(self) -> int:
        if self.held is not None:
            self._start()
        self.out.close()
        return self.out.size


def open_archive(url: str):
    """The file and a decompressor with its dictionary; the file stands at the first record."""
    file = open_input(url)
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError(f"{url}: no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(file.read(size))
    return file, zstandard.ZstdDecompressor(dict_data=dictionary)


def read_records(url: str, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record, with at most a block and a record in memory."""
    file, unpacker = open_archive(url)
    at = file.tell()
    rest = b""
    while True:
        if not rest:
            rest = file.read(block)
            if not rest:
                return
        one, out, start = unpacker.decompressobj(), [], at
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                at += len(rest) - len(one.unused_data)
                rest = one.unused_data
                break
            at += len(rest)
            rest = file.read(block)
            if not rest:
                raise ValueError(f"{url}: the record at {start} is cut off")
        yield start, b"".join(out)


def read_record(url: str, offset: int, size: int) -> bytes:
    """One record by its place."""
    file, unpacker = open_archive(url)
    file.seek(offset)
    return unpacker.decompressobj().decompress(file.read(size))


def write_archives(pages: DataFrame, directory: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, tables: Tables | None = None) -> DataFrame:
    """Write a record per row and return the written index: path, offset, size per record.

    Null payloads are empty. Of equal payloads with at least `least` bytes the row
    with the smallest key is stored, and all rows with that key if it repeats;
    rows with a null key are stored unless an equal payload has a key. Digests and
    keys are shuffled; payloads only where the digests of repeated payloads are too
    large to broadcast (`util.BROADCAST_BYTES`), with the same records then.
    """
    spark = pages.sparkSession
    tables = tables or Tables(spark)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keep = tables.write(
        rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"),
        "stored",
    )
    rows = rows.join(sized(keep), "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{directory}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        archive, n = None, 0

        def done() -> pa.RecordBatch:
            archive.close()
            k = len(archive.places)
            return pa.RecordBatch.from_arrays([pa.array([archive.url] * k, pa.string()), pa.array([p[0] for p in archive.places], pa.int64()), pa.array([p[1] for p in archive.places], pa.int64())], names=["path", "offset", "size"])

        for batch in batches:
            for i, u, raw, digest, first in zip(*(batch[c].to_pylist() for c in ("key", "url", "payload", "digest", "first"))):
                if archive is None:
                    archive = Archive(f"{name}-{n:03d}.warc.zst")
                    n += 1
                revisit = first is not None and i != first
                archive.add(record(i, u, raw, digest, first, revisit))
                if archive.out.size >= ARCHIVE_BYTES:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    written = rows.select("key", "url", "payload", "digest", "first").mapInArrow(write, "path string, offset long, size long")
    return tables.write(written, "index")


def read_archives(index: DataFrame) -> DataFrame:
    """Read every archive of an index back: key, payload_bytes, payload_digest, record_type, refers_to, url, path, offset.

    Length and digest of stored payloads are computed from the bytes read and must
    equal what the record says; those of a revisit are the ones in its header.
    """
    spark = index.sparkSession
    paths = index.select("path").distinct()
    n = max(1, paths.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows: list[tuple] = []
                for at, raw in read_records(path):
                    fields, payload = parse(raw)
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], int(fields["warc-payload-length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload at {at} isn't what its record says")
                    key = _key(fields["warc-record-id"])
                    rows.append((key, size, digest, kind, _key(fields["warc-refers-to"]) if kind == "revisit" else None, fields.get("warc-target-uri"), path, at))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long"
    return paths.repartition(min(n, 4096)).mapInArrow(read, schema) if n > 1 else paths.coalesce(1).mapInArrow(read, schema)


def _key(uri: str) -> int | None:
    value = uri[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back."""
    index = write_archives(pages, new_path(spark, "warc"))
    return read_archives(index).withColumnRenamed("key", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
