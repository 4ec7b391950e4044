"""Media columns: payloads stored as WAV members of ZIP archives, read by a Spark data source.

The source lists an archive directory, or those of its archives that a manifest
names, cuts every archive into byte ranges, and reads in each range the members
whose header begins there. Payloads leave it in
Arrow batches of bounded size. A member that fails is read again by its offset,
without reading its neighbours again.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import Appending, Output, listing, open_input
from .util import Tables, new_path

SAMPLE_RATE = 8000
#: Payloads are padded with zero bytes to a positive multiple of so many bytes.
BLOCK = 64
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
SUFFIX = ".wav.zip"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def to_wav(samples: bytes) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(raw: bytes) -> bytes:
    kind, _, form, _, _, coding, channels, _, _, _, bits, name, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", raw)
    if (kind, form, coding, channels, bits, name) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(raw) != 44 + size:
        raise ValueError("not the WAV form that the writer makes")
    return raw[44:]


def feature(samples: bytes) -> str:
    """Level, loudness and sign changes of the samples as fixed-point text; equal samples, equal text."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};mean={total * 1000 // len(x)};power={square * 1000 // len(x)};min={int(x.min())};max={int(x.max())};crossings={crossings}"


def write_members(df: DataFrame, directory: str, key: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """Store every text as a member; the written rows tell path and number of members.

    Null texts are empty. Members are named by their place in the archive, their key
    (`null` if null) and the unpadded length, so repeated keys stay apart.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, parts = f"{directory}/part-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        out = archive = path = None
        members = 0

        def done() -> pa.RecordBatch:
            archive.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([members], pa.int64())], names=["path", "members"])

        for batch in batches:
            for k, x in zip(batch[key].to_pylist(), batch[text].to_pylist()):
                if out is None:
                    path = f"{name}-{parts:03d}{SUFFIX}"
                    parts, members = parts + 1, 0
                    out = Output(path)
                    archive = zipfile.ZipFile(Appending(out), "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                raw = (x or "").encode()
                archive.writestr(f"{members}_{'null' if k is None else k}_{len(raw)}.wav", to_wav(padded(raw)))
                members += 1
                if out.size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return (tables or Tables(df.sparkSession)).write(df.select(key, text).mapInArrow(write, "path string, members long"), "archives")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaSource(DataSource):
    """`spark.read.format("media_archive").option("path", directory)`: rows name, path, offset, media.

    Option `manifest`: a file with the name of an archive a line; others in the directory, which
    a repeated task may have left, aren't read, and a named one that is missing is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, path string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self) -> list[Range]:
        archives = listing(self.path, SUFFIX)
        if self.manifest:
            with open_input(self.manifest) as file:
                named = set(file.read().decode().split())
            archives = [(path, size) for path, size in archives if path.rpartition("/")[2] in named]
            if len(archives) < len(named):
                raise FileNotFoundError(f"{self.path}: {len(named) - len(archives)} archives of the manifest are missing")
        ranges = [Range(path, at, min(size, at + self.range_bytes)) for path, size in archives for at in range(0, size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open_input(part.path) as file, zipfile.ZipFile(file) as archive:
            own = sorted((m for m in archive.infolist() if part.start <= m.header_offset < part.end), key=lambda m: m.header_offset)
        rows, size = [], 0
        handle = None
        for member in own:
            handle, media = self.member(part.path, member, handle)
            rows.append((member.filename, part.path, member.header_offset, media))
            size += len(media)
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def member(self, path: str, member: zipfile.ZipInfo, handle=None):
        """The file (opened again after a failure) and the bytes of one member, checked by length and CRC."""
        for attempt in range(self.retries + 1):
            try:
                handle = handle or open_input(path)
                return handle, read_at(handle, member.header_offset, member.compress_size, member.file_size, member.CRC)
            except (OSError, ValueError, zlib.error, struct.error):
                if handle is not None:
                    handle.close()
                handle = None
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)


def read_at(file, offset: int, packed: int, size: int, crc: int) -> bytes:
    file.seek(offset)
    head = file.read(30)
    magic, names, extra = head[:4], *struct.unpack_from("<HH", head, 26)
    if magic != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    file.seek(offset + 30 + names + extra)
    raw = zlib.decompress(file.read(packed), -15)
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError(f"the member at {offset} is damaged")
    return raw


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["name", "path", "offset", "media"])


def read_members(spark: SparkSession, directory: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("media_archive").option("path", directory)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored members: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["name"].to_pylist(), batch["media"]):
                raw = raw.as_py()
                samples = from_wav(raw)
                k, n = name.removesuffix(".wav").split("_")[1:]
                rows.append((None if k == "null" else int(k), int(n), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return media.select("name", "media").mapInArrow(run, f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def write_manifest(archives: DataFrame, directory: str) -> str:
    """Name the archives of `write_members` rows in a file: one line for each of some 256 MB, passed through the driver a partition at a time."""
    path = f"{directory}/{uuid.uuid4().hex}.manifest"
    out = Output(path)
    for row in archives.select("path").distinct().toLocalIterator():
        out.write((row["path"].rpartition("/")[2] + "\n").encode())
    out.close()
    return path


def store_and_read(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all texts in a new archive directory in the shared folder, read them back by the source, and return the features.

    Every row is a member of its own, repeated ones too. Only archives of committed tasks are read.
    """
    directory = new_path(spark, "media")
    archives = write_members(df, directory, key, text)
    return features(read_members(spark, directory, manifest=write_manifest(archives, directory)), key)
