"""`spark.read.format("book")`: the paragraphs of text, DOCX and EPUB files as they stand in the files.

The source lists a file or folder, takes every file to the reader of its ending, and
groups files into partitions by size. Files are read as streams: of a text file one
block is held at a time, of a DOCX file one paragraph, of an EPUB file one document.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import exists, listing, open_input
from .markup import read_html

#: Bytes of files in a partition, with so many for opening each; rows and bytes of an Arrow batch.
GROUP_BYTES, OPEN_BYTES = 16 << 20, 64 << 10
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
TEXT_CHARS = 1 << 20

RAW = "path string, format string, book_id string, title string, author string, chapter int, heading string, place int, style string, text string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_OPF = "{http://www.idpf.org/2007/opf}"

#: What a reader gives for each paragraph: title, author, chapter, heading, place, style, text.
Row = tuple[str, str, int, str, int, str, str]


class ExtractionError(ValueError):
    """A file that can't be read as a book."""


def text_rows(file: BinaryIO, title: str, exact: bool = False) -> Iterator[Row]:
    """The blocks between blank lines, counted without those that are blank; bytes that aren't UTF-8 become the replacement character."""
    text, left, place = io.TextIOWrapper(file, "utf-8", "replace", newline=None), "", 0
    while True:
        more = text.read(TEXT_CHARS)
        *blocks, left = (left + more).split("\n\n")
        for block in blocks if more else [*blocks, left]:
            if block.strip():
                yield title, "", 0, "", place, "", block.strip()
                place += 1
        if not more:
            return


def docx_rows(file: BinaryIO, title: str, exact: bool = False) -> Iterator[Row]:
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else None
        styles = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        title = (core.findtext(f"{_DC}title") if core is not None else None) or title
        author = (core.findtext(f"{_DC}creator") if core is not None else None) or ""
        place, parts = 0, {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n"}
        with z.open("word/document.xml") as body:
            above: list[ElementTree.Element] = []
            for event, x in ElementTree.iterparse(body, ("start", "end")):
                if event == "start":
                    above.append(x)
                    continue
                above.pop()
                if x.tag == f"{_W}p":
                    style = x.find(f"{_W}pPr/{_W}pStyle")
                    name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
                    yield title, author, 0, "", place, name or "", "".join((parts[e.tag] or e.text or "") for e in x.iter() if e.tag in parts)
                    place += 1
                    if above:
                        above[-1].remove(x)  # what was read is held no longer


def epub_rows(file: BinaryIO, title: str, exact: bool = False) -> Iterator[Row]:
    """Documents in reading order, or with `exact` in the order of the manifest, as older output has them; navigation is left out."""
    with zipfile.ZipFile(file) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        root = next(x.get("full-path") for x in box.iter() if x.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(root))
        title = next((x.text for x in package.iter(f"{_DC}title") if x.text), title)
        author = next((x.text for x in package.iter(f"{_DC}creator") if x.text), "")
        items = {x.get("id"): x for x in package.iter(f"{_OPF}item")}
        order = list(items.values()) if exact else [items.get(ref.get("idref")) for ref in package.iter(f"{_OPF}itemref")]
        for chapter, item in enumerate(order):
            if item is None or "nav" in (item.get("properties") or "").split() or "html" not in (item.get("media-type") or ""):
                continue
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(item.get("href"))))
            if any(part in name.lower() for part in ("nav.", "toc.")):
                continue
            heading, found = read_html(z.read(name).decode("utf-8", "replace"), exact)
            for place, text in enumerate(found):
                if text:
                    yield title, author, chapter, heading, place, "", text


READERS: dict[str, Callable[[BinaryIO, str, bool], Iterator[Row]]] = {".txt": text_rows, ".docx": docx_rows, ".epub": epub_rows}


def ending(path: str) -> str:
    return posixpath.splitext(path.lower())[1]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BookSource(DataSource):
    """Rows of RAW. Options: `path` of a file or folder; `pathGlobFilter` for names; `formats` to read, as txt,epub; `exact` (see `epub_rows`); `groupBytes`."""

    @classmethod
    def name(cls) -> str:
        return "book"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return BookReader(dict(self.options))


class BookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.names = options["path"], options.get("pathglobfilter", "*")
        self.kinds = {"." + x.strip() for x in options["formats"].split(",")} if "formats" in options else set(READERS)
        self.exact = options.get("exact", "false").lower() == "true"
        self.group = int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        if not exists(self.path):
            raise FileNotFoundError(f"no file or folder {self.path}")
        groups, size = [], self.group
        hidden = lambda path: posixpath.basename(path)[:1] in ("_", ".")
        for path, n in listing(self.path):
            if hidden(path) or not fnmatch(posixpath.basename(path), self.names):
                continue
            if ending(path) not in READERS:
                raise ExtractionError(f"no reader for {ending(path) or 'no ending'} ({path}); known formats: {', '.join(sorted(READERS))}")
            if ending(path) not in self.kinds:
                continue
            if size + n + OPEN_BYTES > self.group:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n + OPEN_BYTES
        return [Files(g) for g in groups] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in part.paths:
            kind, stem = ending(path), posixpath.splitext(posixpath.basename(path))[0]
            book = hashlib.sha256(path.encode()).hexdigest()[:32]
            try:
                with open_input(path) as file:
                    for title, author, chapter, heading, place, style, text in READERS[kind](file, stem, self.exact):
                        rows.append((path, kind[1:], book, title, author, chapter, heading, place, style, text))
                        size += len(text)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError) as error:
                raise ExtractionError(f"{path} can't be read as {kind[1:]}: {error}") from error
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in RAW.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=names)


def read_raw(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(BookSource)
    reader = spark.read.format("book")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
