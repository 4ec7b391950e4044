"""Writing paragraphs as text, DOCX and EPUB files, a file for each book, from tasks."""

from __future__ import annotations

import html
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import Appending, Output

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: Characters that XML can't hold.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _xml(text: str) -> str:
    return escape(_NOT_XML.sub("", text), {"\r": "&#13;"})


class TextFile:
    def __init__(self, out: Output, title: str):
        self.out, self.blocks = out, 0

    def add(self, chapter: int, heading: str, text: str) -> None:
        self.out.write((("\n\n" if self.blocks else "") + text).encode())
        self.blocks += 1

    def close(self) -> None:
        pass


class DocxFile:
    """Each chapter begins with its title as a heading of the first level, if it has one."""

    def __init__(self, out: Output, title: str):
        self.zip, self.chapter = zipfile.ZipFile(Appending(out), "w", zipfile.ZIP_DEFLATED), None
        self.zip.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        self.zip.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(title)}</dc:title></cp:coreProperties>')
        self.zip.writestr("word/styles.xml", f'<w:styles {_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        self.body = self.zip.open("word/document.xml", "w")
        self.body.write(f"<w:document {_W}><w:body>".encode())

    def add(self, chapter: int, heading: str, text: str) -> None:
        if chapter != self.chapter and heading:
            self._paragraph(heading, '<w:pPr><w:pStyle w:val="H1"/></w:pPr>')
        self.chapter = chapter
        self._paragraph(text, "")

    def _paragraph(self, text: str, style: str) -> None:
        self.body.write(f'<w:p>{style}<w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'.encode())

    def close(self) -> None:
        self.body.write(b"</w:body></w:document>")
        self.body.close()
        self.zip.close()


class EpubFile:
    """Each chapter is a document."""

    def __init__(self, out: Output, title: str):
        self.zip, self.title, self.chapter, self.names = zipfile.ZipFile(Appending(out), "w", zipfile.ZIP_DEFLATED), title, None, []
        self.body = None
        self.zip.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        self.zip.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')

    def add(self, chapter: int, heading: str, text: str) -> None:
        if chapter != self.chapter:
            self._end()
            self.chapter = chapter
            self.names.append(f"chapter-{chapter:05d}.xhtml")
            self.body = self.zip.open(f"OPS/{self.names[-1]}", "w")
            self.body.write(f'<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>{html.escape(heading)}</h1>'.encode())
        self.body.write(f"<p>{html.escape(_NOT_XML.sub('', text))}</p>".encode())

    def _end(self) -> None:
        if self.body is not None:
            self.body.write(b"</body></html>")
            self.body.close()

    def close(self) -> None:
        self._end()
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(self.names))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(self.names)))
        self.zip.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(self.title)}</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        self.zip.close()


WRITERS = {"txt": TextFile, "docx": DocxFile, "epub": EpubFile}


def write_book_files(paragraphs: DataFrame, folder: str) -> DataFrame:
    """Rows (path) of the files written: rows (name, format, book_title, chapter_idx, title, para_idx, text) by name and format.

    Rows are dealt out by book and sorted, so a task holds one paragraph of one book at a time. A file appears
    when it is whole; a repeated task writes the same one again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = out = writer = None
        for batch in batches:
            done = []
            for name, kind, book_title, chapter, heading, text in zip(*(batch[c].to_pylist() for c in ("name", "format", "book_title", "chapter_idx", "title", "text"))):
                if (name, kind) != at:
                    if out is not None:
                        writer.close()
                        out.close()
                        done.append(out.path)
                    at, out = (name, kind), Output(f"{folder}/{name}.{kind}")
                    writer = WRITERS[kind](out, book_title)
                writer.add(chapter, heading or "", text)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.path])], names=["path"])

    columns = ["name", "format", "book_title", "chapter_idx", "title", "para_idx", "text"]
    rows = paragraphs.select(columns).repartition("name", "format").sortWithinPartitions("name", "format", "chapter_idx", "para_idx")
    return rows.mapInArrow(run, "path string")
