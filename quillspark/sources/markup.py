"""HTML to a title and paragraphs, with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Pages of a batch that are read, and whose paragraphs are passed on, at once.
SLICE = 64


class _Reader(HTMLParser):
    """The first heading of the upper three levels, paragraph texts, and the text of the body without that heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.paragraphs: list[str] = []
        self.body: list[str] = []
        self.title_parts: list[str] | None = None
        self.parts: list[list[str]] = []
        self.pieces: list[str] = []
        self._heading: list[str] | None = None
        self._paragraph: list[str] | None = None
        self._skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self._skip += 1
        elif tag in ("h1", "h2", "h3") and self.title is None and self._heading is None:
            self._heading = []
        elif tag == "p":
            self._end_paragraph()
            self._paragraph = []
        elif tag in ("div", "br", "li", "section"):
            self.body.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self._skip = max(0, self._skip - 1)
        elif tag in ("h1", "h2", "h3") and self._heading is not None:
            self.title, self.title_parts = " ".join("".join(self._heading).split()), self._heading
            self._heading = None
        elif tag == "p":
            self._end_paragraph()

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        if self._heading is not None:
            self._heading.append(data)
            return
        self.body.append(data)
        self.pieces.append(data)
        if self._paragraph is not None:
            self._paragraph.append(data)

    def _end_paragraph(self) -> None:
        if self._paragraph is not None:
            self.paragraphs.append(" ".join("".join(self._paragraph).split()))
            self.parts.append(self._paragraph)
            self._paragraph = None

    def finish(self, exact: bool = False) -> tuple[str, list[str]]:
        """The title and paragraphs. With `exact` as older output has them.

        Then the parts of a title are joined by nothing and those of a paragraph by blanks, blank
        paragraphs keep their place as empty texts, and a page without paragraphs is split at blank lines alone.
        """
        self.close()
        self._end_paragraph()
        if exact:
            texts = [" ".join(x.strip() for x in p if x.strip()) for p in self.parts]
            if not texts:
                texts = [x.strip() for x in "\n".join(self.pieces).split("\n\n") if x.strip()]
            return "".join(x.strip() for x in self.title_parts or ()), texts
        found = [p for p in self.paragraphs if p]
        if not found:
            found = [" ".join(b.split()) for b in "".join(self.body).split("\n\n")]
        return self.title or "", [p for p in found if p]


def read_html(text: str, exact: bool = False) -> tuple[str, list[str]]:
    reader = _Reader()
    reader.feed(text)
    return reader.finish(exact)


def html_paragraphs(pages: DataFrame, *keys: str, html: str = "html", exact: bool = False) -> DataFrame:
    """Rows (keys, title, para_idx, text) of every page, whatever its markup; `exact` as older output has them (see `_Reader.finish`)."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows: list[int] = []
                titles, places, texts = [], [], []
                for row, page in enumerate(part[html].to_pylist()):
                    title, found = read_html(page or "", exact)
                    for i, p in enumerate(found):
                        if p:
                            rows.append(row)
                            titles.append(title)
                            places.append(i)
                            texts.append(p)
                own = [part[k].take(pa.array(rows, pa.int32())) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(titles, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=[*keys, "title", "para_idx", "text"])

    return pages.select(*keys, html).mapInArrow(run, f"{kinds}, title string, para_idx int, text string")


def simple_title(html: Column) -> Column:
    """The first heading, for well-formed markup: inside whole-stage code."""
    return _text(F.regexp_extract(html, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1))


def simple_paragraphs(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """The same as `html_paragraphs` for closed `<p>` elements, without Python."""
    parts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return pages.select(*keys, F.posexplode(F.filter(F.transform(parts, _text), lambda p: p != "")).alias("para_idx", "text"))


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[ \t\r\n]+", " "))
