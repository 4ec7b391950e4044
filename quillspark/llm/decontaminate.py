"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: every segment holds the postings of some megabytes
of texts as sorted term hashes and position lists, and is a row of a written table.
Segments are built and searched where the rows are, without a shuffle. A window of
consecutive test terms is looked up from its rarest term on: the position lists,
each shifted by the term's offset, are intersected until none is left.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Output, open_input
from .util import Tables, new_path
from .words import ALNUM_WORDS, chunks, member, text_buffer, word_hashes, word_spans

WINDOW = 13
#: Bytes of text in a segment; test terms in a block that is searched at once.
SEGMENT_BYTES = 4 << 20
BLOCK_TERMS = 1 << 20
#: Positions between the last term of a document and the first of the next, more than any window spans.
GAP = 64

_SEGMENT = "docs binary, words binary, first binary, terms binary, starts binary, postings binary"


class Segment:
    """Postings of some documents: `terms` ascending, `postings[starts[i]:starts[i + 1]]` the ascending positions of a term."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, words: np.ndarray, first: np.ndarray):
        self.terms, self.starts, self.postings, self.words, self.first = terms, starts, postings, words, first

    @classmethod
    def build(cls, hashes: np.ndarray, words: np.ndarray, vocabulary: np.ndarray | None = None) -> Segment:
        """`hashes`: the terms of all documents in turn; `words`: how many each has; only terms of the vocabulary are stored."""
        first = np.concatenate(([0], np.cumsum(words + GAP)[:-1])).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        at = np.repeat(first - (np.cumsum(words) - words), words) + np.arange(len(hashes))
        if vocabulary is not None:
            known = member(hashes, vocabulary)
            hashes, at = hashes[known], at[known]
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        return cls(hashes[new], np.append(new, len(hashes)).astype(np.int64), at[order].astype(np.uint32), words.astype(np.int64), first)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the postings of each term; equal if it has none."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[k] == terms
        return np.where(hit, self.starts[k], 0), np.where(hit, self.starts[k + 1], 0)

    def phrase(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the terms (given by their postings) follow each other: the position of the first one."""
        order = np.argsort(end - begin, kind="stable")
        found: np.ndarray | None = None
        for i in order:
            own = self.postings[begin[i] : end[i]].astype(np.int64) - i
            found = own if found is None else found[member(found, own)]
            if not len(found):
                break
        return np.zeros(0, np.int64) if found is None else found

    def near(self, begin: np.ndarray, end: np.ndarray, slack: int) -> np.ndarray:
        """Where spans of the window's width and `slack` more begin that hold all its terms, in any order and as often as the window; each begins with one of them.

        From the rarest term on, of the places that are left those stay from which a term comes often enough before the span ends.
        """
        width = len(begin) + slack
        own, times = np.unique(np.stack((begin, end), axis=1), axis=0, return_counts=True)  # a term's postings are its name
        order = np.argsort(own[:, 1] - own[:, 0], kind="stable")
        rarest = self.postings[own[order[0], 0] : own[order[0], 1]].astype(np.int64)
        places = np.unique(np.concatenate([self.postings[a:b].astype(np.int64) for a, b in own]))
        at = np.searchsorted(rarest, places)
        places = places[(at < len(rarest)) & (rarest[np.minimum(at, len(rarest) - 1)] < places + width)] if len(rarest) else places[:0]
        for k in order:
            these = self.postings[own[k, 0] : own[k, 1]].astype(np.int64)
            last = np.searchsorted(these, places) + times[k] - 1
            places = places[(last < len(these)) & (these[np.minimum(last, len(these) - 1)] < places + width)] if len(these) else places[:0]
        return places

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def row(self, docs: bytes) -> list[bytes]:
        return [docs, self.words.tobytes(), self.first.tobytes(), self.terms.tobytes(), self.starts.tobytes(), self.postings.tobytes()]

    @classmethod
    def of_row(cls, row: dict) -> Segment:
        view = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        return cls(view("terms", np.uint64), view("starts", np.int64), view("postings", np.uint32), view("words", np.int64), view("first", np.int64))


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The term hashes of all texts in turn, and how many each has."""
    raw, offsets = text_buffer(column)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(part, own, ALNUM_WORDS)
        hashes.append(word_hashes(part, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.concatenate(counts)


def write_index(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, tables: Tables | None = None) -> DataFrame:
    """Build and store the index of all whole texts; a null text has no terms.

    `vocabulary`: a file of sorted term hashes in the shared folder; other terms are then counted, but not stored.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _array(vocabulary) if vocabulary else None
        for whole in batches:
            for i, j in chunks(text_buffer(whole[text])[1], SEGMENT_BYTES):
                batch = whole.slice(i, j - i)
                segment = Segment.build(*terms_of(batch[text]), known)
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, pa.schema([(key, batch[key].type)])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([batch[key]], names=[key]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in segment.row(sink.getvalue())], names=[x.split()[0] for x in _SEGMENT.split(", ")])

    return (tables or Tables(docs.sparkSession)).write(docs.select(key, text).mapInArrow(build, _SEGMENT), "index")


def write_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[list[str], str]:
    """Store the test items as blocks of bounded size in the shared folder, and the sorted hashes of all their terms.

    The items are the stated query set; they pass through the driver a block at a
    time, and every task reads the blocks one after the other. Items without words are left out.
    """
    folder = new_path(items.sparkSession, "items")
    paths: list[str] = []
    known = np.zeros(0, np.uint64)
    block: list[tuple[object, np.ndarray]] = []

    def flush() -> None:
        nonlocal known
        path = f"{folder}/block-{len(paths):05d}.npz"
        sink = io.BytesIO()
        np.savez(sink, ids=np.array(["null" if k is None else str(k) for k, _ in block]), sizes=np.array([len(t) for _, t in block], np.int64), terms=np.concatenate([np.zeros(0, np.uint64), *(t for _, t in block)]))
        with Output(path) as out:
            out.write(sink.getvalue())
        paths.append(path)
        known = np.union1d(known, np.concatenate([np.zeros(0, np.uint64), *(t for _, t in block)]))

    size = 0
    for row in items.select(key, text).toLocalIterator():
        terms = terms_of(pa.array([row[1] or ""]))[0]
        if len(terms):
            block.append((row[0], terms))
            size += len(terms)
        if size >= BLOCK_TERMS:
            flush()
            block, size = [], 0
    if block or not paths:
        flush()
    sink = io.BytesIO()
    np.savez(sink, terms=known)
    with Output(f"{folder}/vocabulary.npz") as out:
        out.write(sink.getvalue())
    return paths, f"{folder}/vocabulary.npz"


@lru_cache(maxsize=2)
def _array(path: str) -> np.ndarray:
    with open_input(path) as f:
        return np.load(io.BytesIO(f.read()))["terms"]


@lru_cache(maxsize=1)
def _block(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    with open_input(path) as f:
        got = np.load(io.BytesIO(f.read()))
    return got["ids"].tolist(), got["sizes"], got["terms"]


def matches(segment: Segment, block: tuple[list[str], np.ndarray, np.ndarray], width: int = WINDOW, slack: int | None = None) -> Iterator[tuple[str, int, np.ndarray]]:
    """(item, terms in the window, positions) for every window that occurs; with `slack` proximity instead of phrases."""
    ids, sizes, terms = block
    begin, end = segment.find(terms)
    there = end > begin
    if not there.any():
        return
    at = np.cumsum(sizes) - sizes
    run = np.concatenate(([0], np.cumsum(there)))
    for item, start, n in zip(ids, at.tolist(), sizes.tolist()):
        w = min(width, n)
        first = np.arange(start, start + n - w + 1)
        for s in first[run[first + w] - run[first] == w].tolist():
            b, e = begin[s : s + w], end[s : s + w]
            found = segment.phrase(b, e) if slack is None else segment.near(b, e, slack)
            if len(found):
                yield item, w, found


def search(index: DataFrame, blocks: list[str], key: str = "doc_id", key_type: str = "long", width: int = WINDOW, slack: int | None = None) -> DataFrame:
    """Rows (key, n_words, n_hit, items) for every indexed document: words inside any occurrence, and the items that occur, ascending as text.

    With `slack` also `near`, the proximity matches: items and the ascending places, from 0 in the document, where spans of
    the width of one of their windows and `slack` more begin that hold all its terms (see `Segment.near`).
    """
    if slack is not None and not 0 <= slack < GAP - width + 1:
        raise ValueError(f"slack must be from 0 to {GAP - width}, or places reach into other documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.of_row(row)
                keys = pa.ipc.open_stream(row["docs"]).read_next_batch()[key]
                hits: list[np.ndarray] = []
                items: dict[int, set[str]] = {}
                near: dict[int, set[tuple[str, int]]] = {}
                for path in blocks:
                    for item, w, found in matches(segment, _block(path), width):
                        hits.append((found[:, None] + np.arange(w)).ravel())
                        for d in np.unique(segment.document(found)).tolist():
                            items.setdefault(d, set()).add(item)
                    if slack is not None:
                        for item, _, found in matches(segment, _block(path), width, slack):
                            docs = segment.document(found)
                            for d, at in zip(docs.tolist(), (found - segment.first[docs]).tolist()):
                                near.setdefault(d, set()).add((item, at))
                n_hit = np.zeros(len(segment.words), np.int64)
                if hits:
                    inside = np.unique(np.concatenate(hits))
                    n_hit += np.bincount(segment.document(inside), minlength=len(n_hit))
                columns = [keys, pa.array(segment.words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(len(n_hit))], pa.list_(pa.string()))]
                if slack is not None:
                    places = [[{"item": item, "at": at} for item, at in sorted(near.get(d, ()))] for d in range(len(n_hit))]
                    columns.append(pa.array(places, pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_hit", "items", "near"][: len(columns)])

    return index.mapInArrow(run, f"`{key}` {key_type}, n_words long, n_hit long, items array<string>" + (", near array<struct<item: string, at: long>>" if slack is not None else ""))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, tables: Tables | None = None) -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated) for every document.

    A document without words isn't contaminated; repeated rows get a row each. Items
    with a null key count under the name `null`; items with equal keys as one.
    """
    blocks, vocabulary = write_windows(items, item_key, item_text)
    index = write_index(docs, key, text, vocabulary, tables)
    found = search(index, blocks, key, docs.schema[key].dataType.simpleString(), width)
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
