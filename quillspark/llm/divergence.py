"""Divergence of sources within a language, over integer-coded terms.

The terms that a language keeps are sorted and cut into chunks, so that a term is a
chunk and a place in it and these order as the UTF-8 of the terms do. Tasks look the
distinct words of some megabytes of text up in the sorted terms by binary search and
count codes; only sums by group and code are shuffled. Sources are then compared chunk
by chunk as dense vectors, a tile of sources against another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import listing, open_input
from .util import Tables, rows_of, sized
from .words import LETTER_WORDS, chunks, text_buffer, word_bytes, word_spans

#: A language keeps the terms that are in so many of its documents.
LEAST_DOCUMENTS = 30
#: Added to every count, so that an absent term has a share too; shares are parts of UNIT.
ADDED = 5
UNIT = 1_000_000_000
#: Terms that are reported for a source.
TOP_TERMS = 50
#: Bytes of text that are counted at a time.
TEXT_BYTES = 8 << 20
#: Terms of the dictionary that a worker holds in memory; the texts are read once for each such part of it.
PART_TERMS = 8 << 20
#: Terms in a dense vector; sources in a tile, on average.
CHUNK_TERMS = 4096
TILE = 32


class Words:
    """The distinct words of some texts, and for every occurrence its word and its text."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_buffer(column)
        starts, ends, first = word_spans(raw, offsets, LETTER_WORDS)
        coded = word_bytes(raw, starts, ends).dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = np.repeat(np.arange(len(column)), np.diff(first))

    def sums(self, groups: np.ndarray, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, word, occurrences), with `groups` that of each text; `once`: a text counts a word once."""
        n = max(1, len(self.words))
        if once:
            pairs = np.unique(self.texts * n + self.codes)
            keys = groups[pairs // n] * n + pairs % n
        else:
            keys = groups[self.texts] * n + self.codes
        keys, counts = np.unique(keys, return_counts=True)
        return keys // n, keys % n, counts


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in chunks(text_buffer(batch[text])[1], TEXT_BYTES):
            yield batch.slice(i, j - i)


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    got = column.dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary


def document_frequencies(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (lang, term, documents), summed in each task over some megabytes of text and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, text):
            found, (codes, langs) = Words(batch[text]), _coded(batch[lang])
            g, w, n = found.sums(codes, once=True)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(g)), found.words.take(pa.array(w)).cast(pa.binary()), pa.array(n)], names=["lang", "term", "n"])

    rows = docs.select(F.coalesce(lang, F.lit("")).alias(lang), text).mapInArrow(run, "lang string, term binary, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("documents"))


def write_dictionary(kept: DataFrame, tables: Tables) -> DataFrame:
    """Rows (lang, chunk, place, term): a term's rank among its language's, cut into chunks. `kept` is a written table.

    Terms are sorted in ranges and counted in each; the sums over the ranges before give the ranks, so
    chunks are full however many ranges there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            places = []
            for lang in batch["lang"].to_pylist():
                n = n + 1 if lang == last else 0
                last = lang
                places.append(n)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), batch["term"]], names=["lang", "part", "n", "term"])

    with Tables(kept.sparkSession) as own:
        ranges = -(-max(1, rows_of(kept)) // PART_TERMS)
        ordered = kept.select("lang", "term").repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
        ordered = own.write(ordered.mapInArrow(run, "lang string, part int, n long, term binary"), "ordered")
        before = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sizes = ordered.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
        starts = own.write(sizes.select("lang", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "starts", rows_of(ordered))
        rank = F.col("start") + F.col("n")
        ranked = ordered.join(sized(starts), ["lang", "part"]).select("lang", F.floor(rank / CHUNK_TERMS).alias("chunk"), (rank % CHUNK_TERMS).cast("int").alias("place"), "term")
        return tables.write(ranked, "dictionary")


def first_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first eight bytes of each word as a number that orders as they do; sizes, offsets and bytes."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes, out = np.diff(at), np.zeros(len(words), np.uint64)
    for i in range(8):
        there = sizes > i
        out[there] |= raw[at[:-1][there] + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out, sizes, at, raw


class Terms:
    """The kept terms of a language within a part of the dictionary, ascending."""

    def __init__(self, terms: pa.Array, chunk: np.ndarray, place: np.ndarray):
        self.keys, self.sizes, self.at, self.raw = first_bytes(terms)
        self.chunk, self.place = chunk, place

    def term(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i + 1]].tobytes()

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word among the terms, or -1. Words hold no zero bytes, so up to seven bytes the key is the word."""
        keys, sizes, at, raw = first_bytes(words)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = np.where((high > low) & (sizes < 8), low, -1)
        for i in np.flatnonzero((high > low) & (sizes >= 8)).tolist():
            word, a, b = raw[at[i] : at[i + 1]].tobytes(), int(low[i]), int(high[i])
            while a < b:
                middle = (a + b) // 2
                if self.term(middle) < word:
                    a = middle + 1
                else:
                    b = middle
            if a < high[i] and self.term(a) == word:
                out[i] = a
        return out


def parts_of(dictionary: DataFrame) -> list[tuple[str, ...]]:
    """The files of a written dictionary, as parts of at most PART_TERMS terms, or of one file with more."""
    parts: list[list[str]] = []
    held = PART_TERMS
    for path, _ in listing(dictionary._path, ".parquet"):
        with open_input(path) as f:
            n = pq.read_metadata(f).num_rows
        if n and held + n > PART_TERMS:
            parts.append([])
            held = 0
        if n:
            parts[-1].append(path)
            held += n
    return list(map(tuple, parts))


@lru_cache(maxsize=1)
def _load(paths: tuple[str, ...]) -> dict[str, Terms]:
    tables = []
    for path in paths:
        with open_input(path) as f:
            tables.append(pq.read_table(f))
    got = pa.concat_tables(tables).sort_by([("lang", "ascending"), ("chunk", "ascending"), ("place", "ascending")]).combine_chunks()
    codes, langs = _coded(got["lang"].combine_chunks())
    chunk, place, terms = got["chunk"].to_numpy(), got["place"].to_numpy(), pc.cast(got["term"], pa.large_binary()).combine_chunks()
    out: dict[str, Terms] = {}
    for i, lang in enumerate(langs.to_pylist()):
        a, b = np.searchsorted(codes, [i, i + 1])  # rows are sorted by language, so codes ascend
        out[lang] = Terms(terms.slice(a, b - a), chunk[a:b], place[a:b])
    return out


def count_terms(docs: DataFrame, part: tuple[str, ...], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (lang, source, chunk, place, n): sums over some megabytes of text of the terms in a part of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _load(part)
        for batch in _parts(batches, text):
            (of, langs), (own, sources) = _coded(batch[lang]), _coded(batch[source])
            found = Words(batch[text])
            g, w, n = found.sums(of * len(sources) + own)
            lang_of = g // len(sources)
            for i, name in enumerate(langs.to_pylist()):
                if name in known:
                    terms, mine = known[name], lang_of == i
                    code = terms.find(found.words)[w[mine]]
                    hit = code >= 0
                    code, group, count = code[hit], g[mine][hit], n[mine][hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]).take(pa.array(np.zeros(len(code), np.int64))), sources.take(pa.array(group % len(sources))), pa.array(terms.chunk[code]), pa.array(terms.place[code]), pa.array(count)],
                        names=["lang", "source", "chunk", "place", "n"],
                    )

    rows = docs.select(F.coalesce(lang, F.lit("")).alias(lang), F.coalesce(source, F.lit("")).alias(source), text)
    return rows.mapInArrow(run, "lang string, source string, chunk long, place int, n long")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / totals) for counts up to totals, three digits at a time, so that nothing overflows below 9 * 10^15."""
    out, left = counts // totals, counts % totals
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // totals, left % totals
    return 1 + out


_COMPARED = "lang string, source string, part string, item string, chunk long, place int, value long"


def compare(table: pa.Table) -> pa.Table:
    """A chunk of terms for two tiles of sources: summed differences of each pair, and within a tile the best terms of each source.

    Rows of place -1 name the sources, with their sum of counts in `n`; the one without a name is the whole language.
    """
    rows = {c: table[c].to_numpy() for c in ("tile", "place", "n", "size", "kept")}
    lang, chunk, ta, tb = (table[c][0].as_py() for c in ("lang", "chunk", "ta", "tb"))
    names = table["source"].to_pylist()
    head = np.flatnonzero(rows["place"] < 0)
    row_of = {names[i]: k for k, i in enumerate(head.tolist())}
    tile, total = rows["tile"][head], rows["n"][head]
    size, kept = (int(rows[c][head[0]]) for c in ("size", "kept"))
    counts = np.zeros((len(head), size), np.int64)
    codes, distinct = _coded(table["source"].combine_chunks().fill_null(""))  # the whole language is told from a source "" by its tile
    place_of = np.array([row_of.get(x, -1) for x in distinct.to_pylist()], np.int64)
    body, whole = rows["place"] >= 0, rows["tile"] < 0
    at = place_of[codes]
    if None in row_of:
        at[whole] = row_of[None]
    counts[at[body], rows["place"][body]] = rows["n"][body]
    p = shares(counts + ADDED, total[:, None] + ADDED * kept) if size else counts
    label = [names[i] for i in head.tolist()]
    left, right = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
    out: dict[str, list] = {c.split()[0]: [] for c in _COMPARED.split(", ")}

    def add(source: str, part: str, item: str | None, place: int | None, value: int) -> None:
        for c, x in zip(out, (lang, source, part, item, chunk, place, value)):
            out[c].append(x)

    for a in left.tolist():
        for b, value in zip(right.tolist(), np.abs(p[right] - p[a]).sum(axis=1).tolist()):
            if a != b:
                add(label[a], "pair", label[b], None, value)
                if ta != tb:
                    add(label[b], "pair", label[a], None, value)
    if ta == tb and size:
        q = p[row_of[None]]
        for a in left.tolist():
            f = p[a] - q
            good = np.flatnonzero((counts[a] > 0) & (f > 0))
            for k in good[np.argsort(-f[good], kind="stable")][:TOP_TERMS].tolist():
                add(label[a], "term", None, k, int(f[k]))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.table({c: pa.array(out[c], kinds[kind]) for c, kind in (x.split() for x in _COMPARED.split(", "))})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every source of every language.

    Part `pair`: each other source of the language and the summed difference of the shares of
    all kept terms, largest first; 0 where the language keeps no term. Part `term`: the
    kept terms that the source has a larger share of than the whole language, at most TOP_TERMS.
    Ties go by the UTF-8 of the item. A null lang, source or text is an empty one; a repeated row
    counts again; an empty table gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    with Tables(docs.sparkSession) as own:
        kept = own.write(document_frequencies(docs, lang, text).where(F.col("documents") >= least), "kept")
        dictionary = write_dictionary(kept, tables)
        counted = [count_terms(docs, part, lang, source, text) for part in parts_of(dictionary)]
        groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
        if not counted:
            counts = groups.limit(0).select("lang", "source", F.lit(0).cast("long").alias("chunk"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("n"))
        else:
            union = counted[0]
            for more in counted[1:]:
                union = union.unionByName(more)
            counts = union.groupBy("lang", "source", "chunk", "place").agg(F.sum("n").alias("n"))
        counts = own.write(counts, "counts")
        groups = own.write(groups, "groups")
        sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = dictionary.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("size"))
        sizes = own.write(sizes, "chunks", rows_of(dictionary))
        terms = sizes.groupBy("lang").agg(F.sum("size").alias("kept"))
        langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        langs = own.write(langs.join(terms, "lang", "left").na.fill(0, ["kept"]), "langs", rows_of(groups))
        own_tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
        known = own.write(groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total"]).join(sized(langs), "lang").withColumn("tile", own_tile), "sources", rows_of(groups))
        # a language without kept terms has one empty chunk
        per_lang = langs.join(sizes, "lang", "left").select("lang", "tiles", "kept", F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"), F.coalesce("size", F.lit(0)).alias("size"))
        per_lang = own.write(per_lang, "spread", rows_of(sizes) + rows_of(langs))
        fields = ("lang", "chunk", "tiles", "source", "tile", "place", "n", "size", "kept")
        nothing = [F.lit(0).alias("size"), F.lit(0).cast("long").alias("kept")]
        rows = counts.join(sized(known), ["lang", "source"]).select("lang", "chunk", "tiles", "source", "tile", "place", "n", *nothing)
        heads = known.drop("tiles", "kept").join(sized(per_lang), "lang").select("lang", "chunk", "tiles", "source", "tile", F.lit(-1).alias("place"), F.col("total").alias("n"), "size", "kept")
        spread = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        pairs = rows.select(*fields).unionByName(heads.select(*fields)).withColumn("other", spread)
        pairs = pairs.select("lang", "chunk", "source", "tile", "place", "n", "size", "kept", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"))
        # the whole language, for every tile against itself
        both = counts.groupBy("lang", "chunk", "place").agg(F.sum("n").alias("n")).join(sized(langs.select("lang", "tiles")), "lang")
        both = both.select("lang", "chunk", "tiles", "place", "n", *nothing)
        ends = sums.groupBy("lang").agg(F.sum("total").alias("n")).join(sized(per_lang), "lang").select("lang", "chunk", "tiles", F.lit(-1).alias("place"), "n", "size", "kept")
        every = both.unionByName(ends).withColumn("ta", spread)
        every = every.select("lang", "chunk", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("tile"), "place", "n", "size", "kept", "ta", F.col("ta").alias("tb"))
        compared = pairs.unionByName(every).groupBy("lang", "chunk", "ta", "tb").applyInArrow(compare, _COMPARED)
        parts = tables.write(compared, "compared")
    within = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(within))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "place")
    term = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS).drop("item")
    named = term.join(dictionary.select("lang", "chunk", "place", F.col("term").cast("string").alias("item")), ["lang", "chunk", "place"])
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).unionByName(named.select(columns))
