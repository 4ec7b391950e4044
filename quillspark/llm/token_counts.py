"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the most frequent pre-tokens of the whole corpus and
their token counts. It has a fixed size, so it can be broadcast at any scale. It is
found by mergeable heavy-hitter summaries: each task keeps a bounded summary of its
own pre-tokens, and whole summaries (never pre-tokens) are merged level by level.
Tier two is a bounded cache in each worker, filled by the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import _slices, to_characters
from .pretokens import is_plain, plain_pattern

#: Entries of a summary and of the broadcast table; summaries merged at once; entries of a worker's cache.
TABLE_ENTRIES = 32_768
FAN_IN = 32
CACHE_ENTRIES = 400_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class Pretokens:
    """The pre-tokens of texts in any script: by a pattern where all characters are ones on whose class every Unicode version agrees, else by the library."""

    def __init__(self, path: str):
        self.plain, self.other = plain_pattern().findall, tokenizer(path).pre_tokenizer.pre_tokenize_str

    def __call__(self, x: str) -> list[str]:
        return self.plain(x) if is_plain(x) else [x[a:b] for _, (a, b) in self.other(x)]


def trimmed(counts: Counter, entries: int) -> Counter:
    """The heaviest entries, less the weight of the heaviest one left out, as mergeable summaries need."""
    if len(counts) <= entries:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    cut = int(np.partition(values, len(values) - entries - 1)[len(values) - entries - 1])
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _pack(counts: Counter) -> bytes:
    return zlib.compress(pickle.dumps(list(counts.items())), 1)


def _unpack(blob: bytes) -> dict:
    return dict(pickle.loads(zlib.decompress(blob)))


def frequent_pretokens(df: DataFrame, path: str, text: str = "text", entries: int = TABLE_ENTRIES) -> list[str]:
    """At most `entries` pre-tokens of the whole column, those over 1/entries of all certainly among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Pretokens(path), Counter()
        for whole in batches:
            for batch in _slices(whole, text):
                for x in batch[text].to_pylist():
                    if x:
                        counts.update(split(x))
                if len(counts) > 8 * entries:
                    counts = trimmed(counts, entries)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([_pack(trimmed(counts, entries))], pa.binary())], names=["part", "summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = Counter(), None
        for batch in batches:
            for p, blob in zip(batch["part"].to_pylist(), batch["summary"].to_pylist()):
                part = p if part is None else min(part, p)
                counts.update(_unpack(blob))
                counts = trimmed(counts, entries)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part // FAN_IN], pa.int64()), pa.array([_pack(counts)], pa.binary())], names=["part", "summary"])

    schema = "part long, summary binary"
    parts = df.select(text).mapInArrow(summarise, schema)
    n = max(1, df.rdd.getNumPartitions())
    while n > 1:
        n = -(-n // FAN_IN)
        parts = (parts.repartitionByRange(n, F.floor(F.col("part") / FAN_IN)) if n > 1 else parts.repartition(1)).mapInArrow(merge, schema)
    got = parts.collect()  # one summary of bounded size
    return sorted(_unpack(got[0]["summary"])) if got else []


class _Lengths(dict):
    """Token counts of pre-tokens. Misses are encoded and kept, up to a bound; after many more it starts anew."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.table, self.merge, self.misses = table, tokenizer(path).model.tokenize, 0

    def __missing__(self, piece: str) -> int:
        got = len(self.merge(to_characters(piece.encode())))
        if len(self) >= CACHE_ENTRIES + len(self.table):
            self.misses += 1
            if self.misses < 8 * CACHE_ENTRIES:
                return got
            self.clear()
            self.update(self.table)
            self.misses = 0
        self[piece] = got
        return got


def pack_table(path: str, pretokens: list[str]) -> bytes:
    """The compact table: the pre-tokens, and one byte or more for the token count of each."""
    encoded = tokenizer(path).encode_batch(pretokens, add_special_tokens=False)
    lengths = np.array([len(e.ids) for e in encoded], dtype=np.uint32)
    return zlib.compress(pickle.dumps((pretokens, lengths)), 6)


_own: dict[tuple[str, int], _Lengths] = {}


def _lengths(path: str, blob: bytes) -> _Lengths:
    key = (path, zlib.crc32(blob))
    if key not in _own:
        _own.clear()
        words, lengths = pickle.loads(zlib.decompress(blob))
        _own[key] = _Lengths(path, dict(zip(words, lengths.tolist())))
    return _own[key]


class Counts:
    """Token counts of texts, as the library gives them. Only texts with special strings are encoded whole, `whole` of them so far."""

    def __init__(self, path: str, lengths: dict[str, int]):
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.lengths, self.split, self.encode, self.whole = lengths, Pretokens(path), tokenizer(path).encode, 0

    def __call__(self, x: str) -> int:
        if any(s in x for s in self.special):
            self.whole += 1
            return len(self.encode(x, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, self.split(x)))


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024, entries: int = TABLE_ENTRIES) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit) for every whole text, as the tokenizer file counts them.

    Null and empty texts have no bytes and no tokens. Special strings in a text are
    cut out first and count as the library counts them. Null keys and repeated rows have a row each; an empty table
    gives none; other columns are not read. Executors need the tokenizer file at the same path.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(pack_table(path, frequent_pretokens(df, path, text, entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(path, _lengths(path, table.value))
        for whole in batches:
            for batch in _slices(whole, text):
                texts = [x or "" for x in batch[text].to_pylist()]
                sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
                counts = list(map(count, texts))
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
