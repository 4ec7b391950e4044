"""Byte-level BPE encoding and decoding over Arrow batches.

The `tokenizers` library merges each pre-token: its bytes are mapped to printable
characters one by one, so that the library's character offsets are byte offsets.
Decoding reverses the byte table; ids may end or begin inside a character, so it
yields bytes, and only `to_text` decides what becomes of split characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .pretokens import full_pattern, is_plain, plain_pattern

#: Pre-tokens that a worker keeps with their ids.
CACHE_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """Byte to printable character: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


_TABLE = {b: c for b, c in enumerate(byte_characters())}
_REVERSE = {c: b for b, c in _TABLE.items()}


def to_characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TABLE)


def to_bytes(mapped: str) -> bytes:
    return bytes(_REVERSE[c] for c in mapped)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merge that makes each token, in the order of ranks: what is left of it under all lower ranks."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found.append((to_characters(parts[0]), to_characters(parts[1])))
    return found


class Codec:
    """Encoder and decoder of one rank file; one lives in each worker process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        vocab = {to_characters(t): r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges_of(ranks), ignore_merges=True, cache_capacity=0))
        self.pattern = full_pattern(pattern)
        self.plain = plain_pattern().findall if pattern == public_tokenizers.PATTERN else None
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.cache = _Cache(self.tokenizer)

    def pieces(self, text: str) -> list[str]:
        if self.plain is not None and is_plain(text):
            return self.plain(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.pieces(text))), dtype="<u4")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The first byte of every token in the text's UTF-8."""
        return np.cumsum(self.lengths[ids]) - self.lengths[ids]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()

    @staticmethod
    def to_text(raw: bytes, errors: str = "replace") -> str:
        """Decoded bytes as text; characters split by the ends of the ids are replaced, or raise with `strict`."""
        return raw.decode("utf-8", errors)


class _Cache(dict):
    """Ids of pre-tokens. The first ones stay, for frequent ones come early; after many misses it starts anew."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.merge, self.misses = tokenizer.model.tokenize, 0

    def __missing__(self, piece: str) -> bytes:
        got = b"".join([t.id.to_bytes(4, "little") for t in self.merge(to_characters(piece.encode()))])
        if len(self) >= CACHE_ENTRIES:
            self.misses += 1
            if self.misses < 8 * CACHE_ENTRIES:
                return got
            self.clear()
            self.misses = 0
        self[piece] = got
        return got


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some 4 MB of text each."""
    from .words import chunks, text_buffer

    for i, j in chunks(text_buffer(batch[column])[1], limit):
        yield batch.slice(i, j - i)


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add the token ids of each whole text, and if named the byte offsets of the tokens.

    A null or empty text has no ids; repeated rows get equal ids. Other columns
    stay; one that clashes with `ids` or `offsets` is replaced.
    """
    extra = {ids: "array<int>"} | ({offsets: "array<long>"} if offsets else {})
    kept = [c for c in df.columns if c not in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text):
                found = [own.encode(x or "") for x in batch[text].to_pylist()]
                columns = [batch[c] for c in kept] + [_lists(found, pa.int32())]
                if offsets:
                    columns.append(_lists([own.offsets(x) for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *extra])
        own.cache.clear()  # workers live on, with other operators beside them

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{c}` {t}" for c, t in extra.items()])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null or empty ids give empty bytes; a column named `out` is replaced."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)) for x in batch[ids]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(raw, pa.binary())], names=[*kept, out])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` binary"])
    return df.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def round_trip(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and return digests: key, n_tokens, ids_sha256, decoded_sha256, lossless.

    Nulls and empty texts have no tokens and the digests of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text):
                n, ids_hash, raw_hash, same = [], [], [], []
                for x in batch[text].to_pylist():
                    ids = own.encode(x or "")
                    raw = own.decode(ids)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    raw_hash.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == (x or "").encode())
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string()), pa.array(same, pa.bool_())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])
        own.cache.clear()  # workers live on, with other operators beside them

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
