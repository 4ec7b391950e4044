"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string columns.

Both word definitions used by the operators split at ASCII bytes only, so whole
texts can be handled as one byte buffer: a polynomial over the bytes of a word,
read off two prefix sums, gives its 64-bit hash without a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; the temporary arrays take some 50 times as much.
CHUNK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: `[^\x20\x09-\x0D]+`: everything but blanks is part of a word.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: ASCII letters and digits and all bytes of other characters.
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[0x00:0x30] = False
ALNUM_WORDS[0x3A:0x61] = False
ALNUM_WORDS[0x7B:0x80] = False
#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: ASCII letters and all bytes of other characters.
LETTER_WORDS = np.ones(256, dtype=bool)
LETTER_WORDS[0x00:0x41] = False
LETTER_WORDS[0x5B:0x61] = False
LETTER_WORDS[0x7B:0x80] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end).

    `keep` has True for the bytes of words. Words never reach over the end of a text.
    """
    n = len(raw)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = keep[_LOWER[raw]]
    first = np.zeros(n + 1, dtype=bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside & first)
    last = np.zeros(n + 1, dtype=bool)
    last[:n] = ~inside[1:]
    ends_at = offsets[1:] - 1
    last[ends_at[(ends_at >= 0) & (ends_at < n)]] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, ASCII letters lower-cased. Further arrays of ends give further rows of hashes."""
    n = len(raw)
    if not len(starts):
        return np.zeros((1 + len(more), 0) if more else 0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[raw]] * _power("up", _MULT, n)[:n], out=total[1:])
        begin, scale = total[starts], _power("down", _INVERSE, n)[starts]
        rows = [mix((total[e] - begin) * scale) for e in (ends, *more)]
        return np.stack(rows) if more else rows[0]


def word_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves, ASCII letters lower-cased."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[at]])])


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all `width`-word shingles of one text; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            return mix(np.array([(words * _STEP[:n]).sum() + np.uint64(n)], dtype=np.uint64))
        out = words[: n - width + 1] * _STEP[0]
        for k in range(1, width):
            out = out + words[k : n - width + 1 + k] * _STEP[k]
        return mix(out + np.uint64(width))


def shingle_sets(column: pa.Array, width: int = 5, keep: np.ndarray = SPACE_WORDS) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingle hashes in ascending order."""
    raw, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(part, own, keep)
        words = word_hashes(part, starts, ends)
        for k in range(j - i):
            yield distinct(shingle_hashes(words[first[k] : first[k + 1]], width))


def distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def member(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    k = np.searchsorted(ascending, x)
    k[k == len(ascending)] = 0
    return ascending[k] == x
