"""Texts of an Arrow batch as numpy arrays of bytes, words and 64-bit hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so they are the words `[^\\x20\\x09-\\x0D]+` of the text.
Equality of spans is equality of 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000  # bytes handled at once; a longer text is a chunk of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on its own copy."""
    x = x ^ (x >> _U(30))
    x *= _B
    x ^= x >> _U(27)
    x *= _C
    x ^= x >> _U(31)
    return x


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * _A + right)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are about `size` bytes together."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + length], eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = lengths.astype(np.int64)
    blocks = np.maximum((lengths + 7) >> 3, 1)
    if blocks.max() == 1:
        h = mix((eights[starts] & _TAIL[lengths]) + _A)
    else:
        first = np.cumsum(blocks) - blocks
        k = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
        at = np.repeat(starts, blocks) + 8 * k
        left = np.clip(np.repeat(lengths, blocks) - 8 * k, 0, 8)
        h = mix((eights[at] & _TAIL[left]) + (k + 1).astype(np.uint64) * _A)
        h = np.add.reduceat(h, first)
    return mix(h + lengths.astype(np.uint64) * _C)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and the number of the first word of each text (one more at the end); `gap` tells the bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~gap[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - starts + 1
    return starts, lengths, np.searchsorted(starts, offsets)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    out = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        out = join_hash(out, words[k : k + len(out)])
    return out


def inside(firsts: np.ndarray, n: int) -> np.ndarray:
    """True for each place whose n words lie in one text; `firsts` are those of `word_spans`."""
    total = int(firsts[-1])
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
    return left[: max(total - n + 1, 0)] >= n


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (start, end) of equal neighbours; none for an empty array."""
    if not len(values):
        return []
    bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def joined_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """`n` strings: the words of each owner, which come in order, with one space between them."""
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    size = lengths + ~first  # a space before every word but the first
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    source = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out[source + np.repeat(ends - lengths - starts, lengths)] = data[source]
    bounds = np.append(0, np.cumsum(np.bincount(owner, size, n))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())
