"""Byte-level BPE vocabularies: pre-tokens found on code-point arrays, merges applied rank by rank."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from rulefold.llm.text_arrays import hash_spans

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
# The Unicode characters with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that a single apostrophe takes with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[WHITE_SPACE] = WHITE
    return out


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of several texts laid end to end; each ends where the next one starts.

    Runs of letters, of numbers and of other characters take one space before them along; of white space before
    such a run all but the last character stands alone, and the last too unless it is a space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]  # a run starts
    begins = run[:n].copy()
    white = kind == WHITE
    last = white & np.append(~white[1:], True) & ~edge[1 : n + 1]  # the last white character before another run
    begins |= last
    taken = np.flatnonzero(last & (points == 0x20))
    begins[taken + 1] = False  # the run goes with its space
    # a lone apostrophe takes its ending along
    lone = np.flatnonzero(begins & (points == 0x27))
    lone = lone[(lone + 1 < n)]
    lone = lone[run[lone + 1] & ~edge[lone + 1]]
    for ending in ENDINGS:
        k = len(ending)
        at = lone[lone + k < n]
        good = np.ones(len(at), bool)
        for j, c in enumerate(ending, 1):
            good &= (points[at + j] == ord(c)) & ~edge[at + j]
        at = at[good]
        begins[at + 1] = False
        follow = at + k + 1
        follow = follow[follow < n]
        follow = follow[~edge[follow] & (kind[follow] == LETTER)]
        begins[follow] = True
    return np.flatnonzero(begins)


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file in JSON."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[letter[b]] for b in range(256)], np.uint32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_ids = np.array([t["id"] for t in spec.get("added_tokens", [])], np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.uint32)
        self._index((left << np.uint64(32)) | right)

    def _index(self, keys: np.ndarray) -> None:
        """An open table from a pair of symbols to its rank, with free places beside the taken ones."""
        bits = max(int(len(keys) * 8).bit_length(), 8)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slot, rank, self.probes = self._slot(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.ranks[slot] == NONE)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.ranks[slot] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NONE)]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of symbols that remain of each byte span when every span's lowest-ranked pair is merged until none is left.

        All spans are one ragged array. A round ranks all neighbouring pairs, takes each span's lowest rank and merges its
        occurrences from left to right; spans without a pair to merge leave with their length.
        """
        return self.merged_ids(data, starts, lengths)[0]

    def merged_ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `merge`, with the symbols of all spans end to end."""
        out = lengths.astype(np.int64).copy()
        row = np.flatnonzero(out == 1)
        done = [(row, out[row], self.byte_ids[data[starts[row]]])]
        row = np.flatnonzero(out > 1)
        size = out[row]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(starts[row] - first, size)
        symbols = self.byte_ids[data[at]]
        while len(row):
            pairs = np.full(len(symbols), NONE, np.int32)
            pairs[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            pairs[first + size - 1] = NONE  # a span's last symbol has no right neighbour
            lowest = np.minimum.reduceat(pairs, first)
            hit = pairs == np.repeat(lowest, size)
            hit &= pairs != NONE
            if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: every second place of such a chain
                place = np.flatnonzero(hit)
                chain = np.append(True, np.diff(place) > 1)
                begin = np.maximum.accumulate(np.where(chain, np.arange(len(place)), 0))
                hit[place[(np.arange(len(place)) - begin) % 2 == 1]] = False
            symbols[hit] = self.merged[pairs[hit]]
            keep = np.ones(len(symbols), bool)
            keep[np.flatnonzero(hit) + 1] = False
            size = np.add.reduceat(keep.astype(np.int64), first)
            out[row] = size
            symbols = symbols[keep]
            live = (lowest != NONE) & (size > 1)
            stays = np.repeat(live, size)
            done.append((row[~live], size[~live], symbols[~stays]))
            symbols, row, size = symbols[stays], row[live], size[live]
            first = np.cumsum(size) - size
        place = np.cumsum(out) - out
        ids = np.empty(int(out.sum()), np.uint32)
        for rows, sizes, found in done:
            ids[np.repeat(place[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(found))] = found
        return out, ids


NONE = np.int32(2**31 - 1)


@lru_cache(4)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def parts(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, the text each belongs to, and the special string after it (-1: none)."""
    if not any(s in t for s in special for t in texts):
        return texts, np.arange(len(texts)), np.full(len(texts), -1)
    out, owner, after = [], [], []
    for i, text in enumerate(texts):
        while True:
            at, _, k = min(((text.find(s), -len(s), k) for k, s in enumerate(special) if s in text), default=(-1, 0, -1))
            out.append(text if k < 0 else text[:at])
            owner.append(i)
            after.append(k)
            if k < 0:
                break
            text = text[at + len(special[k]) :]
    return out, np.array(owner), np.array(after)


class Pieces:
    """The pre-tokens of several texts: each one's text, and the distinct ones by a 64-bit hash of their bytes."""

    def __init__(self, texts: list[str], special: list[str]) -> None:
        cut, self.owner, self.after = parts(texts, special)
        self.joined = "".join(cut)
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in cut])]).astype(np.int64)
        self.starts = pretokens(points, offsets)
        self.counts = np.diff(np.searchsorted(self.starts, offsets))  # pre-tokens of each part
        self.data = np.frombuffer(self.joined.encode(), np.uint8)
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        self.ends = np.append(self.starts[1:], len(points))
        place = np.append(0, np.cumsum(width))
        begin = place[self.starts]
        length = place[self.ends] - begin
        hashes = hash_spans(self.data, begin, length)
        self.hashes, self.first, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.begin, self.length = begin[self.first], length[self.first]

    def text(self, k: int) -> str:
        """The k-th distinct pre-token."""
        at = self.first[k]
        return self.joined[self.starts[at] : self.ends[at]]
