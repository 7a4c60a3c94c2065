"""Repeated passages by suffix arrays: maximal repeat groups of at least `least` bytes, and removal of all but the first occurrence."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import col, give_back, written
from rulefold.llm.text_arrays import chunks, hash_spans, join_hash, mix, utf8

_U = np.uint64
PIECE = 400_000  # bytes whose anchors are found at once
LAST = 2**63 - 1  # stands for a null id: after all others


@dataclass(frozen=True)
class Settings:
    least: int = 100  # bytes of a repeat
    gram: int = 24  # bytes of an anchor
    batch: int = 3000  # contexts in one suffix array
    ranges: int = 6  # of places of an anchor in a window, each with a part that all its windows have
    group: int = 24_000  # contexts with one anchor in one suffix array; larger groups are joined by windows
    buckets: int = 1 << 20  # of hashes of ids, broadcast to leave out documents without repeats

    @cached_property
    def reach(self) -> int:
        """Bytes before an anchor that a window holding it can start."""
        return self.least - self.gram

    @property
    def width(self) -> int:
        return self.reach + self.least


# --- anchors ------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, by doubling."""
    h = mix(np.arange(256, dtype=np.uint64) + _U(11))[data]
    out, length, part, size = None, 0, h, 1
    while True:
        if k & size:  # the longer part goes on the right of what is there
            right = part[length:]
            out = part if out is None else out[: len(right)] * _odd(size + 1) + right
            length += size
        size *= 2
        if size > k:
            return mix(out[: max(len(data) - k + 1, 0)])
        half = size // 2
        part = part[: max(len(part) - half, 0)] * _odd(size) + part[half:]


def _odd(n: int) -> np.uint64:
    return mix(np.array([n], np.uint64))[0] | _U(1)


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + n] for every full window."""
    size, out = 1, x
    while size * 2 <= n:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if n > size else out


def anchors(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of grams that are least within some window of `least` bytes of a text.

    Which gram of a window is least depends on the window's bytes alone, so equal windows have equal anchors in equal places.
    """
    n = len(data)
    if n < s.least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, s.gram) | _U(1)  # never 0, which marks windows across two texts
    low = _sliding(h, s.reach + 1, np.minimum)  # for each start of a window
    valid = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= s.least
    valid[offsets[:-1][long]] += 1
    valid[offsets[1:][long] - s.least + 1] -= 1
    low = np.where(np.cumsum(valid)[: len(low)] > 0, low, _U(0))
    padded = np.concatenate([np.zeros(s.reach, np.uint64), low, np.zeros(s.reach, np.uint64)])
    high = _sliding(padded, s.reach + 1, np.maximum)[: len(h)]
    at = np.flatnonzero(high == h)
    return at, h[at]


# --- suffix arrays ------------------------------------------------------------------------------------------------


def enhanced_suffix_array(rows: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least `least` bytes of all rows in order, as row * width + column, and each one's common prefix with the next.

    `rows` is a matrix of bytes; a row ends after its length. Ranks of 7, 14, 28, ... bytes come from sorting pairs of ranks of
    half as many; they order the suffixes and, halved again, measure common prefixes.
    """
    n, width = rows.shape
    symbols = np.where(np.arange(width) < lengths[:, None], rows.astype(np.uint16) + np.uint16(1), np.uint16(0))
    key = np.zeros((n, width), np.uint64)
    for j in range(7):
        key[:, : width - j] |= symbols[:, j:].astype(np.uint64) << _U(9 * (6 - j))
    levels, size = [], 7
    rank = _dense(key)
    del key
    levels.append((size, rank))
    while 2 * size < width:
        rank = _dense(_pairs(rank, size))
        size *= 2
        levels.append((size, rank))
    row, column = np.nonzero(np.arange(width) + least <= lengths[:, None])
    at = row * width + column
    order = np.argsort(_pairs(rank, size).ravel()[at])
    at, left = at[order], (lengths[row] - column)[order]
    a, b, most = at[:-1].copy(), at[1:].copy(), np.minimum(left[:-1], left[1:])
    common = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        flat = rank.ravel()
        go = np.flatnonzero(common + size <= most)
        go = go[flat[a[go] + common[go]] == flat[b[go] + common[go]]]
        common[go] += size
    flat = symbols.ravel()
    for _ in range(6):
        go = np.flatnonzero(common < most)
        go = go[flat[a[go] + common[go]] == flat[b[go] + common[go]]]
        common[go] += 1
    return at, common


def _pairs(rank: np.ndarray, size: int) -> np.ndarray:
    """Rank of each place and of that `size` places on, in one key."""
    pair = rank.astype(np.uint64) << _U(32)
    pair[:, : max(rank.shape[1] - size, 0)] |= rank[:, size:].astype(np.uint64)
    return pair


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the keys, equal for equal keys."""
    flat = keys.ravel()
    order = np.argsort(flat)
    flat = flat[order]
    step = np.append(True, flat[1:] != flat[:-1])
    del flat
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out.reshape(keys.shape)


def repeat_groups(at: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """Maximal repeats as rows (first, last, length): the suffixes at[first..last] share `length` bytes, at least `least`, and no more to either side.

    `before` has the byte before each suffix of `at`, or a negative number of its own where there is none. Stretches of the array with
    common prefixes of at least `least` are the topmost intervals. One whose suffixes all have one byte before them extends to the left
    with all that is nested in it, and is passed by. One without nested intervals is a group as it stands; the others are scanned.
    """
    inside = common >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    changes = np.append(0, np.cumsum(inside & (before[1:] != before[:-1])))
    diverse = changes[stop] > changes[start]
    start, stop = start[diverse], stop[diverse]
    steps = np.append(0, np.cumsum(common[1:] != common[:-1]))
    flat = steps[stop - 1] == steps[start]
    found = [np.stack([start[flat], stop[flat], common[start[flat]]], 1)]
    for a, b in zip(start[~flat].tolist(), stop[~flat].tolist(), strict=True):
        found.append(np.frombuffer(_scan(common[a:b].tolist(), before[a : b + 1].tolist(), a), np.int64).reshape(-1, 3))
    return np.concatenate(found)


def _scan(values: list[int], chars: list[int], start: int) -> array:
    """The stack scan of a common-prefix interval tree, bottom up: intervals whose suffixes have different bytes before them, three numbers each."""
    out = array("q")
    stack: list[list] = []  # open intervals: length, first suffix, the byte before all its suffixes or None
    for k, value in enumerate([*values, 0]):
        first, char = start + k, chars[k]
        while stack and stack[-1][0] > value:
            length, first, of_all = stack.pop()
            char = of_all if of_all == char else None
            if char is None:
                out.extend((first, start + k, length))
        if stack and stack[-1][0] == value:
            if stack[-1][2] != char:
                stack[-1][2] = None
        elif value:
            stack.append([value, first, char])
    return out


# --- tasks --------------------------------------------------------------------------------------------------------

BLOCK = "bucket int, kind int, anchor binary, tag binary, id binary, text binary, start binary, length binary, offset binary, bytes binary"
SPANS = "id bigint, text bigint, spans binary"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy()


def _text_tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each text: with the id, it names a document."""
    return hash_spans(data, offsets[:-1], np.diff(offsets)).view(np.int64)


def _spans(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Per document the merged spans, as pairs of 64-bit numbers."""
    if not len(ids):
        return []
    order = np.lexsort((starts, texts, ids))
    ids, texts, starts, ends = ids[order], texts[order], starts[order], ends[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))
    shift = np.cumsum(new) << 40  # documents one after the other on one line
    reach = np.maximum.accumulate(ends + shift)
    opens = np.flatnonzero(np.append(True, (starts + shift)[1:] > reach[:-1]))
    pairs = np.stack([starts[opens], reach[np.append(opens[1:], len(ids)) - 1] - shift[opens]], 1)
    first = np.flatnonzero(new[opens])
    bounds = np.append(first, len(opens)).tolist()
    raw, at = pairs.tobytes(), opens[first]
    return [(i, t, raw[16 * a : 16 * b]) for i, t, a, b in zip(ids[at].tolist(), texts[at].tolist(), bounds[:-1], bounds[1:], strict=True)]


def _same_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes data[one : one + length] and data[other : other + length] are the same, pair by pair."""
    out = np.zeros(len(one), bool)
    for a, b in chunks(np.append(0, np.cumsum(length)), 1_000_000):
        n = length[a:b]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        differ = data[np.repeat(one[a:b], n) + step] != data[np.repeat(other[a:b], n) + step]
        out[a:b] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return out


def _repeats_previous(order: np.ndarray, keys: list[np.ndarray], data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each context in this order equals the one before it: hashes and lengths tell the candidates, their bytes decide."""
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in (*keys, length)])
    at = np.flatnonzero(same)
    same[at] = _same_bytes(data, start[order[at]], start[order[at - 1]], length[order[at]])
    return same


def _blocks(at: np.ndarray, columns: list[np.ndarray], body: tuple[np.ndarray, np.ndarray] | None, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, arrays...) of the given arrays dealt by `at`."""
    bucket = ((at >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist() if len(bucket) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        pick = order[a:b]
        yield int(bucket[a]), *[c[pick].tobytes() for c in columns], (body[0][pick][body[1][pick]].tobytes() if body else b"")


def _find(batches: Iterator[pa.RecordBatch], s: Settings, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts as blocks (bucket, anchor, id, text, place); an anchor's later places in a chunk are known to repeat and come as kind 1."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = _ids(batch)
        for i, j in chunks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            pieces = [(int(bounds[a]), *anchors(part[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], s)) for a, b in chunks(bounds, PIECE)]
            at, key = np.concatenate([p[1] + p[0] for p in pieces]), np.concatenate([p[2] for p in pieces])
            owner = np.searchsorted(bounds, at, "right") - 1
            tags = _text_tags(part, bounds)
            columns = [key, ids[i:j][owner], tags[owner], at - bounds[owner]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            more = np.append(~first[1:], False) if len(key) else first
            rows = []
            for kind, picked in ((0, order[first & ~more]), (1, order[first & more]), (2, order[~first])):
                rows += [(row[0], kind, *row[1:5]) for row in _blocks(columns[0][picked], [c[picked] for c in columns], None, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, FOUND[1], strict=True)], FOUND[0])
        give_back()


FOUND = (["bucket", "kind", "anchor", "id", "text", "place"], [pa.int32(), pa.int32(), *[pa.binary()] * 4])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the anchors that occur twice or more, one row per document."""
    for _, rows in _by_bucket(batches):
        kind = np.concatenate([np.full(len(r["anchor"]) // 8, r["kind"]) for r in rows])
        key, ids, texts, places = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("anchor", np.uint64), ("id", np.int64), ("text", np.int64), ("place", np.int64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = kind > 0
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        ids, texts, places = ids[hit], texts[hit], places[hit]
        order = np.lexsort((places, texts, ids))
        ids, texts, places = ids[order], texts[order], places[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])) if len(ids) else np.zeros(0, bool)
        bounds = np.append(np.flatnonzero(new), len(ids)).tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[new]), pa.array(texts[new]), pa.array([places[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "text", "places"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that arrive sorted by bucket, one bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if held and held[-1]["bucket"] != row["bucket"]:
                yield held[-1]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[-1]["bucket"], held


def _contexts(batches: Iterator[pa.RecordBatch], s: Settings, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes around repeated anchors, as blocks: all windows with the anchor lie in them. Equal ones of a chunk go on once; the others are spans."""
    for batch in batches:
        data, offsets = utf8(batch.column("body"))
        ids, places = _ids(batch), batch.column("places").to_pylist()
        for i, j in chunks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            tags = _text_tags(part, bounds)
            found = [(np.unique(np.concatenate([np.frombuffer(b, np.int64) for p in places[i + k] if p["text"] == tags[k] for b in p["places"]] or [np.zeros(0, np.int64)]))) for k in range(j - i)]
            owner = np.repeat(np.arange(j - i), [len(f) for f in found])
            place = np.concatenate(found)
            at = bounds[owner] + place
            start = np.maximum(at - s.reach, bounds[owner])
            length = np.minimum(at + s.least, bounds[owner + 1]) - start
            key = mix(hash_spans(part, at, np.full(len(at), s.gram)))
            body = hash_spans(part, start, length)
            order = np.lexsort((start, tags[owner], ids[i:j][owner], body, key))
            again = _repeats_previous(order, [key, body], part, start, length)
            late, picked = order[again], order[~again]
            rows = []
            for id_, text, spans in _spans(ids[i:j][owner[late]], tags[owner[late]], start[late] - bounds[owner[late]], start[late] - bounds[owner[late]] + length[late]):
                rows.append((int(id_) % buckets, 1, b"", b"", np.int64(id_).tobytes(), np.int64(text).tobytes(), spans, b"", b"", b""))
            owner, start, length = owner[picked], start[picked], length[picked]
            padded = np.append(part, np.zeros(s.width, np.uint8))
            grid = np.lib.stride_tricks.sliding_window_view(padded, s.width)[start]
            used = np.arange(s.width) < length[:, None]
            columns = [key[picked], body[picked], ids[i:j][owner], tags[owner], start - bounds[owner], length, at[picked] - start]
            rows += [(row[0], 0, *row[1:]) for row in _blocks(columns[0], columns, (grid, used), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 10, [pa.int32(), pa.int32(), *[pa.binary()] * 8], strict=True)],
                                             ["bucket", "kind", "anchor", "tag", "id", "text", "start", "length", "offset", "bytes"])
        give_back()


def _removed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from all contexts of a bucket; contexts of very large groups are handed on as they are (kind 2)."""
    for _, rows in _by_bucket(batches):
        yield _removed_of(rows, s)  # a bucket's arrays are gone before the next one is read
        give_back()


def _removed_of(all_: list[dict], s: Settings) -> pa.RecordBatch:
    rows = all_[:]
    all_.clear()  # what is joined below is not held twice
    out = [(0, np.frombuffer(r["id"], np.int64)[0].item(), np.frombuffer(r["text"], np.int64)[0].item(), r["start"], None) for r in rows if r["kind"]]
    rows = [r for r in rows if not r["kind"]]
    key, tag, ids, texts, start, length, offset = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (
        ("anchor", np.uint64), ("tag", np.uint64), ("id", np.int64), ("text", np.int64), ("start", np.int64), ("length", np.int64), ("offset", np.int64)))
    body = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    rows.clear()
    first_byte = np.cumsum(length) - length
    order = np.lexsort((start, texts, ids, tag, key))
    again = _repeats_previous(order, [key, tag], body, first_byte, length)
    late, one = order[again], order[~again]
    found = [(ids[late], texts[late], start[late], start[late] + length[late])]
    group = np.cumsum(np.append(False, key[one[1:]] != key[one[:-1]])) if len(one) else np.zeros(0, np.int64)
    size = np.bincount(group) if len(one) else np.zeros(0, np.int64)
    several = (size[group] > 1) & _shares_part(body, first_byte[one], length[one], offset[one], key[one], s)
    large = size[group] > s.group
    for k in one[large].tolist():
        out.append((2, int(ids[k]), int(texts[k]), np.int64(start[k]).tobytes(), body[first_byte[k] : first_byte[k] + length[k]].tobytes()))
    one, group = one[several & ~large], group[several & ~large]
    ends = np.append(np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1, []).astype(np.int64) if len(one) else np.zeros(0, np.int64)
    begin = 0
    for k, end in enumerate(ends.tolist()):
        if k + 1 == len(ends) or ends[k + 1] - begin > s.batch:
            pick = one[begin:end]
            found.append(_repeats(body, first_byte[pick], length[pick], ids[pick], texts[pick], start[pick], s))
            begin = end
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    out += [(0, id_, text, spans, None) for id_, text, spans in _spans(*columns)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)],
                                      ["kind", "id", "text", "spans", "bytes"])


def _shares_part(body: np.ndarray, first: np.ndarray, length: np.ndarray, offset: np.ndarray, key: np.ndarray, s: Settings) -> np.ndarray:
    """Whether a context can have a window in common with another one of its anchor.

    Windows that start a to b bytes before the anchor all have the bytes from a before it to `least` - b behind it. Equal windows have
    equal such bytes, so a context that shares none of these parts shares no window.
    """
    out = np.zeros(len(first), bool)
    step = -(-(s.reach + 1) // s.ranges)
    for a in range(0, s.reach + 1, step):
        b = min(a + step - 1, s.reach)
        there = np.flatnonzero((offset >= a) & (offset + s.least - b <= length))
        part = hash_spans(body, first[there] + offset[there] - a, np.full(len(there), a + s.least - b))
        part = join_hash(key[there], part)
        order = np.argsort(part)
        same = part[order[1:]] == part[order[:-1]]
        out[there[order[1:]][same]] = True
        out[there[order[:-1]][same]] = True
    return out


def _repeats(body: np.ndarray, first: np.ndarray, length: np.ndarray, ids: np.ndarray, texts: np.ndarray, start: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Spans of all occurrences but the first of the maximal repeat groups of some contexts, merged within each context.

    Groups are nested, so a suffix is in many; of those that remove it the longest is kept, which covers the others.
    """
    padded = np.append(body, np.zeros(s.width, np.uint8))
    width = int(length.max())
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first]
    at, common = enhanced_suffix_array(rows, length, s.least)
    row, column = at // width, at % width
    before = np.where(column > 0, rows[row, np.maximum(column - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    groups = repeat_groups(at, common, before, s.least)
    del common, before
    # suffixes in order of document and place; the smallest of each group is its first occurrence
    by_text = np.lexsort((texts, ids))
    document = np.empty(len(ids), np.int64)
    document[by_text] = np.cumsum(np.append(False, (ids[by_text[1:]] != ids[by_text[:-1]]) | (texts[by_text[1:]] != texts[by_text[:-1]])))
    rank = (document[row] << 40) + start[row] + column
    del row
    count = groups[:, 1] - groups[:, 0] + 1
    longest = np.zeros(len(at), np.int64)
    for a, b in chunks(np.append(0, np.cumsum(count)), 500_000):
        n = count[a:b]
        begin = np.cumsum(n) - n
        k = np.arange(int(n.sum())) + np.repeat(groups[a:b, 0] - begin, n)
        late = rank[k] != np.repeat(np.minimum.reduceat(rank[k], begin), n)
        np.maximum.at(longest, k[late], np.repeat(groups[a:b, 2], n)[late])
    ends = np.zeros(rows.shape, np.int32)
    ends.ravel()[at] = np.where(longest > 0, column + longest, 0)
    gone = np.zeros((len(rows), width + 2), np.int8)
    gone[:, 1:-1] = np.maximum.accumulate(ends, axis=1) > np.arange(width)
    edge = np.diff(gone, axis=1)
    (owner, opens), closes = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    return ids[owner], texts[owner], start[owner] + opens, start[owner] + closes


# --- tables -------------------------------------------------------------------------------------------------------


def _bucket(id_: Column, s: Settings) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(s.buckets)).cast("int")


def _near(rows: DataFrame, other: DataFrame, s: Settings, how: str) -> DataFrame:
    """The rows whose id may (left_semi) or cannot (left_anti) be one of `other`'s: a broadcast of at most `buckets` numbers, no shuffle."""
    buckets = F.broadcast(other.select(_bucket(F.col("id"), s).alias("bucket")).distinct())
    return rows.join(buckets, _bucket(F.col("id"), s) == F.col("bucket"), how)


def repeated_spans(rows: DataFrame, s: Settings) -> DataFrame:
    """Columns id, text, spans: what to remove of each document, from rows (id, body); spans of a document may be several rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    texts = rows.select("id", F.col("body").alias("text"))
    found = texts.mapInArrow(lambda b: _find(b, s, buckets), "bucket int, kind int, anchor binary, id binary, text binary, place binary")
    places = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "id bigint, text bigint, places binary")
    places = places.groupBy("id", "text").agg(F.collect_list("places").alias("places")).groupBy("id").agg(F.collect_list(F.struct("text", "places")).alias("places"))
    places = written(spark, places, "repeats-places")
    with_text = _near(rows, places, s, "left_semi").join(places, "id").select("id", "body", "places")
    blocks = with_text.mapInArrow(lambda b: _contexts(b, s, buckets), BLOCK).repartition(parts, "bucket").sortWithinPartitions("bucket")
    removed = written(spark, blocks.mapInArrow(lambda b: _removed(b, s), "kind int, id bigint, text bigint, spans binary, bytes binary"), "repeats-spans")
    spans = removed.where("kind = 0").select("id", "text", "spans")
    large = removed.where("kind = 2").select("id", "text", F.col("spans").alias("start"), "bytes")
    return spans if large.isEmpty() else spans.unionByName(_large_groups(large, s))


def _large_groups(contexts: DataFrame, s: Settings) -> DataFrame:
    """Spans of contexts whose anchor very many distinct contexts have: each window's first place by map-side minima, one row per window and task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, body = int(np.frombuffer(row["start"], np.int64)[0]), row["bytes"]
                n = len(body) - s.least + 1
                keys = [hashlib.blake2b(body[k : k + s.least], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array([row["id"]] * n, pa.int64()), pa.array([row["text"]] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())],
                    ["window", "id", "text", "start"])

    all_ = written(contexts.sparkSession, contexts.mapInArrow(windows, "window binary, id bigint, text bigint, start bigint").distinct(), "repeats-windows")
    first = all_.groupBy("window").agg(F.min(F.struct("id", "text", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = all_.join(first, "window").where(F.struct("id", "text", "start") != F.col("first")).select("id", "text", "start")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, start = (batch.column(c).to_numpy() for c in ("id", "text", "start"))
            rows = list(zip(*_spans(ids, texts, start, start + s.least), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "text", "spans"])

    return late.mapInArrow(spans, SPANS)


def remove_repeats(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_bytes, n_removed, spans (removed, as arrays start, end), kept (the remaining bytes).

    A byte is removed when some string of `least` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Strings lie within one text's UTF-8 bytes, and are judged on the input. Null texts are empty; texts
    shorter than `least` lose nothing. A null id comes after all others. Rows that repeat an id are ordered by a hash of their text;
    those that repeat the text too are one document. An empty table gives no rows; other columns are ignored.

    1. Each window of `least` bytes has an anchor, its gram with the smallest hash; equal windows have equal ones. Anchors are
    dealt by hash, in blocks; those that occur once drop out. 2. The bytes around the others, equal ones only once, are dealt by
    anchor again; hashes find equal ones, their bytes decide. 3. Contexts of one anchor meet in a suffix array with common prefixes, whose interval tree gives the
    maximal repeat groups with all occurrences. Large groups use windows with map-side minima in its place. 4. Spans are merged per
    document. Only texts with a repeat are shuffled.
    """
    s = settings or Settings()
    rows = df.select(F.coalesce(col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("body"), col(id_col).alias("own"))
    spans = repeated_spans(rows.select("id", "body"), s)
    spans = spans.groupBy("id", "text").agg(F.collect_list("spans").alias("spans")).groupBy("id").agg(F.collect_list(F.struct("text", "spans")).alias("found"))
    spans = written(df.sparkSession, spans, "repeats-merged")
    kind = rows.schema["own"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("body"))
            tags = _text_tags(data, offsets).tolist()
            spans, kept, removed = [], [], []
            for k, found in enumerate(batch.column("found").to_pylist()):
                body = data[offsets[k] : offsets[k + 1]]
                pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for f in found or [] if f["text"] == tags[k] for b in f["spans"]]
                gone = np.zeros(len(body) + 1, np.int64)
                for p in pairs:
                    np.add.at(gone, p[:, 0], 1)
                    np.add.at(gone, p[:, 1], -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(body[~gone].tobytes())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([
                batch.column("own"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["own", "n_bytes", "n_removed", "spans", "kept"])

    out = "own " + kind + ", n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    touched = _near(rows, spans, s, "left_semi").join(spans, "id", "left").select("own", "body", "found").mapInArrow(cut, out)
    whole = _near(rows, spans, s, "left_anti").select(
        "own", F.octet_length("body").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("body").cast("binary").alias("kept"))
    return touched.unionByName(whole).withColumnRenamed("own", id_col)
