"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def utf8(text: str | None) -> bytes:
    return (text or "").encode()


def equal_texts(rows):
    """(id, text) -> Counter of (id, keep_id, group_size, kept, sha256); a null id is last."""
    body = [re.sub(rb"[\x20\x09-\x0D]+", b" ", utf8(t)) for _, t in rows]
    groups = defaultdict(list)
    for (id_, _), b in zip(rows, body, strict=True):
        groups[b].append(id_)
    out = Counter()
    for b, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[0], len(ids), k == 0, hashlib.sha256(b).hexdigest()] += 1
    return out


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(utf8(text).lower())
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def linked_components(rows, k: int, percent: int) -> dict:
    """id -> smallest id reachable; rows that repeat an id are one document."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    seen = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        both = Counter(m for g in s for m in seen[g])
        for m, c in both.items():
            j, other = sets[m]
            if 100 * c >= percent * (len(s) + len(other) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            seen[g].append(n)
    return {i: root(i) for i in parent}


def without_repeats(rows, least: int) -> list[tuple[bytes, int, int]]:
    """In the order of ids, then as given: kept bytes, removed bytes, spans."""
    order = sorted(range(len(rows)), key=lambda n: LAST if rows[n][0] is None else rows[n][0])
    seen, out = set(), [None] * len(rows)
    for n in order:
        b = utf8(rows[n][1])
        gone = [False] * len(b)
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            if w in seen:
                gone[i : i + least] = [True] * least
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[n] = (bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), spans)
    return out


def targets(sizes: dict, weights, cap: float) -> dict:
    """Shares by weight; what is above a source's cap is shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / w > cap * sizes[s]]
        if not above:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: cap * sizes[s] for s in above}
