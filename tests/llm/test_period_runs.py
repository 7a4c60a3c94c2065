"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rulefold.llm.period_runs import Settings, find_runs, period_runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words, least=24, powers=3):
    """Every maximal stretch of equal words q apart; those with a smaller period are found by that one."""
    n, found = len(words), {}
    for q in range(1, n // powers + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, powers * q) and (i, length) not in found:
                found[i, length] = q
            i = j + 1
    return sorted((i, length, q) for (i, length), q in found.items())


def expected(text, least=24, powers=3):
    words = WORD.findall((text or "").encode())
    runs = brute(words, least, powers)
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "a\tb\n" * 12, "a b " * 11 + "a", "x " * 2000, "é 漢 " * 40 + "\U0001F600 " * 50]
    out += ["a b a b a b a b a b c " * 9, "a a b " * 30 + "a a a a b " * 30, " ".join(str(k % 9) for k in range(80)) + " " + " ".join(str(k % 6) for k in range(70))]
    out.append("a b " * 20 + "a c " * 20 + "d " * 30 + "a b c " * 15)
    for size in (2, 3, 5):
        for _ in range(12):  # few words: runs that overlap, and runs inside runs
            out.append(" ".join(rng.choice("abcde"[:size]) for _ in range(rng.randint(20, 150))))
    for _ in range(25):
        root = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        k = rng.randint(20, 200)
        out.append(" ".join([rng.choice("xyz") for _ in range(rng.randint(0, 9))] + (root * k)[:k] + [rng.choice("xyz") for _ in range(rng.randint(0, 9))] + root * 3))
    return out


def test_runs(spark):
    rows = texts()
    rows += rows[10:13]
    ids = [None, 7, 7, *range(100, 100 + len(rows) - 3)]
    shape = "doc_id bigint, text string, runs int, own string, body string, collapsed int, `a.b` int"
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in zip(ids, rows, strict=True)], shape).repartition(3)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df).collect())
    want = sorted((str(i), len(WORD.findall((t or "").encode())), *expected(t)) for i, t in zip(ids, rows, strict=True))
    assert got == want
    assert any(len(w[2]) > 2 for w in want) and sum(len(w[2]) > 0 for w in want) > 20
    assert find_runs(df.where("1 = 0")).collect() == []


@pytest.mark.parametrize("least, powers", [(6, 3), (10, 4), (1, 3)])
def test_other_limits(least, powers):
    rng = np.random.default_rng(least)
    for _ in range(40):
        sizes = rng.integers(0, 60, 4)
        words = rng.integers(0, 3, int(sizes.sum()))
        firsts = np.append(0, np.cumsum(sizes))
        got = [tuple(r) for r in period_runs(words.astype(np.uint64), firsts, Settings(least, powers)).tolist()]
        want = [(i + a, n, q) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True) for i, n, q in brute(words[a:b].tolist(), least, powers)]
        assert got == want


def test_too_few_powers():
    with pytest.raises(ValueError):
        Settings(powers=2)


def test_query(spark, tmp_path):
    """The query, planted words included, on rows that hold the messy texts."""
    from rulefold.llm.queries import QUERIES

    rows = [(i, t) for i, t in enumerate(texts() * 4)] + [(None, "a " * 40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        words = WORD.findall((t or "").encode())
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs, left = expected(b" ".join(words).decode())
        best = (None,) * 4
        for s, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want[i] = (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_period_runs"](spark, str(tmp_path)).collect()}
    assert got == want
