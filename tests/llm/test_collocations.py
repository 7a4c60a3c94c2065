"""Phrase mining against counters, and the promise of the summaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rulefold.llm.collocations import Settings, Summary, collocations, phrase_counts, summed


def brute(rows, s):
    grams, total = Counter(), Counter()
    for text, lang in rows:
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(words)
            grams.update((lang, tuple(words[i : i + n])) for n in range(1, s.longest + 1) for i in range(len(words) - n + 1))
    known = {k: a for k, a in grams.items() if a >= s.least}
    found = defaultdict(list)
    for (lang, words), a in known.items():
        inside = any(g == lang and len(w) > len(words) and f >= a and any(w[i : i + len(words)] == words for i in range(len(w))) for (g, w), f in known.items())
        if len(words) > 1 and not inside:
            n = total[lang]
            score, _, l, r = min((1000 * a * n // (known[lang, words[:k]] * known[lang, words[k:]]), k, known[lang, words[:k]], known[lang, words[k:]]) for k in range(1, len(words)))  # noqa: E741
            found[lang].append((-score, -a, b" ".join(words), l, r, n))
    return [(lang, k, p.decode(), -a, l, r, n, -score) for lang, x in found.items() for k, (score, a, p, l, r, n) in enumerate(sorted(x)[: s.top], 1)]  # noqa: E741


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["al", "be", "Ce", "DE", "é", "漢", "x" * 40, "-", "'"]
    out = [(None, "en"), ("", None), (" \n.", "en"), ("a a a a a a a a", "en"), ("one two three. one two\tthree, one  two three" * 30, None)]
    for k in range(300):
        text = "".join(rng.choice(words[: 3 + k % 7]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        out.append((text + ("Kept in one place" if k % 3 == 0 else ""), rng.choice(["en", "en", "de", None, "und", ""])))
    out += [(out[9][0] or "z z", "fr")] * 40 + [("w " * 30_000, "long")]
    return out


@pytest.mark.parametrize("s", [Settings(least=20, bits=22), Settings(least=20, bits=12, summary=200, held=50), Settings(least=5, longest=2, top=3, bits=20), Settings(least=9, longest=7, bits=22, held=400)])
def test_collocations(spark, rows, s):
    df = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n int, phrase string, `a.b` int").repartition(3)
    got = [tuple(r) for r in collocations(df, s).collect()]
    want = brute(rows, s)
    assert sorted(got) == sorted(want) and len(want) > 10


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).collect() == [] and phrase_counts(df).collect() == []
    df = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert collocations(df).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_summaries_keep_every_frequent_key(seed):
    rng = np.random.default_rng(seed)
    keys = rng.zipf(1.2, 20_000).astype(np.uint64) % np.uint64(5000)
    least = int(rng.integers(5, 200))
    summary = Summary(len(keys) // least)
    for part in np.array_split(keys, int(rng.integers(1, 60))):
        summary.merge(*np.unique(part, return_counts=True))
        assert len(summary.keys) <= summary.capacity
    assert summary.lost < least
    values, counts = np.unique(keys, return_counts=True)
    assert set(values[counts >= least].tolist()) <= set(summary.at_least(least).tolist())
    assert all(c <= dict(zip(values.tolist(), counts.tolist(), strict=True))[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


def test_summed():
    keys, counts = summed(np.array([3, 1, 3], np.uint64), np.array([2, 5, 4]))
    assert keys.tolist() == [1, 3] and counts.tolist() == [5, 6]
    assert len(summed(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0]) == 0
