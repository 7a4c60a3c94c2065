"""Top-k search against sorted inner products of all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulefold.llm.topk_search import Settings, top_k


def brute(rows, asked, k, scale=1024):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, v) in enumerate(usable):
        if asked(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(usable) if m != n)  # noqa: B905
            out.update((i, r, None if unnamed else j, -score) for r, (score, unnamed, j) in enumerate(found[:k], 1))
    return out


def rows():
    rng = random.Random(8)
    out = [(k, [rng.choice((0.0, 0.0, rng.uniform(-2, 2))) for _ in range(12)]) for k in range(330)]
    out += [(k, [0.5, -0.25] + [0.0] * 10) for k in range(400, 440)]  # ties, more than k
    out += [(100, [1.0] * 12), (100, [1.0] * 12), (200, out[200][1]), (None, [0.5, -0.25] + [0.0] * 10), (None, [2.0] * 12)]
    out += [(500, None), (501, []), (600, [float("nan")] + [1.0] * 11), (601, [float("inf")] + [1.0] * 11), (602, [None] + [1.0] * 11), (700, [1.0] * 3), (800, [-0.0001] * 14), (900, [])]
    return out


@pytest.mark.parametrize("settings", [Settings(), Settings(block=16, group=50), Settings(k=3, block=7, group=7), Settings(scale=7, k=1000)])
def test_top_k(spark, settings):
    data = rows()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in data], "vec_id bigint, embedding array<float>, key int, `group` string, score int").repartition(3)
    got = top_k(df, F.col("vec_id") % 100 == 0, settings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    data = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in data]
    assert Counter(tuple(r) for r in got.collect()) == brute(data, lambda i: i is not None and i % 100 == 0, settings.k, settings.scale)


def test_none_and_too_large(spark):
    shape = "vec_id bigint, embedding array<double>"
    assert top_k(spark.createDataFrame([], shape), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0]), (100, None)], shape), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0])], shape), F.col("vec_id") % 100 == 0).collect() == []
    for values in ([1e9], [2.0**20] * 9):
        with pytest.raises(Exception, match="beyond|64 bits"):
            top_k(spark.createDataFrame([(0, values), (1, values)], shape), F.col("vec_id") % 100 == 0).collect()
