"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (its smallest node) for every node of `edges` (a, b); both bigint, none null.

    Alternates two rewirings until nothing changes: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours. The number of rounds grows with the logarithm of the nodes. Minima are taken in the tasks before the shuffle, and each
    round is written, so lineage stays short; hot nodes are split by the joins that adaptive execution plans.
    """
    spark = edges.sparkSession
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = written(spark, small, "components")
        before, state = state, _state(now)
        if state == before:
            break
    # every node now has one edge, to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
