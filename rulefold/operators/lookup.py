"""Rows by key without a scan: a table sorted by key, with the key range of every file and Bloom filters inside.

`write_keyed` deals a table (lineage, usually) to files by ranges of the key, sorts each, and keeps beside it a table of the ranges. `find`
reads the files whose range holds a wanted key, and of these only the row groups and pages that statistics and Bloom filters leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions.cells import col

MAX_KEYS = 1_000  # keys that one call of `find` looks up by files; more are a join


def write_keyed(df: DataFrame, path: str, key: str | Sequence[str], *, files: int | None = None, row_group_bytes: int = 8 << 20) -> None:
    """Write `df` to `path`/rows, sorted by `key`, and the key range of each file to `path`/ranges. Nothing may be there yet.

    files: number of key ranges, the session's shuffle partitions if not given. Rows of one key are spread over several files when they fill
    more than a range: the hash of all cells is the last sort key. The ranges cost one pass over the key columns of what was written.
    """
    spark = df.sparkSession
    keys = _keys(key)
    spread = "_spread"
    while spread in df.columns:
        spread += "_"
    cells = [F.to_json(F.array(col(c))) if "map<" in t else col(c) for c, t in df.dtypes]  # maps have no hash
    dealt = df.withColumn(spread, F.xxhash64(*cells))
    order = [*[col(k) for k in keys], F.col(spread)]
    dealt = dealt.repartitionByRange(files, *order) if files else dealt.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).drop(spread).write.option("parquet.block.size", row_group_bytes)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    first, last = F.min(F.struct(*[col(k) for k in keys])), F.max(F.struct(*[col(k) for k in keys]))
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(first.alias("first"), last.alias("last")).write.parquet(f"{path}/ranges")


def find(spark: SparkSession, path: str, key: str | Sequence[str], wanted: Sequence | DataFrame) -> DataFrame:
    """Rows of the given keys from a table of `write_keyed`; a key that is not there gives none, a null key finds null.

    key: the key the table is sorted by, or its first columns. wanted: values, or tuples of them for several columns, at most MAX_KEYS (a longer list is
    refused); or a table with the key columns, of any size, which is joined: files outside its lowest and highest key are still left out.
    """
    keys, ranges = _keys(key), spark.read.parquet(f"{path}/ranges")
    if keys != ranges.schema["first"].dataType.names[: len(keys)]:
        raise ValueError(f"the table is sorted by {ranges.schema['first'].dataType.names}, not by {keys}")
    types = [ranges.schema["first"].dataType[k].dataType for k in keys]
    first, last = (F.struct(*[F.col(end)[k].alias(k) for k in keys]) for end in ("first", "last"))

    def literal(values: Sequence) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(k) for v, k, t in zip(values, keys, types, strict=True)])

    if isinstance(wanted, DataFrame):
        side = wanted.select(*[col(k).alias(f"_wanted{i}") for i, k in enumerate(keys)])
        names = [F.col(c) for c in side.columns]
        low, high = side.agg(F.min(F.struct(*names)).alias("low"), F.max(F.struct(*names)).alias("high")).first()
        rows = _rows(spark, path, ranges.where(F.lit(False) if low is None else (last >= literal(low)) & (first <= literal(high))))
        return rows.join(side, reduce(Column.__and__, [col(k).eqNullSafe(c) for k, c in zip(keys, names, strict=True)]), "left_semi")
    tuples = list(dict.fromkeys(tuple(w) if isinstance(w, (tuple, list)) else (w,) for w in wanted))
    if len(tuples) > MAX_KEYS:
        raise ValueError(f"{len(tuples)} keys: give more than {MAX_KEYS} as a table")
    if any(len(t) != len(keys) for t in tuples):
        raise ValueError(f"a key has {len(keys)} parts: {keys}")
    if not tuples:
        return _rows(spark, path, ranges.where(F.lit(False)))
    held = F.exists(F.array(*[literal(t) for t in tuples]), lambda w: (first <= w) & (last >= w))
    equal = [reduce(Column.__and__, [_is(col(k), v) for k, v in zip(keys, t, strict=True)]) for t in tuples]
    return _rows(spark, path, ranges.where(held)).where(_any(equal))


def _rows(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema
    files = [r["file"] for r in kept.select("file").collect()]  # names of the files that hold wanted ranges
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _is(c: Column, value) -> Column:
    return c.isNull() if value is None else c == F.lit(value)


def _any(tests: list[Column]) -> Column:
    """OR of many tests as a balanced tree: equalities reach Bloom filters, which a long IN list does not."""
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)
