"""A memory table that many runs write at once: the first writer of a key wins, a repeated batch changes nothing.

Below `folder`:

batches/<writer>-<number>   rows of one batch, written as one folder that a repetition replaces
claims/<generation>         taken by the compaction that may write this generation
base/<generation>           one row per key; usually one, more when compactions ran at once

Writers only add folders, so none waits for another and a job that dies leaves nothing that counts. Reading joins nothing: rows of the base
and of the batches meet in one aggregate per key, with partial results per task. A base wins over any batch and an older base over a newer,
so a key that was compacted keeps its row even if an earlier writer is heard of later; among batches the earliest time wins, then the writer's
name, then the batch's number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions.cells import col
from rulefold.operators.memory import KEYS, SEEN_AT, first_per_key
from rulefold.session import Folder

PLACE = ["_layer", "_at", "_writer", "_batch"]  # order in which rows of one key count


def add_batch(rows: DataFrame, folder: str, table: str, writer: str, number: int) -> None:
    """Add one batch. The same writer and number replaces the batch, so a repeated job does no harm.

    A row per key is kept of each batch. Keys that memory has already are not looked up: they lose when memory is read and go when it is compacted.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.]+", writer):
        raise ValueError(f"a writer's name has letters, digits, dots and underscores only: {writer!r}")
    kept = first_per_key(rows, KEYS[table], [SEEN_AT[table]])
    kept.write.mode("overwrite").parquet(f"{folder}/batches/{writer}-{number}")


def batch_sink(folder: str, table: str, writer: str) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: the stream's own batch numbers make repetitions harmless."""

    def store(batch: DataFrame, number: int) -> None:
        add_batch(batch, folder, table, writer, number)

    return store


def read_store(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """The memory table as of now: one row per key, columns as in `schema`. A store without rows is an empty table."""
    files = Folder(spark, folder)
    return _merged(spark, folder, table, schema, _finished(files, f"{folder}/base"), _finished(files, f"{folder}/batches"))


def compact(spark: SparkSession, folder: str, table: str, schema: str, *, remove: bool = True) -> int:
    """Fold all there is into a new base and return its generation.

    With `remove`, what was folded is deleted when the new base is finished; readers that planned before that must read again. A compaction deletes
    only what is in its own base, and all bases are read, so several at once lose no key: one whose input is gone fails and leaves nothing.
    """
    files = Folder(spark, folder)
    bases, batches = _finished(files, f"{folder}/base"), _finished(files, f"{folder}/batches")
    number = max([0, *(int(n) for n in files.names(f"{folder}/claims") if n.isdigit())]) + 1
    while not files.claim(f"{folder}/claims/{number}"):
        number += 1
    _merged(spark, folder, table, schema, bases, batches).write.parquet(f"{folder}/base/{number}")
    if remove:
        for old in [*(f"batches/{n}" for n in batches), *(f"base/{n}" for n in bases)]:
            files.remove(f"{folder}/{old}")
    return number


def _finished(files: Folder, path: str) -> list[str]:
    """Folders whose writing job has ended."""
    return [n for n in files.names(path) if files.exists(f"{path}/{n}/_SUCCESS")]


def _merged(spark: SparkSession, folder: str, table: str, schema: str, bases: list[str], batches: list[str]) -> DataFrame:
    shape = spark.createDataFrame([], schema)
    keys, at, path = KEYS[table], col(SEEN_AT[table]).alias("_at"), F.col("_metadata.file_path")

    def read(kind: str, names: list[str], *place: Column) -> DataFrame:
        rows = spark.read.schema(shape.schema).parquet(*[f"{folder}/{kind}/{n}" for n in names]) if names else shape.withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
        return rows.select(*[col(c) for c in shape.columns], *[c.alias(n) for c, n in zip(place, PLACE, strict=True)])

    batch = r"/batches/([^/]+)-(\d+)/[^/]*$"
    never = F.lit(2**62).cast("bigint")  # batches come behind all bases
    old = read("base", bases, F.regexp_extract(path, r"/base/(\d+)/[^/]*$", 1).try_cast("bigint"), at, F.lit(""), F.lit(0).cast("bigint"))
    new = read("batches", batches, never, at, F.regexp_extract(path, batch, 1), F.regexp_extract(path, batch, 2).try_cast("bigint"))
    return first_per_key(old.unionByName(new), keys, PLACE).drop(*PLACE)
