"""Run a stream over what is available now into files in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rulefold.operators.memory import last_per_key
from rulefold.session import fresh_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """Settings of a stateful run: state on local disk with changelogs in the shared folder, not on the heap.

    A run keeps the partition count it starts with, which is the session's unless `partitions` says otherwise. Every
    partition opens and commits its own store in each batch.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of what is there.

    Leave `max_files` unset when the order of files says nothing about event time: all files then belong to
    one batch and no row is late.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern is taken both for a folder of files and for one file; a plain path must be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_updates(stream: DataFrame, name: str, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Process everything available in update mode and return the newest row of every key.

    Each batch's changed rows go to a folder of its own, which a repeated batch overwrites; the newest batch of a key wins. So
    groups that are still open are reported with what has come so far.
    """
    spark = stream.sparkSession
    out, state = fresh_folder(spark, f"{name}-out"), fresh_folder(spark, f"{name}-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_settings(spark, partitions):
        run = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(store).trigger(availableNow=True).start()
        run.awaitTermination()
    kept = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch bigint").parquet(out)
    return last_per_key(kept, keys, ["batch"]).drop("batch")


def run_available(stream: DataFrame, name: str, partition_by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Process everything available, exactly once, into Parquet files, and return them as a table."""
    spark = stream.sparkSession
    out, state = fresh_folder(spark, f"{name}-out"), fresh_folder(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with state_settings(spark, partitions):
        run = writer.trigger(availableNow=True).start(out)
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
