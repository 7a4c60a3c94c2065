"""One entry for the file formats a dataset may come in, chosen by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulefold.sources.delimited import read_delimited


def read_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """`.csv`, `.tsv`, `.parquet` or `.pq`, a file or a folder of that name; options go to the text reader."""
    name = path.lower().rstrip("/").removesuffix(".gz")
    if name.endswith((".csv", ".tsv", ".tab")):
        return read_delimited(spark, path, **options)
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unknown dataset format: {path}; expected .csv, .tsv, .parquet or .pq")
