"""Delimited text: read as text, turn NA tokens into NULL, then narrow whole columns.

A column becomes boolean, bigint or double only when every present value has that form; dates stay text.
The decision costs one aggregate over the file; pass `schema` to skip it.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import NUMERIC_TEXT, col

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOL_TEXT = r"\A(True|TRUE|true|False|FALSE|false)\z"
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
ENCODINGS = {"utf-8": "UTF-8", "utf-16": "UTF-16", "latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1"}


def _cp1252_shift() -> tuple[str, str]:
    """Characters that Latin-1 and cp1252 read differently from the same byte."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs if c)


def _present(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def narrow(df: DataFrame) -> DataFrame:
    """Text columns to boolean / bigint / double where every present value allows it."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    tests = []
    for i, n in enumerate(names):
        c = col(n)
        tests += [
            F.bool_and(c.rlike(BOOL_TEXT)).alias(f"b{i}"),
            F.bool_and(F.when(c.isNotNull(), c.rlike(WHOLE_TEXT) & F.trim(c).try_cast("bigint").isNotNull())).alias(f"i{i}"),
            F.bool_and(c.rlike(NUMERIC_TEXT)).alias(f"d{i}"),
        ]
    row = df.agg(*tests).first()
    changed = {}
    for i, n in enumerate(names):
        c = F.trim(col(n))
        if row[f"b{i}"]:
            changed[n] = F.lower(col(n)) == "true"
        elif row[f"i{i}"]:
            changed[n] = c.try_cast("bigint")
        elif row[f"d{i}"]:
            changed[n] = c.try_cast("double")
    return df.withColumns(changed) if changed else df


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    sep: str | None = None,
    header_row: int = 0,
    encoding: str = "utf-8",
    schema: str | T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV (or TSV by file name) with one header line per file at `header_row` (0 = first line).

    multi_line: cells may hold line breaks; files can then not be split between tasks.
    """
    if not 0 <= header_row <= 10:
        raise ValueError("header_row must be between 0 and 10")
    sep = sep or ("\t" if path.lower().rstrip("/").endswith((".tsv", ".tsv.gz", ".tab")) else ",")
    charset = ENCODINGS.get(encoding.lower(), encoding)

    def reader(delimiter: str):
        # Two-byte encodings cannot be cut at byte '\n', so such files are read as one piece each.
        return (
            spark.read.option("sep", delimiter).option("encoding", charset).option("escape", '"')
            .option("multiLine", multi_line or charset == "UTF-16")
        )

    if header_row == 0:
        raw = reader(sep).option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = _below_header(reader, path, sep, header_row)
    if encoding.lower() == "cp1252":
        # Spark's readers do not know cp1252: read as Latin-1, then exchange the characters that differ.
        latin, windows = _cp1252_shift()
        table = str.maketrans(latin, windows)
        raw = raw.select(*[F.translate(col(n), latin, windows).alias(n.translate(table)) for n in raw.columns])
    clean = raw.select(*[_present(col(n)).alias(n) for n in raw.columns])
    if schema is None:
        return narrow(clean)
    wanted = spark.createDataFrame([], schema).schema
    return clean.select(*[F.trim(col(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted])


def _below_header(reader, path: str, sep: str, header_row: int) -> DataFrame:
    """Drop the first `header_row + 1` records of every file.

    A line's position is known only while its file is read, so the dropping runs inside the scan task
    (Arrow batches); only the block that starts a file has anything to drop.
    """
    head = (
        reader("\u0001").option("quote", "").option("escape", "\\").schema("line string").csv(path)
        .where("_metadata.file_block_start = 0").limit(header_row + 1).collect()
    )
    names = next(csv.reader([head[header_row]["line"]], delimiter=sep))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = reader(sep).option("header", False).schema(fields).csv(path)
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    drop = header_row + 1

    def skip(batches):
        seen: dict[str, int] = {}
        for pdf in batches:
            position = pdf.groupby("_path").cumcount() + pdf["_path"].map(lambda p: seen.get(p, 0))
            for p, n in pdf["_path"].value_counts().items():
                seen[p] = seen.get(p, 0) + int(n)
            yield pdf[(pdf["_start"] > 0) | (position >= drop)].drop(columns=["_path", "_start"])

    return placed.mapInPandas(skip, fields)


def preview(df: DataFrame, key: str | None = None, n: int = 20) -> DataFrame:
    """First rows, by key when one is given (a per-task heap, no full sort)."""
    return df.orderBy(col(key)).limit(n) if key else df.limit(n)


def column_overview(df: DataFrame, key: str) -> DataFrame:
    """Per column: type, present cells and the present value of the lowest key. One aggregate."""
    from rulefold.functions.cells import is_missing

    aggregates, rows = [], []
    for i, f in enumerate(df.schema):
        ok = ~is_missing(col(f.name), f.dataType)
        aggregates += [
            F.count_if(ok).alias(f"n{i}"),
            F.min_by(col(f.name).cast("string"), F.when(ok, col(key))).alias(f"s{i}"),
        ]
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(i).alias("position"),
            F.lit(f.dataType.simpleString()).alias("detected"), F.col(f"n{i}").alias("non_null"),
            F.coalesce(F.col(f"s{i}"), F.lit("")).alias("sample")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
