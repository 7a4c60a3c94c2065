"""Record files: event logs, tickets, resolutions, reports, decisions, memory tables and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators.audit import EVENTS

TICKETS = (
    "event_id string, ticket_kind string, target string, prompt_shown_to_human string, options_offered array<string>, "
    "context map<string,string>, opened_at string"
)
RESOLUTIONS = (
    "event_id string, ticket_kind string, target string, chosen_option string, body_patch string, "
    "free_text_rationale string, resolved_by string, resolved_at string"
)
DECISIONS = (
    "ticket_kind string, target string, chosen_option string, body_patch string, free_text_rationale string, "
    "resolved_by string"
)
RUN_IN_PATH = r"^.*/(?:[^/=]+=)?(run-[^/]+)/"


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Analysis-ready sink; the format is the caller's choice and never changes silently."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"format must be parquet or csv, got {fmt!r}")
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_split(marked: DataFrame, path: str, column: str = "_violations") -> None:
    """Quarantined table in one pass: folders accepted=true and accepted=false, reasons kept as an array."""
    marked.withColumn("accepted", F.size(column) == 0).write.partitionBy("accepted").parquet(path)


def append_events(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Append events to the log; every write adds files, none is rewritten."""
    events.write.mode("append").format(fmt).save(path)


def read_events(spark: SparkSession, path: str, fmt: str = "json", schema: str = EVENTS) -> DataFrame:
    """Event log of one or many runs (globs allowed), with a fixed schema instead of inference."""
    return spark.read.format(fmt).schema(schema).load(path)


def scan_records(spark: SparkSession, path: str, schema: str, *, multi_line: bool = True) -> DataFrame:
    """JSON records below many run folders, with the run taken from the file path.

    multi_line reads one document or array per file; without it, one record per line.
    """
    rows = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    run = F.regexp_extract("_metadata.file_path", RUN_IN_PATH, 1)
    return rows.select(run.alias("run_id"), *rows.columns)


def read_decisions(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Recorded decisions with their position, so that the last one of a target can win.

    Position is (file, block, place inside the block); Spark keeps the order of rows within a block.
    """
    rows = spark.read.schema(DECISIONS).option("multiLine", multi_line).json(path)
    return rows.select(
        "*", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")).alias("position"))


def read_entries(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Bulk spec documents (JSON) as `spec_entries`; the file path is the study."""
    entry = (
        "name string, inputs array<string>, rule_kind string, rule_body string, rationale string, ambiguity_notes string"
    )
    docs = spark.read.schema(f"version string, derivations array<struct<{_struct(entry)}>>")
    rows = docs.option("multiLine", multi_line).json(path)
    return rows.select(F.col("_metadata.file_path").alias("study_id"), F.inline("derivations"))


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def read_memory(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def append_memory(rows: DataFrame, folder: str, table: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/{table}")
