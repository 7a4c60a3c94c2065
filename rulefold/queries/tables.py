"""Sources and sinks: tables are written to the shared folder in a reference format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators.audit import event_counts, flatten_reports
from rulefold.operators.memory import KEYS, first_per_key
from rulefold.operators.review import pending, replay
from rulefold.queries import query
from rulefold.queries.audits import AUDIT_SQL, audit_events
from rulefold.queries.libraries import LIBRARY_SQL, library
from rulefold.queries.memory import FIRST, SEEN_SQL, SHOWN, TICKET_SQL, _patterns, resolutions, seen, tickets
from rulefold.session import fresh_folder, table
from rulefold.sources.delimited import read_delimited
from rulefold.sources.records import (
    RESOLUTIONS,
    TICKETS,
    append_events,
    append_memory,
    read_decisions,
    read_entries,
    read_events,
    read_memory,
    scan_records,
    write_result,
)


def _messy(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing tokens, a number column that holds text, and a flag column."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("N/A")).otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(status == "P", F.lit("NULL")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(status == "P", F.lit("pending")).otherwise(F.col("o_totalprice").cast("string")).alias("lab"),
        F.when(F.col("o_totalprice") > 250000, F.lit("True")).otherwise(F.lit("False")).alias("dear"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit('a "quoted", '), F.col("o_orderpriority")).alias("note"))


MESSY_SQL = """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS customer,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE CAST(o_totalprice AS VARCHAR) END AS lab, o_totalprice > 250000 AS dear,
  strftime(o_orderdate, '%Y-%m-%d') AS day, 'a "quoted", ' || o_orderpriority AS note FROM orders"""


@query("csv_narrowed", MESSY_SQL)
def csv_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "orders-csv")
    _messy(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return read_delimited(spark, path)


@query("tsv_with_schema", MESSY_SQL)
def tsv_with_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated, Latin-1, types given by the caller: no pass over the file to decide them."""
    path = fresh_folder(spark, "orders-tsv")
    _messy(spark, folder).write.option("header", True).option("sep", "\t").option("escape", '"').option(
        "encoding", "ISO-8859-1").csv(path)
    schema = ("o_orderkey bigint, customer bigint, price double, lab string, dear boolean, day string, note string")
    return read_delimited(spark, path, sep="\t", encoding="latin-1", schema=schema)


@query("csv_header_below_top", "SELECT p_partkey, p_brand, p_size FROM part")
def csv_header_below_top(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose third line is the header: two lines of remarks stand above it in every file."""
    path = fresh_folder(spark, "parts-remarks")
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_brand", F.col("p_size").cast("string").alias("p_size"))

    def with_remarks(batches):
        head = True
        for pdf in batches:
            lines = pdf["p_partkey"] + ";" + pdf["p_brand"] + ";" + pdf["p_size"]
            if head:
                lines = ["exported by test", "second remark", "p_partkey;p_brand;p_size", *lines]
                head = False
            yield type(pdf)({"value": list(lines)})

    rows.mapInPandas(with_remarks, "value string").write.text(path)
    schema = "p_partkey bigint, p_brand string, p_size int"
    return read_delimited(spark, path, sep=";", header_row=2, schema=schema)


@query("result_sinks", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS band, 'parquet' AS fmt FROM customer
UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END, 'csv' FROM customer""")
def result_sinks(spark: SparkSession, folder: str) -> DataFrame:
    from rulefold.plans.apply import apply_rule

    df = apply_rule(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "band", "bin",
        {"edges": [0], "labels": ["debt", "ok"]}, "c_acctbal").select("c_custkey", "band")
    parquet, csv = fresh_folder(spark, "result-parquet"), fresh_folder(spark, "result-csv")
    write_result(df, parquet)
    write_result(df, csv, "csv")
    back = spark.read.parquet(parquet).withColumn("fmt", F.lit("parquet"))
    return back.unionByName(read_delimited(spark, csv).withColumn("fmt", F.lit("csv")))


@query("event_log", f"WITH {AUDIT_SQL} SELECT run_id, event_type, count(*) AS n_events FROM a GROUP BY ALL")
def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to the log, then one read with the fixed schema."""
    path = fresh_folder(spark, "audit-log")
    events = audit_events(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "run_id", "event_type", "target", "ltm_hit",
        "source_mode")
    append_events(events.where("ltm_hit"), path)
    append_events(events.where("NOT ltm_hit"), path)
    return event_counts(read_events(spark, path))


@query("ticket_scan", f"""
WITH {TICKET_SQL} SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, event_id, target, ticket_kind FROM t WHERE k >= 60""")
def ticket_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets and resolutions below one folder per run (here: per day); the run comes from the path."""
    inbox, outbox = fresh_folder(spark, "inbox"), fresh_folder(spark, "outbox")
    run = F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run")
    opened = tickets(spark, folder).select("event_id", "ticket_kind", "target", "options_offered", run)
    closed = resolutions(spark, folder).select(
        "event_id", "ticket_kind", "target", "chosen_option",
        F.concat(F.lit("run-"), F.date_format("resolved_at", "yyyyMMdd")).alias("run"))
    for rows, path in ((opened, inbox), (closed, outbox)):
        # Rebalancing splits a large run over several files and packs small ones into one.
        rows.hint("rebalance", "run").write.partitionBy("run").json(path)
    return pending(
        scan_records(spark, inbox, TICKETS, multi_line=False), scan_records(spark, outbox, RESOLUTIONS, multi_line=False)
    ).select("run_id", "event_id", "target", "ticket_kind")


@query("memory_table_scan", f"""
WITH {SEEN_SQL}, o AS ({FIRST.format('seen')})
SELECT rule_kind, body_signature, body, run_id AS first_seen_run_id, 'validated' AS status FROM o""")
def memory_table_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rule patterns appended in two steps, the second only with keys the first has not got."""
    from rulefold.operators.memory import new_rows

    store = fresh_folder(spark, "memory")
    rows = _patterns(seen(spark, folder))
    early = first_per_key(rows, KEYS["rule_patterns"], ["first_seen_at"])
    append_memory(early.where("rule_kind < 'n'"), store, "rule_patterns")
    kept = read_memory(spark, store, "rule_patterns")
    append_memory(new_rows(kept, rows, "rule_patterns"), store, "rule_patterns")
    return read_memory(spark, store, "rule_patterns").select(*SHOWN)


@query("report_scan", f"""
WITH {TICKET_SQL} SELECT run_id, target AS derivation, 'verified' AS status, count(*) AS n FROM t GROUP BY ALL""")
def report_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "reports")
    report = F.to_json(F.struct(F.create_map(
        F.col("target"), F.struct(F.lit("verified").alias("status"))).alias("derivations"))).alias("report")
    tickets(spark, folder).select("run_id", report).write.json(path)
    flat = flatten_reports(spark.read.schema("run_id string, report string").json(path))
    return flat.groupBy("run_id", "derivation", "status").agg(F.count(F.lit(1)).alias("n"))


@query("spec_documents", f"""
WITH {LIBRARY_SQL} SELECT study_id AS study, name, rule_kind, rule_body FROM l""")
def spec_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Spec documents with one study each, read in bulk into spec entries."""
    path = fresh_folder(spark, "specs")
    entries = library(spark, folder)
    one = F.struct("name", "inputs", "rule_kind", "rule_body", F.col("study_id").alias("rationale"))
    # A study has as many entries as its spec document; documents are small by nature.
    docs = entries.groupBy("study_id").agg(F.collect_list(one).alias("derivations")).select(
        F.lit("1").alias("version"), "derivations")
    docs.write.json(path)
    read = read_entries(spark, path, multi_line=False)
    return read.select(F.col("rationale").alias("study"), "name", "rule_kind", "rule_body")


@query("replay_file", f"""
WITH {TICKET_SQL} SELECT event_id, target LIKE 'V1%' AS resolved, CASE WHEN target LIKE 'V1%' THEN 'option ' || target END AS chosen_option FROM t""")
def replay_file(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "decisions")
    rows = tickets(spark, folder)
    decided = rows.where("target LIKE 'V1%'").select(
        "ticket_kind", "target", F.concat(F.lit("option "), F.col("target")).alias("chosen_option")).distinct()
    decided.write.json(path)
    decisions = read_decisions(spark, path, multi_line=False)
    return replay(rows, decisions, "position").select("event_id", "resolved", "chosen_option")


