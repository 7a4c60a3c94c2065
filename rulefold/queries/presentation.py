"""Readable labels over codes derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold import fixed_values as fixed
from rulefold.functions import labels as lb
from rulefold.queries import query
from rulefold.queries.audits import AUDIT_SQL, audit_events
from rulefold.session import table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(code: str, labels: dict[str, str], otherwise: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in labels.items()) + f" ELSE {otherwise} END"


def _sentence(code: str) -> str:
    return f"upper(left(replace({code}, '_', ' '), 1)) || lower(substr(replace({code}, '_', ' '), 2))"


# One code of every vocabulary per event, unknown codes included.
CODES = {
    "layer": ["L1", "L2", "L_p", "L9"],
    "ticket_kind": ["ambiguity", "approval", "triage", "other_kind"],
    "property": ["P-bin-1", "P-flag-3", "P-risk_score-2", "P-none-1"],
    "severity": ["error", "warning", "info", "fatal"],
    "rule_kind": ["bin", "flag", "risk_score", "custom_kind"],
    "option": ["flag_unknown_as_U", "reject", "raise_on_null", "add_Pediatric_stratum"],
    "ambiguity_class": ["ltm_cached", "missing_logic", "rationale_undefined", "brand_NEW_class"],
    "status": ["verified", "skipped", "missing", "awaiting_triage"],
    "column": ["ts", "run_id", "options_offered", "my_Own_column"],
}
PICK = "user_id % 4"


def _pick(values: list[str]) -> str:
    return f"CASE {PICK} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TABLES = {n: lb.VOCABULARIES[n] for n in CODES}
LABELS_SQL = ", ".join(
    f"{_case(_pick(v), _TABLES[n][0], _sentence(_pick(v)) if _TABLES[n][1] else _pick(v))} AS {n}_label"
    for n, v in CODES.items())


@query("labels_fallback", f"""
WITH {AUDIT_SQL}
SELECT event_id, {LABELS_SQL}, {_case(_pick(CODES['ticket_kind']), fixed.TICKET_LEAD, _q(fixed.TICKET_LEAD_DEFAULT))} AS lead,
  {_case('a.event_type', fixed.EVENT_TYPE, _sentence('a.event_type'))} AS event_label
FROM events JOIN a ON a.event_seq = event_id""")
def labels_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    kinds = F.expr(_pick(CODES["ticket_kind"]))
    from rulefold.queries.audits import AUDIT

    return rows.select(
        "event_id", *[lb.label_of(n, F.expr(_pick(v))).alias(f"{n}_label") for n, v in CODES.items()],
        lb.ticket_lead(kinds).alias("lead"), lb.label_of("event_type", F.expr(AUDIT["event_type"])).alias("event_label"))


@query("fingerprints", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '(none)' ELSE left(sha256(props), 6) END AS fingerprint,
  CASE event_type WHEN 'view' THEN 'evt-' WHEN 'click' THEN left('event' || event_id, 8) WHEN 'error' THEN NULL
       ELSE substr(sha256(props), 1, 8) END AS short_id FROM events""")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    sha = F.sha2("props", 256)
    kind = F.col("event_type")
    raw = F.when(kind == "view", F.lit("evt-")).when(
        kind == "click", F.concat(F.lit("event"), F.col("event_id").cast("string"))).when(
        kind != "error", F.concat(F.lit("evt-"), sha))
    return rows.select(
        "event_id", lb.short_fingerprint(F.when(kind != "error", sha)).alias("fingerprint"),
        lb.short_event_id(raw).alias("short_id"))


@query("timestamp_labels", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'not a date' ELSE strftime(ts, '%B %-d, %Y, %-I:%M %p') || ' UTC' END
  AS utc_label, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'not a date' ELSE
  strftime(ts - INTERVAL 5 HOUR, '%B %-d, %Y, %-I:%M %p') || ' EST' END AS toronto_label FROM events""")
def timestamp_labels(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "view", F.lit("not a date")).when(
        kind != "error", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    rows = table(spark, folder, "events").withColumn("text", text)
    return rows.select(
        "event_id", lb.timestamp_label(F.col("text")).alias("utc_label"),
        lb.timestamp_label(F.col("text"), "America/Toronto").alias("toronto_label"))


@query("timestamp_labels_any_year", """
SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN moment - INTERVAL 4 HOUR WHEN 1 THEN moment - INTERVAL 5 HOUR
  WHEN 2 THEN moment - INTERVAL 4 HOUR ELSE moment - INTERVAL 5 HOUR END, '%B %-d, %Y, %-I:%M %p') || CASE event_id % 4
  WHEN 0 THEN ' EWT' WHEN 1 THEN ' EST' WHEN 2 THEN ' EDT' ELSE ' EST' END AS label
FROM (SELECT event_id, ts + to_months(CAST(CASE event_id % 4 WHEN 0 THEN -12 * 81 WHEN 1 THEN -12 * 70 WHEN 2 THEN 12 * 76 + 6
  ELSE 12 * 76 END AS INTEGER)) AS moment FROM events)""")
def timestamp_labels_any_year(spark: SparkSession, folder: str) -> DataFrame:
    """Events moved to the war time of 1943, to 1954 and to winter and summer of 2100."""
    kind = F.col("event_id") % 4
    months = F.when(kind == 0, -12 * 81).when(kind == 1, -12 * 70).when(kind == 2, 12 * 76 + 6).otherwise(12 * 76)
    rows = table(spark, folder, "events").withColumn("at", F.col("ts") + F.make_ym_interval(F.lit(0), months.cast("int")))
    text = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return rows.select("event_id", lb.timestamp_label(text, "America/Toronto").alias("label"))


@query("run_labels", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'run-' || o_orderkey ELSE
  strftime(d, '%B %-d, %Y at %-I:%M %p UTC') || ' (a-' || o_orderkey || ')' END AS label,
  CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE o_orderpriority || ' -- ' END || CASE WHEN o_orderstatus = 'P'
  THEN 'run-' || o_orderkey ELSE strftime(d, '%B %-d, %Y at %-I:%M %p UTC') || ' (a-' || o_orderkey || ')' END AS title
FROM (SELECT *, o_orderdate + to_minutes(o_custkey) AS d FROM orders)""")
def run_labels(spark: SparkSession, folder: str) -> DataFrame:
    at = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_custkey as int))")
    key = F.col("o_orderkey").cast("string")
    run = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("run-"), key)).otherwise(
        F.concat(F.lit("run-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-a-"), key))
    name = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority"))
    rows = table(spark, folder, "orders").withColumns({"run": run, "task": name})
    return rows.select(
        "o_orderkey", lb.run_label(F.col("run")).alias("label"), lb.run_title(F.col("task"), F.col("run")).alias("title"))


@query("json_summaries", f"""
SELECT event_id, CASE event_type
    WHEN 'click' THEN {_q(fixed.OPTION['reject'])} WHEN 'view' THEN 'free text ' || event_id WHEN 'signup' THEN props
    WHEN 'purchase' THEN 'not json' END AS decision,
  CASE event_type WHEN 'click' THEN {_q(fixed.OPTION['reject'] + '; other')} WHEN 'view' THEN 'x' || event_id
    WHEN 'signup' THEN '(no options recorded)' WHEN 'purchase' THEN 'not json' END AS options FROM events""")
def json_summaries(spark: SparkSession, folder: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id").cast("string")
    decision = (
        F.when(kind == "click", F.lit('{"body_patch": {}, "chosen_option": "reject"}'))
        .when(kind == "view", F.concat(F.lit('{"chosen_option": "free text '), eid, F.lit('"}')))
        .when(kind == "signup", F.col("props")).when(kind == "purchase", F.lit("not json")))
    options = (
        F.when(kind == "click", F.lit('{"options": ["reject", "other"]}'))
        .when(kind == "view", F.concat(F.lit('["x'), eid, F.lit('"]')))
        .when(kind == "signup", F.col("props")).when(kind == "purchase", F.lit("not json")))
    return table(spark, folder, "events").select(
        "event_id", lb.resolution_summary(decision).alias("decision"), lb.options_summary(options).alias("options"))


@query("reviewer_table", f"""
WITH {AUDIT_SQL}
SELECT event_seq AS "Event seq", run_id AS "Run", {_case('event_type', fixed.EVENT_TYPE, _sentence('event_type'))} AS "Activity",
  target AS "Variable", left(sha256(target), 6) AS "Rule fingerprint", 'evt' AS "Question ID",
  CASE WHEN chosen_option IS NULL THEN NULL ELSE chosen_option END AS "Decision",
  CASE WHEN chosen_option IS NULL THEN NULL ELSE chosen_option END AS "Decision (resolution)" FROM a""")
def reviewer_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit_events(spark, folder).select(
        "event_seq", "run_id", "event_type", "target", F.sha2("target", 256).alias("body_signature"),
        F.lit("evt-evt").alias("event_id"), "chosen_option", F.col("chosen_option").alias("resolution"))
    return lb.reviewer_table(rows)
