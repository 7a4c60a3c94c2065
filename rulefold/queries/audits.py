"""Audit roll-ups over audit events derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators import audit as au
from rulefold.queries import query
from rulefold.queries.memory import TICKET_SQL, resolutions, tickets
from rulefold.session import table

# Expressions valid in both SQL dialects.
AUDIT = {
    "event_seq": "event_id",
    "ts": "ts",
    "run_id": "'run-' || CAST(user_id AS STRING)",
    "target": "'V' || CAST(event_id % 7 AS STRING)",
    "event_type": "CASE event_type WHEN 'click' THEN 'cg_complete' WHEN 'view' THEN 'v_complete' "
                  "WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'apply_complete' WHEN 1 THEN 'derivation_skipped' "
                  "WHEN 2 THEN 'derivation_unresolved' ELSE 'r_complete' END "
                  "WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'hitl_open' WHEN 1 THEN 'hitl_resolved' "
                  "WHEN 2 THEN 'hitl_auto_resolved' ELSE 'something_new' END ELSE 'ltm_write' END",
    "ltm_hit": "event_id % 5 = 0",
    "source_mode": "CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'stub' WHEN 2 THEN 'live' ELSE 'stub_fallback' END",
    "written": "CASE WHEN event_id % 3 = 0 THEN 'rule_patterns' ELSE 'ambiguity_resolutions' END",
    "chosen_option": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ltm_replay' WHEN 2 THEN 'reject' ELSE 'keep_as_is' END",
    "ambiguity_class": "CASE event_id % 3 WHEN 0 THEN 'rationale_undefined' WHEN 1 THEN 'null_handling_undefined' END",
}
AUDIT_SQL = "a AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in AUDIT.items()) + " FROM events)"


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*[f"{e} AS {n}" for n, e in AUDIT.items()])


def _n(kind: str) -> str:
    return f"count(*) FILTER (event_type = '{kind}')"


COUNTERS_SQL = f"""c AS (SELECT run_id, {_n('hitl_open')} + {_n('hitl_auto_resolved')} AS sr_findings,
  {_n('hitl_auto_resolved')} AS sr_auto_resolved, {_n('hitl_open')} AS hitl_tickets_opened,
  count(*) FILTER (event_type = 'cg_complete' AND ltm_hit) AS cg_ltm_hits, {_n('apply_complete')} AS derivations_verified,
  {_n('derivation_unresolved')} + {_n('derivation_skipped')} AS derivations_unresolved,
  {_n('derivation_skipped')} AS derivations_skipped, {_n('r_complete')} AS refinement_iterations FROM a GROUP BY run_id)"""


@query("event_counters", f"WITH {AUDIT_SQL}, {COUNTERS_SQL} SELECT * FROM c")
def event_counters(spark: SparkSession, folder: str) -> DataFrame:
    return au.run_counters(audit_events(spark, folder))


@query("memory_writes", f"""
WITH {AUDIT_SQL} SELECT run_id, count(*) FILTER (event_type = 'ltm_write' AND written = 'rule_patterns') AS rule_patterns,
  count(*) FILTER (event_type = 'ltm_write' AND written = 'ambiguity_resolutions') AS ambiguity_resolutions FROM a GROUP BY run_id""")
def memory_writes(spark: SparkSession, folder: str) -> DataFrame:
    return au.memory_writes(audit_events(spark, folder), "written")


@query("event_type_counts", f"WITH {AUDIT_SQL} SELECT run_id, event_type, count(*) AS n_events FROM a GROUP BY ALL")
def event_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return au.event_counts(audit_events(spark, folder))


@query("event_kinds", f"""
WITH {AUDIT_SQL} SELECT run_id, count(DISTINCT event_type) AS n_kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
FROM a GROUP BY run_id""")
def event_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return au.event_kinds(audit_events(spark, folder)).withColumn("kinds", F.array_join("kinds", ","))


@query("event_filter", f"""
WITH {AUDIT_SQL} SELECT run_id, event_seq, event_type FROM a WHERE event_type IN ('hitl_open', 'ltm_write')""")
def event_filter(spark: SparkSession, folder: str) -> DataFrame:
    return au.event_filter(audit_events(spark, folder), ["hitl_open", "ltm_write"]).select("run_id", "event_seq", "event_type")


@query("event_filter_counts", f"""
WITH {AUDIT_SQL} SELECT run_id, count(*) FILTER (event_type IN ('hitl_open', 'ltm_write')) AS n_shown, count(*) AS n_total
FROM a GROUP BY run_id""")
def event_filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    return au.shown_of(audit_events(spark, folder), ["hitl_open", "ltm_write"])


@query("rule_sources", f"""
WITH {AUDIT_SQL} SELECT run_id, source_mode, count(*) AS n_rules, count(*) FILTER (ltm_hit) AS n_from_memory
FROM a WHERE event_type = 'cg_complete' GROUP BY ALL""")
def rule_sources(spark: SparkSession, folder: str) -> DataFrame:
    return au.rule_sources(audit_events(spark, folder))


@query("latest_status", f"""
WITH {AUDIT_SQL} SELECT run_id, target, arg_max(event_type, ts) AS status, count(*) AS n_transitions FROM a GROUP BY ALL""")
def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit_events(spark, folder).withColumnRenamed("event_type", "status")
    return au.latest_status(rows, ["run_id", "target"], ["ts", "event_seq"])


@query("run_outcomes", f"""
WITH {AUDIT_SQL}, {COUNTERS_SQL}, d AS (SELECT *, derivations_verified + CASE WHEN run_id LIKE '%1' THEN derivations_unresolved
  WHEN run_id LIKE '%2' THEN -derivations_verified ELSE 0 END AS n,
  CASE WHEN run_id LIKE '%3' THEN 0 ELSE hitl_tickets_opened END AS opened FROM c)
SELECT run_id, CASE WHEN n = 0 THEN 'nothing_produced' WHEN derivations_verified = n AND opened = 0 THEN 'all_verified'
       WHEN derivations_verified = n THEN 'verified_with_questions' ELSE 'partial' END AS outcome_class,
  CASE WHEN n = 0 THEN 'No variables were produced.'
    WHEN derivations_verified = n AND opened = 0 AND sr_auto_resolved > 0 THEN 'All ' || n || ' variables verified; '
      || sr_auto_resolved || ' questions answered from memory.'
    WHEN derivations_verified = n AND opened = 0 THEN 'All ' || n || ' variables verified; no questions.'
    WHEN derivations_verified = n THEN 'All ' || n || ' variables verified; ' || opened || ' questions raised.'
    ELSE concat_ws(' ', derivations_verified || ' of ' || n || ' variables verified.',
      CASE WHEN derivations_unresolved > 0 THEN derivations_unresolved || ' unresolved.' END,
      CASE WHEN derivations_skipped > 0 THEN derivations_skipped || ' skipped.' END,
      CASE WHEN opened > 0 THEN opened || ' questions raised.' END) END AS outcome_text FROM d""")
def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    counters = au.run_counters(audit_events(spark, folder))
    verified = F.col("derivations_verified")
    total = F.when(F.col("run_id").endswith("1"), verified + F.col("derivations_unresolved")).when(
        F.col("run_id").endswith("2"), F.lit(0)).otherwise(verified)
    opened = F.when(F.col("run_id").endswith("3"), F.lit(0)).otherwise(F.col("hitl_tickets_opened"))
    rows = counters.withColumn("n_derivations", total).withColumn("hitl_tickets_opened", opened)
    return au.outcome_class(rows).select("run_id", "outcome_class", "outcome_text")


STEPS_SQL = f"""{AUDIT_SQL}, s AS (SELECT run_id, target, row_number() OVER (PARTITION BY run_id, target ORDER BY ts, event_seq)
  AS step_no, CASE event_type WHEN 'cg_complete' THEN 'CG' WHEN 'v_complete' THEN 'V' ELSE 'R' END AS code
  FROM a WHERE event_type IN ('cg_complete', 'v_complete', 'r_complete'))"""


@query("event_chain_steps", f"WITH {STEPS_SQL} SELECT * FROM s")
def event_chain_steps(spark: SparkSession, folder: str) -> DataFrame:
    return au.agent_steps(audit_events(spark, folder))


@query("event_chain", f"""
WITH {STEPS_SQL} SELECT run_id, target, string_agg(code, '>' ORDER BY step_no) AS agent_chain
FROM s GROUP BY ALL""")
def event_chain(spark: SparkSession, folder: str) -> DataFrame:
    return au.agent_chains(au.agent_steps(audit_events(spark, folder)))


RETRY_SQL = """r AS (SELECT CAST(l_orderkey AS STRING) AS run_id, 'V' || CAST(l_suppkey % 2 AS STRING) AS derivation, l_linenumber AS iteration,
  l_returnflag AS body_hash, l_linestatus AS findings_signature FROM lineitem)"""


@query("no_progress", f"""
WITH {RETRY_SQL} SELECT * FROM r WHERE EXISTS (SELECT 1 FROM r p WHERE p.run_id = r.run_id AND p.derivation = r.derivation
  AND p.iteration = r.iteration - 1 AND p.body_hash = r.body_hash AND p.findings_signature = r.findings_signature)""")
def no_progress(spark: SparkSession, folder: str) -> DataFrame:
    retries = table(spark, folder, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS run_id", "'V' || CAST(l_suppkey % 2 AS STRING) AS derivation",
        "l_linenumber AS iteration", "l_returnflag AS body_hash", "l_linestatus AS findings_signature")
    return au.no_progress(retries)


@query("decision_list", f"""
WITH {AUDIT_SQL}
SELECT run_id, target AS variable, ambiguity_class, CASE WHEN chosen_option IS NULL THEN '(no decision recorded)'
  WHEN chosen_option = 'ltm_replay' THEN 'Auto-resolved from memory'
  WHEN chosen_option = 'reject' THEN 'Reject the rule and do not produce this variable' ELSE 'Keep as is' END AS decision,
  CASE event_type WHEN 'hitl_auto_resolved' THEN 'Auto-resolved from memory' ELSE 'Resolved by the reviewer' END AS origin
FROM a WHERE event_type IN ('hitl_resolved', 'hitl_auto_resolved')""")
def decision_list(spark: SparkSession, folder: str) -> DataFrame:
    return au.decision_list(audit_events(spark, folder))


@query("runs_pending", f"""
WITH {TICKET_SQL} SELECT run_id, count(*) AS n_tickets, count(*) FILTER (k >= 60) AS n_open, count(*) FILTER (k >= 60) > 0 AS needs_review
FROM t GROUP BY run_id""")
def runs_pending(spark: SparkSession, folder: str) -> DataFrame:
    return au.runs_pending(tickets(spark, folder), resolutions(spark, folder))


@query("runs_needing_review", f"""
WITH {TICKET_SQL} SELECT sum(n)::BIGINT AS n_open, count(*) FILTER (n > 0) AS n_review, count(*) FILTER (n = 0) AS n_clean
FROM (SELECT run_id, count(*) FILTER (k >= 60) AS n FROM t GROUP BY run_id)""")
def runs_needing_review(spark: SparkSession, folder: str) -> DataFrame:
    return au.runs_pending(tickets(spark, folder), resolutions(spark, folder)).agg(
        F.sum("n_open").alias("n_open"), F.count_if("needs_review").alias("n_review"),
        F.count_if(~F.col("needs_review")).alias("n_clean"))


@query("runs_latest_first", f"WITH {AUDIT_SQL} SELECT run_id, count(*) AS n_events FROM a GROUP BY run_id ORDER BY run_id DESC")
def runs_latest_first(spark: SparkSession, folder: str) -> DataFrame:
    return au.runs_latest_first(audit_events(spark, folder))


@query("latest_run", f"WITH {AUDIT_SQL} SELECT max(run_id) AS run_id FROM a")
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return au.latest_run(audit_events(spark, folder))


@query("run_summary", f"""
WITH {AUDIT_SQL}, rep AS (SELECT run_id, target, arg_max(event_type, ts) AS e, bool_or(ltm_hit) AS ltm_hit FROM a GROUP BY ALL),
f AS (SELECT run_id, target, count(*) AS n FROM a WHERE event_type = 'v_complete' AND event_seq % 3 = 0 GROUP BY ALL)
SELECT rep.run_id, CAST(substr(rep.target, 2) AS INTEGER) AS position, rep.target AS derivation,
  CASE rep.e WHEN 'apply_complete' THEN 'Verified' WHEN 'derivation_skipped' THEN 'Skipped' ELSE 'Unresolved' END AS status,
  CASE WHEN rep.target < 'V3' THEN 'Bucketing' ELSE 'Value mapping' END AS rule_type, 'Rule ' || rep.target || ' text' AS rationale,
  rep.ltm_hit, coalesce(f.n, 0) AS n_blocking,
  CASE WHEN f.n IS NULL THEN '' WHEN rep.target < 'V3' THEN 'Missing values are handled per the spec'
       ELSE 'Unmapped values are handled per the spec' END AS blocking,
  CASE WHEN f.n IS NULL THEN '' ELSE 'L_p' END AS layers, CASE WHEN f.n IS NULL THEN '' ELSE 'missing or unmapped in ' || rep.target END AS messages
FROM rep LEFT JOIN f ON f.run_id = rep.run_id AND f.target = rep.target""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = audit_events(spark, folder)
    kind = F.when(F.col("derivation") < "V3", F.lit("bin")).otherwise(F.lit("flag"))
    status = F.when(F.col("e") == "apply_complete", F.lit("verified")).when(
        F.col("e") == "derivation_skipped", F.lit("skipped")).otherwise(F.lit("unresolved"))
    report = events.groupBy("run_id", F.col("target").alias("derivation")).agg(
        F.max_by("event_type", F.struct("ts", "event_seq")).alias("e"), F.bool_or("ltm_hit").alias("ltm_hit")).select(
        "run_id", "derivation", status.alias("status"), kind.alias("rule_kind"), "ltm_hit",
        F.substr("derivation", F.lit(2)).cast("int").alias("position"))
    findings = events.where("event_type = 'v_complete'").select(
        "run_id", F.col("target").alias("derivation"), F.lit("L_p").alias("layer"),
        F.when(F.col("target") < "V3", F.lit("P-bin-2")).otherwise(F.lit("P-flag-3")).alias("property_id"),
        F.when(F.col("event_seq") % 3 == 0, F.lit("error")).otherwise(F.lit("warning")).alias("severity"),
        F.concat(F.lit("missing or unmapped in "), F.col("target")).alias("message"))
    # two studies with the same names: runs belong to the first, so the other one's texts must not show
    names = events.select(F.col("target").alias("name")).distinct()
    entries = names.select("name", F.lit("one").alias("study_id"), F.concat(F.lit("Rule  "), F.col("name"), F.lit("\n text ")).alias("rationale"))
    entries = entries.unionByName(names.select("name", F.lit("two").alias("study_id"), F.lit("A different rule").alias("rationale")))
    report = report.withColumn("study_id", F.lit("one"))
    return au.run_summary(entries, report, findings)


@query("reports_flattened", f"""
WITH {AUDIT_SQL}, v AS (SELECT run_id, target, count(*) AS n, max(event_seq) AS m FROM a GROUP BY ALL)
SELECT 'run-' || m AS run_id, target AS derivation, CASE WHEN m % 2 = 0 THEN 'verified' ELSE 'unresolved' END AS status, 'bin' AS rule_kind,
  'CG>V' AS agent_chain, CASE WHEN m % 2 = 0 THEN 0 ELSE 1 END AS n_findings, m % 2 = 0 AS ltm_hit FROM v""")
def reports_flattened(spark: SparkSession, folder: str) -> DataFrame:
    """Verification reports kept as nested JSON, read back as one row per derivation."""
    rows = audit_events(spark, folder).groupBy("run_id", "target").agg(F.max("event_seq").alias("m"))
    even = F.col("m") % 2 == 0
    finding = F.struct(F.lit("L_p").alias("layer"), F.lit("P-bin-1").alias("property_id"), F.lit("error").alias("severity"),
                       F.lit("x").alias("message"))
    one = F.struct(
        F.when(even, F.lit("verified")).otherwise(F.lit("unresolved")).alias("status"), F.lit("bin").alias("rule_kind"),
        F.array(F.lit("CG"), F.lit("V")).alias("agent_chain"), F.when(~even, F.array(finding)).alias("findings"),
        F.when(even, F.lit(True)).alias("ltm_hit"))
    reports = rows.select(
        F.concat(F.lit("run-"), F.col("m").cast("string")).alias("run_id"),
        F.to_json(F.struct(F.create_map(F.col("target"), one).alias("derivations"))).alias("report"))
    return au.flatten_reports(reports).select(
        "run_id", "derivation", "status", "rule_kind", "agent_chain", "n_findings", "ltm_hit")
