"""Streams over the events table; results are written exactly once to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.plans.spec import Spec
from rulefold.queries import query
from rulefold.queries.audits import AUDIT, AUDIT_SQL
from rulefold.queries.derivations import _cond
from rulefold.streaming.derive import derive_stream, live_counters
from rulefold.streaming.runs import read_stream, run_available, run_updates
from rulefold.streaming.tickets import first_answer, first_answers, match_with_timeout

def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_stream(spark, f"{folder}/events.parquet")


STREAM_SPEC = Spec.from_entries([
    {"name": "VALUE_BAND", "inputs": ["value"], "rule_kind": "bin",
     "rule_body": {"edges": [10, 100], "labels": ["low", "mid", "high"]}},
    {"name": "KIND", "inputs": ["event_type"], "rule_kind": "flag",
     "rule_body": {"map": {"purchase": "P", "signup": "S", "view": "V", "click": "C"}, "unmapped_handling": "error"}},
    {"name": "KEEP", "inputs": ["user_id"], "rule_kind": "compound",
     "rule_body": {"conditions": [_cond("VALUE_BAND", "!=", "low"), _cond("user_id", "<", 100)]}},
])


@query("stream_apply_spec", """
SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS "VALUE_BAND",
  CASE event_type WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'S' WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' END AS "KIND",
  CASE WHEN value >= 10 AND user_id < 100 THEN 'Y' ELSE 'N' END AS "KEEP",
  CASE WHEN event_type = 'error' THEN 'KIND:unmapped' ELSE '' END AS violations FROM events""")
def stream_apply_spec(spark: SparkSession, folder: str) -> DataFrame:
    done = derive_stream(_events(spark, folder), STREAM_SPEC)
    rows = done.select("event_id", *STREAM_SPEC.names(), F.array_join("_violations", ",").alias("violations"))
    return run_available(rows, "apply-spec")


@query("stream_quarantine", """
SELECT event_id, event_type <> 'error' AS accepted FROM events""")
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Good and diverted rows in separate folders of one exactly-once sink."""
    done = derive_stream(_events(spark, folder), STREAM_SPEC)
    rows = done.select("event_id", (F.size("_violations") == 0).alias("accepted"))
    return run_available(rows, "quarantine", partition_by=["accepted"])


def _tickets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as tickets; those of 10 or more are answered `k` seconds later."""
    at = F.col("ts").cast("timestamp")
    tickets = _events(spark, folder).where("event_type = 'purchase'").select("event_id", at.alias("opened_at"))
    resolutions = _events(spark, folder).where("event_type = 'purchase' AND value >= 10").select(
        "event_id", (at + F.make_dt_interval(secs=F.get_json_object("props", "$.k").cast("decimal(18,6)"))).alias("resolved_at"))
    return tickets, resolutions


@query("stream_first_answer", """
WITH t AS (SELECT event_id, user_id, ts AS opened_at FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS resolved_at FROM events
      WHERE event_type = 'purchase' AND value >= 10
      UNION ALL SELECT event_id, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER) // 2) FROM events
      WHERE event_type = 'purchase' AND user_id % 3 = 0
      UNION ALL SELECT event_id, ts - INTERVAL 1 SECOND FROM events WHERE event_type = 'purchase' AND user_id % 3 = 1),
w AS (SELECT epoch_ms(least((SELECT max(opened_at) FROM t), (SELECT max(resolved_at) FROM r))) - 600000 AS mark),
m AS (SELECT t.event_id, t.user_id, t.opened_at, min(r.resolved_at) AS resolved_at
      FROM t LEFT JOIN r ON r.event_id = t.event_id AND r.resolved_at BETWEEN t.opened_at AND t.opened_at + INTERVAL 60 SECOND GROUP BY ALL)
SELECT event_id, user_id, epoch_us(opened_at) AS opened_us, epoch_us(resolved_at) AS resolved_us, resolved_at IS NULL AS timed_out
FROM m, w WHERE epoch_us(coalesce(resolved_at, opened_at + INTERVAL 60 SECOND)) // 1000 + 1 < mark""")
def stream_first_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as tickets with up to three answers, one of them too early: each ticket leaves once, with its first answer in time."""
    at, k = F.col("ts").cast("timestamp"), F.get_json_object("props", "$.k").cast("int")
    bought = _events(spark, folder).where("event_type = 'purchase'")
    answers = [
        F.when(F.col("value") >= 10, at + F.make_dt_interval(secs=k.cast("decimal(18,6)"))),
        F.when(F.col("user_id") % 3 == 0, at + F.make_dt_interval(secs=F.floor(k / 2).cast("decimal(18,6)"))),
        F.when(F.col("user_id") % 3 == 1, at - F.make_dt_interval(secs=F.lit(1).cast("decimal(18,6)")))]
    resolutions = bought.select("event_id", F.explode(F.array_compact(F.array(*answers))).alias("resolved_at"))
    tickets = _events(spark, folder).where("event_type = 'purchase'").select("event_id", "user_id", at.alias("opened_at"))
    done = run_available(first_answer(tickets, resolutions), "first-answer")
    return done.select(
        "event_id", "user_id", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("resolved_at").alias("resolved_us"), "timed_out")


@query("stream_ticket_timeout", """
WITH t AS (SELECT event_id, ts AS opened_at FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS resolved_at FROM events
      WHERE event_type = 'purchase' AND value >= 10),
w AS (SELECT date_trunc('millisecond', least((SELECT max(opened_at) FROM t), (SELECT max(resolved_at) FROM r)))
             - INTERVAL 10 MINUTE AS mark)
SELECT t.event_id, epoch_us(t.opened_at) AS opened_us, epoch_us(r.resolved_at) AS resolved_us, r.event_id IS NULL AS timed_out
FROM t LEFT JOIN r ON r.event_id = t.event_id AND r.resolved_at BETWEEN t.opened_at AND t.opened_at + INTERVAL 60 SECOND, w
WHERE r.event_id IS NOT NULL OR t.opened_at + INTERVAL 60 SECOND <= w.mark""")
def stream_ticket_timeout(spark: SparkSession, folder: str) -> DataFrame:
    tickets, resolutions = _tickets(spark, folder)
    done = first_answers(run_available(match_with_timeout(tickets, resolutions), "ticket-timeout"))
    return done.select(
        "event_id", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("resolved_at").alias("resolved_us"), "timed_out")


@query("stream_live_counters", f"""
WITH {AUDIT_SQL}
SELECT epoch_us(date_trunc('hour', ts)) AS window_us, run_id, event_type, count(*) AS n_events FROM a GROUP BY ALL""")
def stream_live_counters(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).selectExpr(*[f"{e} AS {n}" for n, e in AUDIT.items()])
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    done = run_updates(live_counters(events), "live-counters", ["window_start", "window_end", "run_id", "event_type"])
    return done.select(F.unix_micros("window_start").alias("window_us"), "run_id", "event_type", "n_events")
