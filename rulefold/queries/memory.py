"""Memory, review and tickets over rows derived from the events and parts tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.fixed_values import AMBIGUITY_OPTIONS
from rulefold.operators import memory as mem
from rulefold.operators import memory_store as store
from rulefold.operators import review as rv
from rulefold.queries import query
from rulefold.queries.libraries import LIBRARY_SQL, SORTED_BODY, library
from rulefold.session import fresh_folder, table
from rulefold.streaming.runs import read_stream

# Rule patterns seen by runs: kind = event type, signature from the event's number, run = user.
SEEN_SQL = """seen AS (SELECT event_type AS rule_kind, 'b' || json_extract_string(props, '$.k') AS body_signature,
  props AS body, 'run-' || user_id AS run_id, ts, user_id, event_id FROM events)"""
# What memory held before the runs under study.
EARLY = "ts < timestamp '2024-01-03 00:00:00'"
DAY_ONE = "ts < timestamp '2024-01-02 12:00:00'"
FIRST = ("SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY rule_kind, body_signature "
         "ORDER BY ts, body, run_id) = 1")


def seen(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("rule_kind"), F.concat(F.lit("b"), F.get_json_object("props", "$.k")).alias("body_signature"),
        F.col("props").alias("body"), F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), "ts",
        "user_id", "event_id")


def _patterns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "rule_kind", "body_signature", "body", F.col("run_id").alias("first_seen_run_id"), F.col("ts").alias("first_seen_at"),
        F.lit(None).cast("string").alias("approval_event_id"), F.lit("validated").alias("status"))


SHOWN = ["rule_kind", "body_signature", "body", "first_seen_run_id", "status"]


@query("memory_upsert_first_wins", f"""
WITH {SEEN_SQL}, old AS (SELECT * FROM seen WHERE {EARLY}), new AS (SELECT * FROM seen WHERE NOT ({EARLY})),
o AS ({FIRST.format('old')}), n AS ({FIRST.format('new')})
SELECT rule_kind, body_signature, body, run_id AS first_seen_run_id, 'validated' AS status FROM o
UNION ALL SELECT rule_kind, body_signature, body, run_id, 'validated' FROM n
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rule_kind = n.rule_kind AND o.body_signature = n.body_signature)""")
def memory_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = seen(spark, folder)
    keys = mem.KEYS["rule_patterns"]
    existing = mem.first_per_key(_patterns(rows.where(EARLY)), keys, ["first_seen_at"])
    return mem.upserted(existing, _patterns(rows.where(f"NOT ({EARLY})")), "rule_patterns").select(*SHOWN)


PATTERNS = ("rule_kind string, body_signature string, body string, first_seen_run_id string, first_seen_at timestamp, "
            "approval_event_id string, status string")


@query("memory_two_writers", f"""
WITH {SEEN_SQL}, b AS ({FIRST.format("(SELECT * FROM seen WHERE user_id % 3 = 0)")}), a AS ({FIRST.format("(SELECT * FROM seen WHERE user_id % 3 <> 0)")})
SELECT rule_kind, body_signature, body, run_id AS first_seen_run_id, 'validated' AS status FROM b
UNION ALL SELECT rule_kind, body_signature, body, run_id, 'validated' FROM a
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rule_kind = a.rule_kind AND b.body_signature = a.body_signature)""")
def memory_two_writers(spark: SparkSession, folder: str) -> DataFrame:
    """A stream and a batch job write one memory: the stream's rows are compacted first, then the job's batches come, one of them twice."""
    path = fresh_folder(spark, "memory-store")
    kind, number = F.col("event_type").alias("rule_kind"), F.concat(F.lit("b"), F.get_json_object("props", "$.k")).alias("body_signature")
    columns = [kind, number, F.col("props").alias("body"), F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), "ts", "user_id"]
    stream = _patterns(read_stream(spark, f"{folder}/events.parquet").select(*columns).where("user_id % 3 = 0"))
    run = stream.writeStream.foreachBatch(store.batch_sink(path, "rule_patterns", "stream")).option(
        "checkpointLocation", fresh_folder(spark, "memory-stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    store.compact(spark, path, "rule_patterns", PATTERNS)
    rows = seen(spark, folder).where("user_id % 3 <> 0")
    for part in (1, 0, 1):
        store.add_batch(_patterns(rows.where(F.col("event_id") % 2 == part)), path, "rule_patterns", "job", part)
    return store.read_store(spark, path, "rule_patterns", PATTERNS).select(*SHOWN)


@query("memory_lookup", f"""
WITH {SEEN_SQL}, o AS ({FIRST.format("(SELECT * FROM seen WHERE " + EARLY + ")")})
SELECT s.event_id, o.run_id AS first_seen_run_id, o.rule_kind IS NOT NULL AS ltm_hit
FROM seen s LEFT JOIN o ON o.rule_kind = s.rule_kind AND o.body_signature = s.body_signature""")
def memory_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = seen(spark, folder)
    keys = mem.KEYS["rule_patterns"]
    patterns = mem.first_per_key(_patterns(rows.where(EARLY)), keys, ["first_seen_at"])
    return mem.lookup(rows, patterns, keys, ["first_seen_run_id"]).select("event_id", "first_seen_run_id", "ltm_hit")


@query("memory_promote_rules", f"""
WITH {SEEN_SQL}, o AS ({FIRST.format("(SELECT * FROM seen WHERE " + EARLY + ")")}),
n AS ({FIRST.format("(SELECT * FROM seen WHERE event_id % 3 <> 0 AND event_id % 5 <> 0)")})
SELECT rule_kind, body_signature, body, run_id AS first_seen_run_id, 'validated' AS status FROM n
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rule_kind = n.rule_kind AND o.body_signature = n.body_signature)""")
def memory_promote_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = seen(spark, folder)
    existing = mem.first_per_key(_patterns(rows.where(EARLY)), mem.KEYS["rule_patterns"], ["first_seen_at"])
    verified = rows.select(
        "run_id", "ts", "rule_kind", "body_signature", "body", (F.col("event_id") % 3 != 0).alias("passed"),
        (F.col("event_id") % 5 == 0).alias("ltm_hit"))
    return mem.promote_rules(existing, verified).select(*SHOWN)


@query("memory_promote_decisions", f"""
WITH d AS (SELECT event_type AS event_type_, json_extract_string(props, '$.k') AS signature, '{{"chosen_option":"' || event_type || '"}}' AS resolution,
                  'run-' || user_id AS run_id, ts, event_id, user_id FROM events),
o AS (SELECT DISTINCT signature FROM d WHERE event_type_ = 'error' AND {DAY_ONE})
SELECT signature, resolution, run_id AS resolved_run_id, 'evt-' || event_id AS resolution_event_id FROM d
WHERE signature NOT IN (SELECT signature FROM o)
QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ts, resolution, run_id) = 1""")
def memory_promote_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").alias("signature"),
        F.to_json(F.struct(F.col("event_type").alias("chosen_option"))).alias("resolution"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("ts").alias("resolved_at"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"), "ts", "event_type")
    existing = rows.where(f"event_type = 'error' AND {DAY_ONE}").select("signature").distinct()
    return mem.promote_decisions(existing, rows.drop("ts", "event_type")).select("signature", "resolution", "resolved_run_id", "resolution_event_id")


NOTES = "regexp_matches(coalesce(ambiguity_notes, ''), '\\S')"
CLASS_SQL = f"""CASE WHEN NOT {NOTES} THEN NULL
  WHEN rule_kind = 'flag' AND (contains(lower(ambiguity_notes), 'unknown') OR contains(lower(ambiguity_notes), 'unmapped'))
    THEN 'unmapped_value_undefined'
  WHEN rule_kind = 'bin' AND (contains(lower(ambiguity_notes), 'null') OR contains(lower(ambiguity_notes), 'missing'))
    THEN 'null_handling_undefined' ELSE 'rationale_undefined' END"""
OPTIONS_SQL = "CASE ambiguity_class " + " ".join(
    f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in AMBIGUITY_OPTIONS.items()) + " ELSE '' END"
SIGNED_SQL = f"""{LIBRARY_SQL}, g AS (SELECT *, {CLASS_SQL} AS klass, left(sha256(CAST(to_json({{
  'ambiguity_notes': coalesce(ambiguity_notes, ''), 'inputs': string_split(inputs_csv, ','), 'name': name,
  'rationale': rationale, 'rule_body': {SORTED_BODY}, 'rule_kind': rule_kind}}) AS VARCHAR)), 16) AS signature FROM l)"""


@query("ambiguity_library", f"""
WITH {SIGNED_SQL}, r AS (SELECT study_id, name AS target, signature, klass AS ambiguity_class, ambiguity_notes AS message
                         FROM g WHERE klass IS NOT NULL)
SELECT study_id, target, signature, ambiguity_class, message, {OPTIONS_SQL} AS options FROM r""")
def ambiguity_library(spark: SparkSession, folder: str) -> DataFrame:
    # half of the bodies in another spelling: their signatures stay
    entries = library(spark, folder)
    spaced = F.when(F.crc32("rule_body") % 2 == 0, F.replace("rule_body", F.lit('":'), F.lit('" : '))).otherwise(F.col("rule_body"))
    return rv.review(entries.withColumn("rule_body", spaced)).select(
        "study_id", "target", "signature", "ambiguity_class", "message", F.array_join("options_offered", ",").alias("options"))


@query("ambiguity_texts", f"""
SELECT doc_id, {CLASS_SQL} AS ambiguity_class
FROM (SELECT doc_id, text AS ambiguity_notes, CASE WHEN lang = 'en' THEN 'flag' WHEN lang = 'de' THEN 'bin' ELSE 'compound' END
      AS rule_kind FROM documents)""")
def ambiguity_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document's text read as reviewer notes, over the whole text."""
    kind = F.when(F.col("lang") == "en", F.lit("flag")).when(F.col("lang") == "de", F.lit("bin")).otherwise(F.lit("compound"))
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("ambiguity_notes"), kind.alias("rule_kind"))
    return rows.select("doc_id", rv.ambiguity_class().alias("ambiguity_class"))


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions kept for the entries of the parts whose type comes early in the alphabet."""
    rows = library(spark, folder, "p_type").where("p_type < 'M'")
    return rows.select(rv.entry_signature().alias("signature"), F.lit('{"chosen_option":"accept_default"}').alias("resolution")).distinct()


@query("review_with_memory", f"""
WITH {SIGNED_SQL}, m AS (SELECT DISTINCT signature FROM g WHERE p_type < 'M')
SELECT study_id, name AS target, g.signature, CASE WHEN m.signature IS NOT NULL THEN 'ltm_cached' ELSE klass END AS ambiguity_class,
       m.signature IS NOT NULL AS auto_resolved,
       CASE WHEN m.signature IS NOT NULL THEN '{{"chosen_option":"accept_default"}}' END AS resolution
FROM g LEFT JOIN m ON m.signature = g.signature WHERE m.signature IS NOT NULL OR klass IS NOT NULL""")
def review_with_memory(spark: SparkSession, folder: str) -> DataFrame:
    return rv.review(library(spark, folder), remembered(spark, folder)).select(
        "study_id", "target", "signature", "ambiguity_class", "auto_resolved", "resolution")


@query("review_tickets", f"""
WITH {SIGNED_SQL}
SELECT 'run-1' AS run_id, 'evt-' || substr(sha256(concat_ws('|', 'run-1', study_id, name, signature)), 1, 12) AS event_id,
       'ambiguity' AS ticket_kind, name AS target, klass AS ambiguity_class,
       name || ' -- Ambiguous rule -- needs your judgement' AS label
FROM g WHERE klass IS NOT NULL AND signature NOT IN (SELECT signature FROM g WHERE p_type < 'M')""")
def review_tickets(spark: SparkSession, folder: str) -> DataFrame:
    reviewed = rv.review(library(spark, folder), remembered(spark, folder))
    tickets = rv.open_tickets(reviewed, F.lit("run-1"), F.lit("2024-01-01T00:00:00+00:00"))
    return tickets.select(
        "run_id", "event_id", "ticket_kind", "target", F.col("context")["ambiguity_class"].alias("ambiguity_class"),
        rv.ticket_label(F.col("target"), F.col("ticket_kind")).alias("label"))


@query("review_plan", f"""
WITH {SIGNED_SQL}, m AS (SELECT DISTINCT signature FROM g WHERE p_type < 'M')
SELECT CASE WHEN m.signature IS NOT NULL THEN 'memory' WHEN NOT {NOTES} THEN 'skip' ELSE 'stub' END AS plan, count(*) AS n_entries
FROM g LEFT JOIN m ON m.signature = g.signature GROUP BY 1""")
def review_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = rv.review_plan(library(spark, folder), remembered(spark, folder))
    return plan.groupBy("plan").agg(F.count(F.lit(1)).alias("n_entries"))


# Tickets are purchases; those with a small number were resolved.
TICKET_SQL = """t AS (SELECT 'evt-' || event_id AS event_id, 'run-' || user_id AS run_id, 'V' || (event_id % 50) AS target,
  CASE event_id % 3 WHEN 0 THEN 'ambiguity' WHEN 1 THEN 'approval' ELSE 'other' END AS ticket_kind,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, ts FROM events WHERE event_type = 'purchase')"""


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'ambiguity' WHEN 1 THEN 'approval' ELSE 'other' END")
    return table(spark, folder, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("V"), (F.col("event_id") % 50).cast("string")).alias("target"), kind.alias("ticket_kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id", "ts",
        F.array(F.lit("accept_default"), F.lit("reject")).alias("options_offered"))


def resolutions(spark: SparkSession, folder: str) -> DataFrame:
    return tickets(spark, folder).where("k < 60").select(
        "event_id", "ticket_kind", "target", F.lit("reject").alias("chosen_option"), F.lit("{}").alias("body_patch"),
        F.lit("").alias("free_text_rationale"), F.col("run_id").alias("resolved_by"), F.col("ts").alias("resolved_at"))


@query("tickets_open", f"""
WITH {TICKET_SQL}
SELECT event_id, run_id, target || ' -- ' || CASE ticket_kind WHEN 'ambiguity' THEN 'Ambiguous rule -- needs your judgement'
       WHEN 'approval' THEN 'New rule -- needs your approval' ELSE ticket_kind END AS label FROM t WHERE k >= 60""")
def tickets_open(spark: SparkSession, folder: str) -> DataFrame:
    return rv.pending(tickets(spark, folder), resolutions(spark, folder)).select(
        "event_id", "run_id", rv.ticket_label(F.col("target"), F.col("ticket_kind")).alias("label"))


@query("replay_last_wins", f"""
WITH {TICKET_SQL},
d AS (SELECT ticket_kind, target, k, user_id, ts FROM t WHERE ticket_kind <> 'other' AND ts < timestamp '2024-01-20 00:00:00'),
w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ticket_kind, target ORDER BY ts DESC) = 1)
SELECT t.event_id, t.ticket_kind, t.target, w.target IS NOT NULL AS resolved,
       CASE WHEN w.target IS NOT NULL THEN 'option' || w.k END AS chosen_option,
       CASE WHEN w.target IS NOT NULL THEN CASE WHEN w.k % 2 = 0 THEN '{{"k":' || w.k || '}}' ELSE '{{}}' END END AS body_patch,
       CASE WHEN w.target IS NOT NULL THEN CASE WHEN w.k % 3 = 0 THEN 'auto-replay' ELSE 'user' || w.user_id END END AS resolved_by
FROM t LEFT JOIN w ON w.ticket_kind = t.ticket_kind AND w.target = t.target""")
def replay_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = tickets(spark, folder)
    k = F.col("k")
    decisions = rows.where("ticket_kind <> 'other' AND ts < timestamp_ntz '2024-01-20 00:00:00'").select(
        "ticket_kind", "target", F.concat(F.lit("option"), k.cast("string")).alias("chosen_option"),
        F.when(k % 2 == 0, F.to_json(F.struct("k"))).alias("body_patch"),
        F.lit(None).cast("string").alias("free_text_rationale"),
        F.when(k % 3 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("resolved_by"), "ts")
    return rv.replay(rows, decisions, "ts").drop("free_text_rationale")


@query("feedback_log", f"""
WITH {TICKET_SQL}
SELECT event_id, ticket_kind, target, '{{"options":["accept_default","reject"]}}' AS options_offered,
       '{{"body_patch":"{{}}","chosen_option":"reject"}}' AS resolution, run_id AS resolved_by FROM t WHERE k < 60""")
def feedback_log(spark: SparkSession, folder: str) -> DataFrame:
    return mem.feedback_rows(tickets(spark, folder), resolutions(spark, folder)).select(
        "event_id", "ticket_kind", "target", "options_offered", "resolution", "resolved_by")
