"""Memory of validated rules and decisions as plain tables.

rule_patterns(rule_kind, body_signature, body, first_seen_run_id, first_seen_at, approval_event_id, status)
ambiguity_resolutions(signature, resolution, resolved_run_id, resolved_at, resolution_event_id)
feedback_events(event_id, ticket_kind, target, options_offered, resolution, resolved_by, resolved_at,
free_text_rationale)

Joins carry no broadcast hint: memory grows with use, so the size is left to adaptive execution to measure.
The probing table is always the left side, where adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {
    "rule_patterns": ["rule_kind", "body_signature"],
    "ambiguity_resolutions": ["signature"],
    "feedback_events": ["event_id"],
}
SEEN_AT = {"rule_patterns": "first_seen_at", "ambiguity_resolutions": "resolved_at", "feedback_events": "resolved_at"}


def lookup(rows: DataFrame, memory: DataFrame, keys: list[str], keep: list[str], hit: str = "ltm_hit") -> DataFrame:
    """Left join on the memory keys; `hit` tells whether an entry was found. Of entries written twice for a key, the first counts."""
    seen = [c for c in dict.fromkeys(SEEN_AT.values()) if c in memory.columns and c not in keep]
    side = first_per_key(memory.select(*keys, *keep, *seen), keys, seen) if keep or seen else memory.select(*keys).distinct()
    side = side.select(*keys, *keep, F.lit(True).alias(hit))
    return rows.join(side, keys, "left").withColumn(hit, F.coalesce(F.col(hit), F.lit(False)))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row of every key. An aggregate, so a key held by a third of all rows still combines per task."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of every key."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def new_rows(existing: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """Rows to append so that the first writer of every key wins."""
    keys = KEYS[table]
    return first_per_key(rows, keys, [SEEN_AT[table]]).join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    return existing.unionByName(new_rows(existing, rows, table).select(*existing.columns))


def promote_rules(patterns: DataFrame, verified: DataFrame) -> DataFrame:
    """New pattern rows from verified derivations that were not served from memory.

    verified(run_id, ts, rule_kind, body_signature, body, passed, ltm_hit).
    """
    fresh = verified.where("passed AND NOT ltm_hit AND body_signature IS NOT NULL").select(
        "rule_kind", "body_signature", "body", F.col("run_id").alias("first_seen_run_id"),
        F.col("ts").alias("first_seen_at"), F.lit(None).cast("string").alias("approval_event_id"),
        F.lit("validated").alias("status"))
    return new_rows(patterns, fresh, "rule_patterns")


def promote_decisions(resolutions: DataFrame, decided: DataFrame) -> DataFrame:
    """New resolution rows from decided tickets (signature, resolution, run_id, resolved_at, event_id)."""
    fresh = decided.select(
        "signature", "resolution", F.col("run_id").alias("resolved_run_id"), "resolved_at",
        F.col("event_id").alias("resolution_event_id"))
    return new_rows(resolutions, fresh, "ambiguity_resolutions")


def feedback_rows(tickets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Feedback log: each resolution with the options its ticket offered."""
    answer = F.to_json(F.struct("body_patch", "chosen_option"))
    return resolutions.join(tickets.select("event_id", "options_offered"), "event_id", "left").select(
        "event_id", "ticket_kind", "target",
        F.when(F.size("options_offered") > 0, F.to_json(F.struct(F.col("options_offered").alias("options"))))
        .alias("options_offered"),
        answer.alias("resolution"), "resolved_by", "resolved_at", "free_text_rationale")
