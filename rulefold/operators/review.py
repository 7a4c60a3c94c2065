"""Review of spec entries: ambiguity detection, tickets, decisions and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.fixed_values import AMBIGUITY_OPTIONS
from rulefold.functions.labels import label_of
from rulefold.functions.signatures import signature
from rulefold.operators.memory import last_per_key, lookup


def canonical_body(body: Column) -> Column:
    """A body's JSON without blanks and with its keys in order at every depth; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(body)), body)


def entry_signature() -> Column:
    """Signature over everything a decision depends on: name, kind, inputs, body, rationale and notes.

    The body counts by content: spellings with other blanks or another order of keys have one signature.
    """
    return signature(
        ambiguity_notes=F.coalesce("ambiguity_notes", F.lit("")), inputs=F.col("inputs"), name=F.col("name"),
        rationale=F.col("rationale"), rule_body=canonical_body(F.col("rule_body")), rule_kind=F.col("rule_kind"),
    )


def _has_notes() -> Column:
    return F.coalesce(F.col("ambiguity_notes").rlike(r"\S"), F.lit(False))


def ambiguity_class() -> Column:
    """Class of an entry's open question, from its notes; NULL when the notes are blank."""
    notes = F.lower("ambiguity_notes")
    return F.when(
        _has_notes(),
        F.when((F.col("rule_kind") == "flag") & (notes.contains("unknown") | notes.contains("unmapped")),
               F.lit("unmapped_value_undefined"))
        .when((F.col("rule_kind") == "bin") & (notes.contains("null") | notes.contains("missing")),
              F.lit("null_handling_undefined"))
        .otherwise(F.lit("rationale_undefined")),
    )


def options_for(klass: Column) -> Column:
    out = F
    for name, options in AMBIGUITY_OPTIONS.items():
        out = out.when(klass == name, F.array(*[F.lit(o) for o in options]))
    return out.otherwise(F.array().cast("array<string>"))


def review(entries: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """One row per entry that has a remembered decision or an open question.

    A remembered decision comes first and needs no ticket; blank notes raise no question.
    """
    rows = entries.withColumn("signature", entry_signature())
    if resolutions is None:
        rows = rows.withColumn("resolution", F.lit(None).cast("string")).withColumn("auto_resolved", F.lit(False))
    else:
        rows = lookup(rows, resolutions, ["signature"], ["resolution"], "auto_resolved")
    klass = F.when(F.col("auto_resolved"), F.lit("ltm_cached")).otherwise(ambiguity_class())
    message = F.when(F.col("auto_resolved"), F.concat(F.lit("remembered decision "), F.col("signature"))).otherwise(
        F.col("ambiguity_notes"))
    return rows.withColumn("ambiguity_class", klass).where("ambiguity_class IS NOT NULL").select(
        "study_id", F.col("name").alias("target"), "signature", "ambiguity_class", message.alias("message"),
        options_for(F.col("ambiguity_class")).alias("options_offered"), "auto_resolved", "resolution")


def open_tickets(reviewed: DataFrame, run_id: Column, opened_at: Column) -> DataFrame:
    """Tickets for the questions memory could not answer. The id is derived, so a re-run gives the same one."""
    rows = reviewed.where("NOT auto_resolved").withColumn("run_id", run_id)
    event_id = F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws("|", "run_id", "study_id", "target", "signature"), 256), 1, 12))
    return rows.select(
        "run_id", event_id.alias("event_id"), F.lit("ambiguity").alias("ticket_kind"), "target",
        F.col("message").alias("prompt"), "options_offered",
        F.create_map(F.lit("ambiguity_class"), F.col("ambiguity_class"), F.lit("ambiguity_signature"), F.col("signature"))
        .alias("context"),
        opened_at.alias("opened_at"))


def review_plan(entries: DataFrame, resolutions: DataFrame, mode: str = "stub") -> DataFrame:
    """What the review will do per entry: memory / skip / stub / call."""
    rows = lookup(entries.withColumn("signature", entry_signature()), resolutions, ["signature"], [], "hit")
    plan = (
        F.when(F.col("hit"), F.lit("memory")).when(~_has_notes(), F.lit("skip"))
        .otherwise(F.lit("call" if mode == "live" else "stub"))
    )
    return rows.select("study_id", "name", "rule_kind", plan.alias("plan"))


def pending(tickets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Tickets without a resolution."""
    return tickets.join(resolutions.select("event_id"), "event_id", "left_anti")


def ticket_label(target: Column, ticket_kind: Column) -> Column:
    name = F.when(F.coalesce(F.length(target), F.lit(0)) > 0, target).otherwise(F.lit("unspecified variable"))
    return F.concat(name, F.lit(" -- "), label_of("ticket_kind", ticket_kind))


def replay(tickets: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """Answer tickets from recorded decisions on (ticket_kind, target); the last decision of a pair wins."""
    keys = ["ticket_kind", "target"]
    latest = last_per_key(decisions, keys, [order]).withColumn("_found", F.lit(True))
    joined = tickets.select("event_id", *keys).join(latest, keys, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.select(
        "event_id", *keys, found.alias("resolved"),
        F.when(found, F.coalesce("chosen_option", F.lit(""))).alias("chosen_option"),
        F.when(found, F.coalesce("body_patch", F.lit("{}"))).alias("body_patch"),
        F.when(found, F.coalesce("free_text_rationale", F.lit(""))).alias("free_text_rationale"),
        F.when(found, F.coalesce("resolved_by", F.lit("auto-replay"))).alias("resolved_by"))
