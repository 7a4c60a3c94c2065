"""One run of a spec over a dataset: review, derive, verify, remember, record.

The steps are the operators of this package in their usual order. Spec, tickets and memory rows of one run are
configuration-sized; the dataset is touched by the derivation aggregate(s), the verification aggregate and the
final write only.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators import library as lib
from rulefold.operators import memory as mem
from rulefold.operators import review as rv
from rulefold.operators.audit import EVENTS
from rulefold.operators.lineage import with_lineage
from rulefold.operators.verify import Checked, verify
from rulefold.plans.apply import Derived, Outcome, apply_spec
from rulefold.plans.spec import Spec, require_columns

PATTERNS = (
    "rule_kind string, body_signature string, body string, first_seen_run_id string, first_seen_at string, "
    "approval_event_id string, status string"
)
RESOLUTIONS = (
    "signature string, resolution string, resolved_run_id string, resolved_at string, resolution_event_id string"
)

FEEDBACK = (
    "event_id string, ticket_kind string, target string, options_offered string, resolution string, resolved_by string, "
    "resolved_at string, free_text_rationale string"
)


class PendingTickets(RuntimeError):
    """Questions without a decision; `tickets` holds (event_id, target, message)."""

    def __init__(self, tickets: list[tuple[str, str, str]]):
        super().__init__(f"{len(tickets)} question(s) need a decision: {sorted(t for _, t, _ in tickets)}")
        self.tickets = tickets


@dataclass
class Memory:
    """The two tables a run reads and extends."""

    rule_patterns: DataFrame
    ambiguity_resolutions: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Memory:
        return cls(spark.createDataFrame([], PATTERNS), spark.createDataFrame([], RESOLUTIONS))


@dataclass
class Run:
    run_id: str
    derived: Derived
    dataset: DataFrame
    checks: Checked
    counts: dict[str, int]
    events: DataFrame
    new_patterns: DataFrame
    new_resolutions: DataFrame
    feedback: DataFrame
    reviewed: list[dict[str, Any]] = field(default_factory=list)

    def memory_after(self, memory: Memory) -> Memory:
        return Memory(
            memory.rule_patterns.unionByName(self.new_patterns),
            memory.ambiguity_resolutions.unionByName(self.new_resolutions))


def new_run_id() -> str:
    return f"run-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"


def run_spec(
    df: DataFrame,
    spec: Spec,
    key: str | list[str],
    *,
    memory: Memory | None = None,
    decisions: list[Mapping[str, Any]] | None = None,
    date_formats: Mapping[str, str] | None = None,
    run_id: str | None = None,
) -> Run:
    """Run a spec. Without `memory` nothing is remembered; open questions without a decision raise PendingTickets.

    Derivations that fail a check leave neither their column nor what reads it in the dataset, the lineage or memory.
    `key` names the column or columns that identify a row.
    """
    spark, run_id = df.sparkSession, run_id or new_run_id()
    now = datetime.datetime.now(datetime.UTC).isoformat()
    log: list[dict[str, Any]] = []

    def record(event_type: str, **fields: Any) -> None:
        log.append({"ts": datetime.datetime.now(datetime.UTC).isoformat(), "run_id": run_id, "event_type": event_type, **fields})

    record("run_start")
    require_columns(spec, df.columns)
    known = memory or Memory.empty(spark)
    reviewed, decided = _review(spec, known, decisions or [], run_id, now, record)
    spec = spec.patched({r["target"]: json.loads(r["body_patch"] or "{}") for r in reviewed})
    require_columns(spec, df.columns)
    derived = apply_spec(df, spec, date_formats=date_formats, on_error="skip")
    record("dag_planned")
    checks = verify(derived.df, derived.rules, derived.bodies, sample=False)
    failed = {r["derivation"] for r in checks.verdicts.where("NOT passed").collect()}

    derived = withheld(derived, failed)
    normal = mem.lookup(
        lib.normalise(spec.entries_df(spark)), known.rule_patterns, mem.KEYS["rule_patterns"], []
    ).collect()
    verified, questions = [], {r["target"]: r["event_id"] for r in reviewed if r["event_id"]}
    lineage: dict[str, dict[str, Any]] = {}
    for row in sorted(normal, key=lambda r: r["name"]):
        name, outcome = row["name"], derived.outcomes[row["name"]]
        done = outcome.status == "verified"
        record("cg_complete", target=name, outcome=row["outcome"], rule_kind=row["rule_kind"],
               body_signature=row["body_signature"], ltm_hit=row["ltm_hit"], reason=row["reason"] or None)
        if done:
            record("v_complete", target=name, passed=True)
            record("apply_complete", target=name, rule_kind=row["rule_kind"])
            verified.append((run_id, now, row["rule_kind"], row["body_signature"], row["body"], True, row["ltm_hit"]))
            lineage[name] = {
                "hitl_event_ids": [questions[name]] if name in questions else [],
                "ltm_pattern_ref": row["body_signature"] if row["ltm_hit"] else None, "body_signature": row["body_signature"]}
        elif outcome.status == "skipped":
            record("derivation_skipped", target=name, reason=outcome.reason)
        else:
            record("derivation_unresolved", target=name, reason=outcome.reason)
    schema = "run_id string, ts string, rule_kind string, body_signature string, body string, passed boolean, ltm_hit boolean"
    remember = memory is not None
    new_patterns = mem.promote_rules(
        known.rule_patterns, spark.createDataFrame(verified if remember else [], schema)).select(*known.rule_patterns.columns)
    new_resolutions = mem.promote_decisions(known.ambiguity_resolutions, spark.createDataFrame(
        decided if remember else [], "signature string, resolution string, run_id string, resolved_at string, event_id string")
    ).select(*known.ambiguity_resolutions.columns)
    counts = {
        "sr_findings": len(reviewed),
        "sr_auto_resolved": sum(r["auto_resolved"] for r in reviewed),
        "hitl_tickets_opened": sum(not r["auto_resolved"] for r in reviewed),
        "cg_ltm_hits": sum(r["ltm_hit"] for r in normal),
        "derivations_verified": len(lineage),
        "derivations_unresolved": len(normal) - len(lineage),
        "derivations_skipped": sum(o.status == "skipped" for o in derived.outcomes.values()),
        "rule_patterns": new_patterns.count(),
        "ambiguity_resolutions": new_resolutions.count(),
    }
    for table in ("rule_patterns", "ambiguity_resolutions"):
        for _ in range(counts[table]):
            record("ltm_write", table=table)
    record("run_complete")
    fields = spark.createDataFrame([], EVENTS).columns
    events = spark.createDataFrame([tuple(e.get(f) for f in fields) for e in log], EVENTS)
    feedback = spark.createDataFrame(
        [(r["event_id"], "ambiguity", r["target"], json.dumps({"options": r["options"]}) if r["options"] else None,
          json.dumps({"body_patch": json.loads(r["body_patch"] or "{}"), "chosen_option": r["chosen_option"]}, sort_keys=True), r["resolved_by"], now,
          r["rationale"]) for r in reviewed if r["event_id"]], FEEDBACK)
    return Run(run_id, derived, with_lineage(derived, key, lineage), checks, counts, events, new_patterns, new_resolutions,
               feedback, reviewed)


def withheld(derived: Derived, failed: set[str]) -> Derived:
    """Without the columns that failed their checks and all that read them; they are dropped from the plan, no row is read again."""
    gone = {n for n in failed if n in derived.rules}
    outcomes = derived.outcomes | {n: Outcome("unresolved", "checks failed") for n in gone}
    for name in [n for level in derived.levels for n in level]:
        if name in derived.rules and name not in gone and gone & set(derived.entries[name].columns()):
            gone.add(name)
            outcomes[name] = Outcome("skipped", "an upstream derivation is not available")
    left = {n: r for n, r in derived.rules.items() if n not in gone}
    return replace(
        derived, df=derived.df.drop(*gone), rules=left, outcomes=outcomes,
        bodies={n: derived.bodies[n] for n in left}, entries={n: derived.entries[n] for n in left})


def _review(spec, known: Memory, decisions, run_id: str, now: str, record):
    """Questions of a spec with their decisions; the last recorded decision for a target wins."""
    spark = known.rule_patterns.sparkSession
    found = rv.review(spec.entries_df(spark), known.ambiguity_resolutions)
    tickets = rv.open_tickets(found, F.lit(run_id), F.lit(now))
    schema = ("position int, ticket_kind string, target string, chosen_option string, body_patch string, "
              "free_text_rationale string, resolved_by string")
    recorded = spark.createDataFrame(
        [(i, d["ticket_kind"], d["target"], d.get("chosen_option"), json.dumps(d.get("body_patch") or {}),
          d.get("free_text_rationale"), d.get("resolved_by")) for i, d in enumerate(decisions)], schema)
    answered = rv.replay(tickets, recorded, "position")
    rows = {r["target"]: r for r in tickets.join(answered.drop("ticket_kind", "target"), "event_id").collect()}
    reviewed, decided, open_questions = [], [], []
    for r in found.collect():
        if r["auto_resolved"]:
            kept = json.loads(r["resolution"])
            option, patch, event_id = kept.get("chosen_option", "ltm_replay"), json.dumps(kept.get("body_patch") or {}), None
            by, why = None, None
            record("hitl_auto_resolved", target=r["target"], chosen_option=option, ambiguity_class=r["ambiguity_class"])
        else:
            t = rows[r["target"]]
            by, why = t["resolved_by"], t["free_text_rationale"]
            event_id, option, patch = t["event_id"], t["chosen_option"], t["body_patch"]
            record("hitl_open", target=r["target"], event_id=event_id, ticket_kind="ambiguity", ambiguity_class=r["ambiguity_class"])
            if not t["resolved"]:
                open_questions.append((event_id, r["target"], r["message"]))
                continue
            record("hitl_resolved", target=r["target"], event_id=event_id, ticket_kind="ambiguity", chosen_option=option,
                   resolved_by=t["resolved_by"], ambiguity_class=r["ambiguity_class"])
            resolution = json.dumps(
                {"body_patch": json.loads(patch), "chosen_option": option, "free_text_rationale": t["free_text_rationale"]},
                sort_keys=True)
            decided.append((r["signature"], resolution, run_id, now, event_id))
        reviewed.append({"target": r["target"], "auto_resolved": r["auto_resolved"], "chosen_option": option,
                         "body_patch": patch, "event_id": event_id, "ambiguity_class": r["ambiguity_class"], "options": r["options_offered"],
                         "resolved_by": by, "rationale": why})
    if open_questions:
        raise PendingTickets(open_questions)
    return reviewed, decided
