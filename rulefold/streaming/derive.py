"""Specs and audit roll-ups on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.operators.policy import quarantine
from rulefold.operators.rules import Scope, rule_kind, with_lookups
from rulefold.plans.apply import apply_spec
from rulefold.plans.spec import Spec, SpecEntry

def _relaxed(entry: SpecEntry) -> SpecEntry:
    """The entry with its `error` policies turned into `null`, for rows that are diverted anyway."""
    strict = {k: "null" for k in ("null_handling", "unmapped_handling") if entry.rule_body.get(k) == "error"}
    return entry.patched(strict)


def derive_stream(stream: DataFrame, spec: Spec, *, date_formats: dict[str, str] | None = None,
                  integral: str = "never", column: str = "_violations") -> DataFrame:
    """All derivations on a stream; rows an `error` policy forbids are marked in `column` instead of raising.

    Row-wise and stateless, so it keeps no state and needs no watermark.
    """
    relaxed = Spec([_relaxed(d) for d in spec.derivations], spec.version)
    done = apply_spec(stream, relaxed, date_formats=date_formats, integral=integral)
    scope = Scope(done.df.schema, date_formats or {})
    rules = {d.name: rule_kind(d.rule_kind).build(scope, d.inputs[0], d.body()) for d in spec.derivations}
    marked = quarantine(with_lookups(done.df, rules.values()), {n: r.blocked for n, r in rules.items()}, column)
    return marked.select(*done.df.columns, column)


def live_counters(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per window, run and type. In update mode every window is reported as it grows; in append mode once the watermark has passed its end."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "run_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "run_id", "event_type", "n_events")
    )
