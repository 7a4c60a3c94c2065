"""Apply one rule or a whole spec to a table.

All derivations of a dependency level become one `withColumns`, so the plan is as deep as the dependency
graph, not as long as the spec. Jobs run before the result is returned only where a data-dependent decision
is asked for: one pass finds the date formats of text columns and which durations are whole, at any number of levels, and one
counts what `error` policies forbid. `rulefold.plans.publish` leaves the latter to the pass that writes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import col
from rulefold.functions.dates import decide, is_date_source
from rulefold.operators.policy import blocked_counts, raise_on_blocked
from rulefold.operators.rules import RuleColumns, Scope, rule_kind, with_lookups
from rulefold.plans.bodies import UNIT_DAYS, Body, DurationBody
from rulefold.plans.errors import SpecError
from rulefold.plans.spec import Spec, SpecEntry, dependency_levels, require_columns


@dataclass(frozen=True)
class Outcome:
    status: str
    reason: str = ""


@dataclass
class Derived:
    """A derived table with what was decided on the way.

    `checked` is `df` with helper columns that hold, per rule, what its `error` policies say about a row; they
    are computed beside the derived values, so a target may overwrite its source.
    """

    df: DataFrame
    source_columns: list[str]
    levels: list[list[str]]
    rules: dict[str, RuleColumns] = field(default_factory=dict)
    bodies: dict[str, Body] = field(default_factory=dict)
    entries: dict[str, SpecEntry] = field(default_factory=dict)
    outcomes: dict[str, Outcome] = field(default_factory=dict)
    checked: DataFrame | None = None
    blocked: dict[str, dict[str, Column]] = field(default_factory=dict)

    def derived_names(self) -> list[str]:
        return list(self.rules)


def _decide(df: DataFrame, bodies: Mapping[str, Body], known: Mapping[str, str], integral: str) -> tuple[dict[str, str], dict[str, bool]]:
    """Formats of text date columns and which durations between source columns are whole: one pass for both, none if nothing is open."""
    durations = {n: b for n, b in bodies.items() if isinstance(b, DurationBody)}
    names = [c for b in durations.values() for c in (b.start_column, b.end_column)]
    open_names = [c for c in dict.fromkeys(names) if c in df.columns and c not in known and isinstance(df.schema[c].dataType, T.StringType)]
    if open_names and df.isStreaming:
        raise SpecError(f"a stream needs date_formats for {open_names}")
    spans = {
        n: (b.start_column, b.end_column, int(UNIT_DAYS[b.unit])) for n, b in durations.items()
        if integral == "auto" and all(c in df.columns and is_date_source(df.schema[c].dataType) for c in (b.start_column, b.end_column))
        and not (b.unit == "days" and all(isinstance(df.schema[c].dataType, T.DateType) for c in (b.start_column, b.end_column)))}
    formats, whole = decide(df, open_names, known, list(spans.values()))
    return {**known, **formats}, {n: whole[span] for n, span in spans.items()}


def _whole_durations(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """For each duration between derived columns: is every present value whole (and is there one)?"""
    if not names:
        return {}
    row = df.agg(*[F.bool_and(col(n) == F.floor(col(n))).alias(n) for n in names]).first()
    return {n: bool(row[n]) for n in names}


def apply_rule(
    df: DataFrame,
    target: str,
    kind: str,
    body: Mapping[str, Any] | Body,
    source: str | None = None,
    *,
    date_formats: Mapping[str, str] | None = None,
    integral: str = "auto",
    explain: bool = False,
) -> DataFrame:
    """Add (or overwrite) `target` by one rule; raises before any row is written if an `error` policy is hit."""
    typed = rule_kind(kind).body.parse(body).as_dict()
    entry = SpecEntry(target, rule_kind(kind).columns([source] if source else [], typed), kind, typed)
    return apply_spec(
        df, Spec([entry]), date_formats=date_formats, integral=integral, explain=explain, allow_overwrite=True,
    ).df


def apply_spec(
    df: DataFrame,
    spec: Spec,
    *,
    date_formats: Mapping[str, str] | None = None,
    integral: str = "auto",
    on_error: str = "raise",
    explain: bool = False,
    allow_overwrite: bool = False,
) -> Derived:
    """Apply every derivation of a spec in dependency order.

    integral: 'auto' makes a duration bigint when all its values are whole (one aggregate), 'never' keeps
    double, 'always' truncates to bigint; streams must choose 'never' or 'always'.
    on_error: 'raise'; 'skip' to leave out derivations whose `error` policy is hit or whose body is not
    well formed, together with everything that reads them; or 'defer' to leave `error` policies to the caller, who finds them in `blocked`
    (see `rulefold.plans.publish`).
    explain: also add `<target>__why`.
    """
    require_columns(spec, df.columns)
    clash = sorted(set(spec.names()) & set(df.columns))
    if clash and not allow_overwrite:
        raise SpecError(f"derivations would overwrite source columns {clash}; pass allow_overwrite=True")
    if df.isStreaming and integral == "auto":
        raise SpecError("a stream cannot decide integral='auto'; choose 'never' or 'always'")
    levels = dependency_levels(spec, df.columns)
    bodies: dict[str, Body] = {}
    outcomes: dict[str, Outcome] = {}
    for d in spec.derivations:
        try:
            bodies[d.name] = d.body()
        except SpecError as exc:
            if on_error != "skip":
                raise
            outcomes[d.name] = Outcome("unresolved", str(exc))
    formats, whole = _decide(df, bodies, date_formats or {}, integral)
    result = _project(df, spec, levels, bodies, dict(outcomes), formats, whole, integral, explain, on_error)
    if df.isStreaming:
        if result.blocked:
            raise SpecError(f"error policies of {list(result.blocked)} cannot stop a stream; use quarantine instead")
        return result
    if on_error == "defer":
        return result
    hit = {n: c for n, c in blocked_counts(result.checked, result.blocked).items() if c.total_blocked}
    if hit and on_error == "raise":
        raise_on_blocked(result, hit)
    if hit:
        for n, c in hit.items():
            outcomes[n] = Outcome("unresolved", c.describe())
        result = _project(df, spec, levels, bodies, outcomes, formats, whole, integral, explain, on_error)
    return result


def helper(name: str, what: str) -> str:
    return f"__{what}__{name}"


def _project(df, spec, levels, bodies, outcomes, formats, known_whole, integral, explain, on_error) -> Derived:
    source_columns = list(df.columns)
    out = Derived(df, source_columns, levels, outcomes=outcomes)
    frame, helpers = df, []
    for level in levels:
        scope = Scope(frame.schema, formats)
        columns: dict[str, Column] = {}
        durations: list[str] = []
        for name in level:
            entry = spec.entry(name)
            if name in outcomes:
                continue
            if any(c not in source_columns and c not in out.rules for c in entry.columns()):
                outcomes[name] = Outcome("skipped", "an upstream derivation is not available")
                continue
            try:
                rule = rule_kind(entry.rule_kind).build(scope, entry.inputs[0], bodies[name])
            except SpecError as exc:
                if on_error != "skip":
                    raise
                outcomes[name] = Outcome("unresolved", str(exc))
                continue
            out.rules[name], out.bodies[name], out.entries[name] = rule, bodies[name], entry
            outcomes[name] = Outcome("verified")
            extra: dict[str, Column] = {}
            if rule.dtype == "double":
                durations.append(name)
            columns[name] = rule.value
            if rule.lookup is not None:
                frame = with_lookups(frame, [rule])
                helpers.append(rule.lookup.name)
            for policy, cond in rule.blocked.items():
                extra[helper(name, policy)] = cond
                out.blocked.setdefault(name, {})[policy] = F.col(helper(name, policy))
                if policy == "unmapped":
                    extra[helper(name, "key")] = rule.key
            if explain:
                columns[f"{name}__why"] = rule.why
                columns |= {f"{name}__{part}": c for part, c in rule.trace.items()}
            columns |= extra
            helpers += extra
        if columns:
            # days between two dates need no look, durations between source columns had theirs
            unsure = [n for n in durations if not out.rules[n].whole and n not in known_whole]
            whole = (
                {n: known_whole.get(n, True) for n in durations} | _whole_durations(frame.withColumns({n: columns[n] for n in unsure}), unsure)
                if integral == "auto" else {n: integral == "always" for n in durations}
            )
            columns |= {n: columns[n].cast("bigint") for n, yes in whole.items() if yes}
            frame = frame.withColumns(columns)
    out.checked, out.df = frame, frame.drop(*helpers)
    return out
