"""The five rule kinds as column expressions, and the registry users extend.

A builder turns a body into a `RuleColumns`: the derived value, the row predicates its `error` policies
forbid, the checks its output must pass, a readable reason per row and further trace columns. Everything is a Catalyst expression,
so any number of rules is one projection without shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import col, is_missing, is_numeric, key_text, num
from rulefold.functions.dates import as_timestamp, is_date_source, micros_between
from rulefold.functions.signatures import signature_of
from rulefold.operators.conditions import describe, fold
from rulefold.plans.bodies import (
    UNIT_DAYS,
    BinBody,
    Body,
    CompoundBody,
    DurationBody,
    FlagBody,
    RiskScoreBody,
)
from rulefold.plans.errors import SpecError

@dataclass(frozen=True)
class Check:
    """A row predicate that must never hold for a stored output."""

    property_id: str
    message: str
    violated: Callable[[Column], Column]
    severity: str = "error"


@dataclass(frozen=True)
class RuleColumns:
    value: Column
    dtype: str
    why: Column
    inputs: list[str]
    blocked: dict[str, Column] = field(default_factory=dict)
    checks: list[Check] = field(default_factory=list)
    reach: dict[str, Column] = field(default_factory=dict)
    partitions: dict[str, Column] = field(default_factory=dict)
    trace: dict[str, Column] = field(default_factory=dict)
    outputs: list[str] | None = None  # every text the rule can give, when that is a closed set
    key: Column | None = None
    mapping: Mapping[str, str] | None = None
    lookup: Lookup | None = None
    whole: bool = False  # every value is known to be a whole number


@dataclass(frozen=True)
class Scope:
    """What a builder may look at: the table's schema and the parse formats of its text dates."""

    schema: T.StructType
    date_formats: Mapping[str, str] = field(default_factory=dict)

    def dtype(self, name: str) -> T.DataType:
        if name not in self.schema.fieldNames():
            raise SpecError(f"source column {name!r} not found; available columns: {self.schema.fieldNames()}")
        return self.schema[name].dataType


@dataclass(frozen=True)
class RuleKind:
    body: type[Body]
    build: Callable[[Scope, str | None, Body], RuleColumns]
    columns: Callable[[list[str], Mapping[str, Any]], list[str]]


def unique(values: Iterable[Any]) -> list[str]:
    """Distinct non-empty values in first-seen order."""
    return list(dict.fromkeys(v for v in values if v))


def _null() -> Column:
    return F.lit(None).cast("string")


def _within(out: Column, allowed: list[str], null_allowed: bool) -> Column:
    """Output outside the declared set."""
    outside = out.isNotNull() & ~out.isin(allowed)
    return outside if null_allowed else (outside | out.isNull())


def _num_text(x: float) -> str:
    return repr(float(x))


# ---------------------------------------------------------------- bin

def build_bin(scope: Scope, source: str | None, body: BinBody) -> RuleColumns:
    dtype = scope.dtype(source)
    if not is_numeric(dtype):
        raise SpecError(f"bin needs a numeric source; {source!r} is {dtype.simpleString()}")
    c = col(source)
    missing = is_missing(c, dtype)
    v = num(c, dtype)
    beyond = v == F.lit(float("inf"))
    on_null = F.lit(body.null_label).cast("string")
    value = F.when(missing, on_null).when(beyond, _null())
    why = F.when(missing, F.lit("missing value: null handling")).when(beyond, F.lit("infinite value: no bucket"))
    last = len(body.labels) - 1
    for i, label in enumerate(body.labels):
        if i == 0:
            span = f"below {_num_text(body.edges[0])}"
        elif i == last:
            span = f"{_num_text(body.edges[-1])} and above"
        else:
            span = f"{_num_text(body.edges[i - 1])} to under {_num_text(body.edges[i])}"
        reason = F.concat(v.cast("string"), F.lit(f" is {span}: {label}"))
        if i < last:
            value = value.when(v < F.lit(body.edges[i]), F.lit(label))
            why = why.when(v < F.lit(body.edges[i]), reason)
        else:
            value, why = value.otherwise(F.lit(label)), why.otherwise(reason)
    allowed = body.labels + ([body.null_label] if body.null_handling == "label" else [])
    checks = [
        Check("P-bin-1", "a present value got no declared bucket",
              lambda out: ~missing & ~beyond & (out.isNull() | ~out.isin(body.labels))),
        Check("P-bin-2", f"missing values do not follow null_handling={body.null_handling}",
              (lambda out: missing) if body.null_handling == "error"
              else (lambda out: missing & ~out.eqNullSafe(on_null))),
        Check("P-bin-3", "output outside the declared buckets",
              lambda out: _within(out, allowed, body.null_handling == "null") & ~(beyond & out.isNull())),
    ]
    return RuleColumns(
        value, "string", why, [source],
        blocked={"null": missing} if body.null_handling == "error" else {},
        checks=checks,
        partitions={"declared": ~missing & ~beyond, "null": missing, "out_of_range": ~missing & beyond},
        outputs=allowed,
    )


# ---------------------------------------------------------------- flag

LARGE_MAP = 64
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Lookup:
    """A map too large for an expression: joined to the table as column `name` (a struct, NULL when absent)."""

    name: str
    key: Column
    mapping: Mapping[str, str]


def with_lookups(df: DataFrame, rules: Iterable[RuleColumns]) -> DataFrame:
    """Join the large maps that rules refer to; as many are broadcast as have at most BROADCAST_BYTES of text together."""
    spent = 0
    for lookup in [r.lookup for r in rules if r.lookup is not None]:
        if lookup.name in df.columns:
            continue
        pairs = df.sparkSession.createDataFrame(list(lookup.mapping.items()), "_k string, value string").select(
            "_k", F.struct("value").alias(lookup.name))
        size = sum(len(k.encode()) + len(v.encode()) for k, v in lookup.mapping.items())
        if spent + size <= BROADCAST_BYTES:
            pairs, spent = F.broadcast(pairs), spent + size
        df = df.join(pairs, lookup.key == F.col("_k"), "left").drop("_k")
    return df


def build_flag(scope: Scope, source: str | None, body: FlagBody) -> RuleColumns:
    dtype = scope.dtype(source)
    c = col(source)
    missing = is_missing(c, dtype)
    key = key_text(c, dtype)
    lookup = None
    if len(body.map) > LARGE_MAP:
        lookup = Lookup(f"__map_{signature_of(body.as_dict())}_{source}", key, body.map)
        declared, mapped = col(lookup.name).isNotNull(), col(lookup.name)["value"]
    else:
        by_value: dict[str, list[str]] = {}
        for k, v in body.map.items():
            by_value.setdefault(v, []).append(k)
        declared = key.isin(list(body.map))
        mapped = reduce(lambda acc, kv: acc.when(key.isin(kv[1]), F.lit(kv[0])), by_value.items(), F).otherwise(_null())
    on_null = F.lit(body.null_value).cast("string")
    on_unmapped = F.lit(body.unmapped_value).cast("string")
    unmapped = ~missing & ~declared
    value = F.when(missing, on_null).when(unmapped, on_unmapped).otherwise(mapped)
    fallback = {
        "value": f" is not in the mapping: fallback {body.unmapped_value}",
        "null": " is not in the mapping: null",
        "error": " is not in the mapping: error",
    }[body.unmapped_handling]
    why = (
        F.when(missing, F.lit("missing value: null handling"))
        .when(unmapped, F.concat(key, F.lit(fallback)))
        .otherwise(F.concat(F.lit("mapping "), key, F.lit(": "), mapped))
    )
    allowed = unique(body.map.values()) + [
        v for v in (body.null_value, body.unmapped_value) if v is not None
    ]
    null_allowed = "null" in (body.null_handling, body.unmapped_handling)
    checks = [
        Check("P-flag-1", "a declared key did not give its declared value",
              lambda out: ~missing & declared & ~out.eqNullSafe(mapped)),
        Check("P-flag-2", f"missing values do not follow null_handling={body.null_handling}",
              (lambda out: missing) if body.null_handling == "error"
              else (lambda out: missing & ~out.eqNullSafe(on_null))),
        Check("P-flag-3", f"undeclared values do not follow unmapped_handling={body.unmapped_handling}",
              (lambda out: unmapped) if body.unmapped_handling == "error"
              else (lambda out: unmapped & ~out.eqNullSafe(on_unmapped))),
        Check("P-flag-4", "output outside the declared set",
              lambda out: _within(out, allowed, null_allowed)),
    ]
    blocked = {}
    if body.null_handling == "error":
        blocked["null"] = missing
    if body.unmapped_handling == "error":
        blocked["unmapped"] = unmapped
    return RuleColumns(
        value, "string", why, [source], blocked=blocked, checks=checks,
        partitions={"declared": ~missing & declared, "null": missing, "unmapped": unmapped},
        key=key, mapping=body.map, lookup=lookup, outputs=allowed,
    )


# ---------------------------------------------------------------- duration

def build_duration(scope: Scope, source: str | None, body: DurationBody) -> RuleColumns:
    ends = []
    for name in (body.start_column, body.end_column):
        dtype = scope.dtype(name)
        if not is_date_source(dtype):
            raise SpecError(f"duration needs date columns; {name!r} is {dtype.simpleString()}")
        ends.append(as_timestamp(col(name), dtype, scope.date_formats.get(name)))
    start, end = ends
    undefined = start.isNull() | end.isNull()
    per_unit = UNIT_DAYS[body.unit]
    days = micros_between(start, end).cast("double") / F.lit(1e6) / F.lit(86400.0)
    value = days / F.lit(per_unit)
    why = F.when(undefined, F.lit("an endpoint is missing: null handling")).otherwise(
        F.concat(
            F.date_format(end, "yyyy-MM-dd"), F.lit(" - "), F.date_format(start, "yyyy-MM-dd"), F.lit(" = "),
            F.floor(days).cast("string"), F.lit(f" days: "), value.cast("string"), F.lit(f" {body.unit}"),
        )
    )
    checks = [
        Check("P-duration-1", "negative although the end is not before the start",
              lambda out: ~undefined & (end >= start) & (out < 0)),
        Check("P-duration-2", f"missing endpoints do not follow null_handling={body.null_handling}",
              (lambda out: undefined) if body.null_handling == "error"
              else (lambda out: undefined & out.isNotNull())),
        Check("P-duration-3", "differs from a fresh calculation",
              lambda out: ~undefined & (out.isNull() | (F.abs(out.cast("double") - value) > 1e-9))),
        Check("P-duration-4", "a negative difference was not kept",
              lambda out: ~undefined & (end < start) & ~F.coalesce(out < 0, F.lit(False))),
    ]
    return RuleColumns(
        value, "double", why, [body.start_column, body.end_column],
        blocked={"null": undefined} if body.null_handling == "error" else {},
        checks=checks,
        partitions={"declared": ~undefined, "null": undefined},
        whole=body.unit == "days" and all(isinstance(scope.dtype(c), T.DateType) for c in (body.start_column, body.end_column)),
    )


# ---------------------------------------------------------------- compound

def build_compound(scope: Scope, source: str | None, body: CompoundBody) -> RuleColumns:
    t = fold(body.conditions, body.combinator, scope.schema)
    on_undefined = {
        "null": _null(), "error": _null(), "true": F.lit(body.true_value), "false": F.lit(body.false_value),
    }[body.null_handling]
    decided = F.when(t, F.lit(body.true_value)).otherwise(F.lit(body.false_value))
    value = F.when(t.isNull(), on_undefined).otherwise(decided)
    rule = describe(body.conditions, body.combinator)
    why = F.concat(
        F.lit(f"{rule}: "),
        F.when(t.isNull(), F.lit(f"undefined, null handling {body.null_handling}")).otherwise(t.cast("string")),
    )
    names = unique(c.column for c in body.conditions)
    checks = [
        Check("P-compound-1", "a decided row does not carry its declared value",
              lambda out: t.isNotNull() & ~out.eqNullSafe(decided)),
        Check("P-compound-2", f"undefined rows do not follow null_handling={body.null_handling}",
              (lambda out: t.isNull()) if body.null_handling == "error"
              else (lambda out: t.isNull() & ~out.eqNullSafe(on_undefined))),
        Check("P-compound-3", "output outside the declared values",
              lambda out: _within(out, [body.true_value, body.false_value], body.null_handling == "null")),
    ]
    return RuleColumns(
        value, "string", why, names,
        blocked={"null": t.isNull()} if body.null_handling == "error" else {},
        checks=checks,
        partitions={"true": F.coalesce(t, F.lit(False)), "false": F.coalesce(~t, F.lit(False)), "null": t.isNull()},
        outputs=[body.true_value, body.false_value],
    )


# ---------------------------------------------------------------- risk_score

def build_risk_score(scope: Scope, source: str | None, body: RiskScoreBody) -> RuleColumns:
    truths = [fold(t.conditions, t.combinator, scope.schema) for t in body.tiers]
    undefined = reduce(lambda a, b: a & b, [t.isNull() for t in truths])
    on_undefined = F.lit(body.fallback_label) if body.null_handling == "fallback" else _null()
    ordinal = reduce(lambda acc, it: acc.when(it[1], F.lit(it[0] + 1)), enumerate(truths), F)
    ordinal = ordinal.otherwise(F.when(undefined, F.lit(-1)).otherwise(F.lit(0)))
    value = reduce(lambda acc, it: acc.when(it[1], F.lit(it[0].label)), zip(body.tiers, truths), F)
    value = value.when(undefined, on_undefined).otherwise(F.lit(body.fallback_label))
    why = reduce(
        lambda acc, it: acc.when(it[1], F.lit(f"first matching tier: {it[0].label}")), zip(body.tiers, truths), F
    )
    why = why.when(undefined, F.lit(f"no tier resolved: null handling {body.null_handling}")).otherwise(
        F.lit(f"no tier matched: fallback {body.fallback_label}"))
    names = unique(c.column for t in body.tiers for c in t.conditions)
    winner = reduce(lambda acc, it: acc.when(it[1], F.lit(it[0].label)), zip(body.tiers, truths), F)
    won = winner.otherwise(_null())
    checks = [
        Check("P-risk_score-2", "the first matching tier did not win",
              lambda out: won.isNotNull() & ~out.eqNullSafe(won)),
        Check("P-risk_score-3", "an unmatched row did not get the fallback label",
              lambda out: won.isNull() & ~undefined & ~out.eqNullSafe(F.lit(body.fallback_label))),
        Check("P-risk_score-4", f"undefined rows do not follow null_handling={body.null_handling}",
              (lambda out: undefined) if body.null_handling == "error"
              else (lambda out: undefined & ~out.eqNullSafe(on_undefined))),
    ]
    return RuleColumns(
        value, "string", why, names,
        blocked={"null": undefined} if body.null_handling == "error" else {},
        checks=checks,
        reach={t.label: ordinal == F.lit(i + 1) for i, t in enumerate(body.tiers)},
        partitions={"matched": ordinal > 0, "fallback": ordinal == 0, "null": ordinal == -1},
        trace={"tier": F.when(ordinal > 0, ordinal)},
        outputs=[*(t.label for t in body.tiers), body.fallback_label],
    )


# ---------------------------------------------------------------- registry

def _condition_columns(conditions: Any) -> list[Any]:
    return [c.get("column") for c in conditions or [] if isinstance(c, Mapping)]


RULE_KINDS: dict[str, RuleKind] = {}


def register_rule_kind(
    name: str,
    body: type[Body],
    build: Callable[[Scope, str | None, Body], RuleColumns],
    columns: Callable[[list[str], Mapping[str, Any]], list[str]] = lambda inputs, body: unique(inputs),
) -> None:
    """Add or replace a rule kind. `build` must return expressions only; `columns` lists what the rule reads."""
    RULE_KINDS[name] = RuleKind(body, build, columns)


register_rule_kind("bin", BinBody, build_bin)
register_rule_kind("flag", FlagBody, build_flag)
register_rule_kind(
    "duration", DurationBody, build_duration,
    lambda inputs, body: unique([*inputs, body.get("start_column"), body.get("end_column")]),
)
register_rule_kind(
    "compound", CompoundBody, build_compound,
    lambda inputs, body: unique([*inputs, *_condition_columns(body.get("conditions"))]),
)
register_rule_kind(
    "risk_score", RiskScoreBody, build_risk_score,
    lambda inputs, body: unique(
        [*inputs, *(c for t in body.get("tiers") or [] if isinstance(t, Mapping)
                    for c in _condition_columns(t.get("conditions")))]
    ),
)


def known_rule_kinds() -> list[str]:
    return sorted(RULE_KINDS)


def rule_kind(name: str) -> RuleKind:
    if name not in RULE_KINDS:
        raise SpecError(f"unknown rule kind {name!r}; known: {known_rule_kinds()}")
    return RULE_KINDS[name]
