"""Verification of derived columns: one aggregate for all checks of all derivations.

`verify` looks at the columns as they are stored, so it also finds outputs that were changed after the rule
ran. Result tables:

* checks: one row per derivation and property, with the number of rows violating it
* findings: the violated checks only, with one sample row
* verdicts: one row per derivation; passed unless an `error` check is violated
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.functions.cells import col
from rulefold.operators.rules import RuleColumns, with_lookups
from rulefold.plans.bodies import BinBody, Body, FlagBody

CHECK_FIELDS = "derivation layer property_id severity message n_rows n_violations sample".split()


@dataclass
class Checked:
    checks: DataFrame

    @property
    def findings(self) -> DataFrame:
        return self.checks.where("n_violations > 0")

    @property
    def verdicts(self) -> DataFrame:
        return verdicts(self.checks)


def _sample(rule: RuleColumns, name: str, bad: Column) -> Column:
    """Smallest violating row as JSON of the inputs and the output."""
    shown = F.struct(*[col(c).cast("string").alias(c) for c in rule.inputs], col(name).cast("string").alias(name))
    return F.min(F.when(bad, F.to_json(shown, {"ignoreNullFields": "false"})))


def _body_checks(name: str, body: Body) -> list[tuple[str, str, bool]]:
    """Coverage stated by the body itself: every input partition must have a declared handling."""
    if isinstance(body, BinBody):
        return [
            ("L2.bin.null_handling_explicit", "handling of missing values is not declared", body.null_handling is None),
            ("L2.bin.null_label_present", "label for missing values is not declared",
             body.null_handling == "label" and body.null_label is None),
        ]
    if isinstance(body, FlagBody):
        return [
            ("L2.flag.null_handling_explicit", "handling of missing values is not declared", body.null_handling is None),
            ("L2.flag.unmapped_handling_explicit", "handling of undeclared values is not declared",
             body.unmapped_handling is None),
            ("L2.flag.null_value_present", "value for missing values is not declared",
             body.null_handling == "value" and body.null_value is None),
            ("L2.flag.unmapped_value_present", "value for undeclared values is not declared",
             body.unmapped_handling == "value" and body.unmapped_value is None),
        ]
    return []


def verify(
    df: DataFrame,
    rules: Mapping[str, RuleColumns],
    bodies: Mapping[str, Body] | None = None,
    *,
    expected_rows: int | None = None,
    sample: bool = True,
) -> Checked:
    """Check the stored columns named in `rules` against their rules.

    expected_rows: row count of the input table, when the caller has it, for the row-preservation check.
    What the schema or the bodies decide (L1 presence, L2) holds for an empty table too.
    """
    df = with_lookups(df, rules.values())
    aggregates, table = check_aggregates(df, rules, bodies, expected_rows=expected_rows, sample=sample)
    return Checked(df.agg(*aggregates).select(F.inline(table)))


def check_aggregates(
    df: DataFrame, rules: Mapping[str, RuleColumns], bodies: Mapping[str, Body] | None = None, *, expected_rows: int | None = None, sample: bool = True,
) -> tuple[list[Column], Column]:
    """The aggregates behind `verify`, and the array of checks as an expression over their results; `df` has the lookups of the rules."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    rows: list[list[Column]] = []

    def add(name, layer, prop, severity, message, violations, example=None):
        i = len(rows)
        aggregates.append(violations.alias(f"v{i}"))
        if example is not None:
            aggregates.append(example.alias(f"s{i}"))
        shown = F.col(f"s{i}") if example is not None else F.lit(None).cast("string")
        rows.append([F.lit(name), F.lit(layer), F.lit(prop), F.lit(severity), F.lit(message), F.col("n"),
                     F.col(f"v{i}"), shown])

    for name, rule in rules.items():
        present = name in df.columns
        add(name, "L1", "L1.target_column_present", "error", "the derived column is absent",
            F.lit(0 if present else 1).cast("bigint"))
        if expected_rows is not None:
            add(name, "L1", "L1.row_count_preserved", "error", f"row count differs from the input's {expected_rows}",
                F.abs(F.count(F.lit(1)) - F.lit(expected_rows)))
        for prop, message, bad in _body_checks(name, bodies[name]) if bodies and name in bodies else []:
            add(name, "L2", prop, "error", message, F.lit(int(bad)).cast("bigint"))
        if not present:
            continue
        for check in rule.checks:
            bad = F.coalesce(check.violated(col(name)), F.lit(False))
            add(name, "L_p", check.property_id, check.severity, check.message, F.count_if(bad),
                _sample(rule, name, bad) if sample else None)
        for label, wins in rule.reach.items():
            add(name, "L_p", "P-risk_score-1", "warning", f"tier {label} is never reached",
                F.when(F.count_if(wins) == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return aggregates, F.array(*[F.struct(*[c.alias(f) for c, f in zip(r, CHECK_FIELDS)]) for r in rows])


def verdicts(checks: DataFrame, keys: tuple[str, ...] = ("derivation",)) -> DataFrame:
    """Passed unless an error check is violated; warnings do not fail a derivation."""
    failing = (F.col("severity") == "error") & (F.col("n_violations") > 0)
    return checks.groupBy(*keys).agg(
        (F.count_if(failing) == 0).alias("passed"), F.count_if(F.col("n_violations") > 0).alias("n_findings")
    )


def coverage(df: DataFrame, rules: Mapping[str, RuleColumns]) -> DataFrame:
    """Rows per input partition (declared / null / unmapped / ...) of each rule, in one aggregate."""
    df = with_lookups(df, rules.values())
    items = [(n, p, c) for n, r in rules.items() for p, c in r.partitions.items()]
    row = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(items)])
    table = F.array(*[
        F.struct(F.lit(n).alias("derivation"), F.lit(p).alias("partition"), F.col(f"c{i}").alias("n_rows"))
        for i, (n, p, _) in enumerate(items)
    ])
    return row.select(F.inline(table))


def undeclared_values(df: DataFrame, rule: RuleColumns) -> DataFrame:
    """Observed values outside a flag's map with their frequency; pre-aggregated before the shuffle."""
    return (
        with_lookups(df, [rule]).where(rule.partitions["unmapped"]).groupBy(rule.key.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    )


def label_distribution(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows per label (missing included) of many derived columns in one scan and one small shuffle."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), col(t).cast("string").alias("label")) for t in targets])
    return (
        df.select(F.inline(pairs)).groupBy("target", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def fingerprint(df: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Order-free fingerprint of key and output columns: one row, no shuffle of data."""
    h = F.xxhash64(*[col(c) for c in (*keys, *targets)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def is_deterministic(build, keys: list[str], targets: list[str]) -> bool:
    """Run a derivation twice and compare fingerprints."""
    first, second = (fingerprint(build(), keys, targets).first() for _ in range(2))
    return first == second


def inconsistent_inputs(df: DataFrame, inputs: list[str], target: str) -> DataFrame:
    """Input combinations that carry more than one output; min/max combine before the shuffle."""
    out = F.coalesce(col(target).cast("string"), F.lit("\u0000"))
    return (
        df.groupBy(*[col(c) for c in inputs])
        .agg(F.min(out).alias("_lo"), F.max(out).alias("_hi"), F.count(F.lit(1)).alias("n_rows"))
        .where("_lo <> _hi").drop("_lo", "_hi")
    )
