"""`error` policies: eager counting, raising, and row quarantine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.plans.errors import NullInputError, UnmappedInputError

NAMED = 20


@dataclass
class Blocked:
    rows: int
    by_policy: dict[str, int] = field(default_factory=dict)

    @property
    def total_blocked(self) -> int:
        return sum(self.by_policy.values())

    def describe(self) -> str:
        parts = [f"{n} of {self.rows} rows are {policy}" for policy, n in self.by_policy.items() if n]
        return "; ".join(parts)


def blocked_counts(df: DataFrame, blocked: Mapping[str, Mapping[str, Column]]) -> dict[str, Blocked]:
    """Rows each policy forbids, for all rules in one aggregate. No job when no policy forbids anything."""
    pairs = [(name, policy, cond) for name, by in blocked.items() for policy, cond in by.items()]
    if not pairs:
        return {}
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(pairs)]
    ).first()
    out: dict[str, Blocked] = {}
    for i, (name, policy, _) in enumerate(pairs):
        out.setdefault(name, Blocked(row["n"])).by_policy[policy] = row[f"c{i}"]
    return out


def raise_on_blocked(derived, hit: Mapping[str, Blocked]) -> None:
    """Raise for the first derivation (in dependency order) whose policy was hit."""
    name = next(n for n in derived.rules if n in hit)
    rule, counts = derived.rules[name], hit[name]
    where = f"derivation {name!r} reading {rule.inputs}"
    if counts.by_policy.get("null"):
        raise NullInputError(f"{where}: {counts.describe()}")
    values = (
        derived.checked.where(derived.blocked[name]["unmapped"]).groupBy(F.col(f"__key__{name}").alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    total, least, most = values.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    # the message names a handful; `values` has all of them, however many
    shown = (
        str([r["value"] for r in values.select("value").orderBy("value").collect()]) if total <= NAMED
        else f"{total} values from {least!r} to {most!r}"
    )
    raise UnmappedInputError(f"{where}: {counts.describe()}: {shown}; declared keys: {sorted(rule.mapping)}", values)


def violations(blocked: Mapping[str, Mapping[str, Column]]) -> Column:
    """Array of 'derivation:policy' a row breaks; empty for a good row."""
    items = [
        F.when(cond, F.lit(f"{name}:{policy}")) for name, by in sorted(blocked.items()) for policy, cond in by.items()
    ]
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def quarantine(df: DataFrame, blocked: Mapping[str, Mapping[str, Column]], column: str = "_violations") -> DataFrame:
    """Mark each row with the policies it breaks; works on streams. Split with `accepted` / `diverted`."""
    return df.withColumn(column, violations(blocked))


def accepted(marked: DataFrame, column: str = "_violations") -> DataFrame:
    return marked.where(F.size(column) == 0).drop(column)


def diverted(marked: DataFrame, column: str = "_violations") -> DataFrame:
    return marked.where(F.size(column) > 0)
