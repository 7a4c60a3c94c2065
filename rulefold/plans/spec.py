"""Specs: declared derivations, their referenced columns and their dependency levels.

A spec is configuration of tens to hundreds of entries and lives on the driver; `entries_df` gives the same
entries as a table for the set-oriented operators, where one table may hold many studies.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rulefold.operators.rules import known_rule_kinds, rule_kind
from rulefold.plans.bodies import Body
from rulefold.plans.errors import DatasetError, SpecError

ENTRY_SCHEMA = (
    "study_id string, name string, inputs array<string>, rule_kind string, rule_body string, "
    "rationale string, ambiguity_notes string"
)
ENTRY_FIELDS = ("name", "inputs", "rule_kind", "rule_body", "rationale", "ambiguity_notes")


@dataclass(frozen=True)
class SpecEntry:
    name: str
    inputs: list[str]
    rule_kind: str
    rule_body: Mapping[str, Any] = field(default_factory=dict)
    rationale: str = ""
    ambiguity_notes: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name.strip():
            raise SpecError("entry name must not be blank")
        if not self.inputs:
            raise SpecError(f"entry {self.name!r} declares no inputs")
        if self.rule_kind not in known_rule_kinds():
            raise SpecError(f"entry {self.name!r}: unknown rule kind {self.rule_kind!r}; known: {known_rule_kinds()}")

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> SpecEntry:
        extra = sorted(set(raw) - set(ENTRY_FIELDS))
        if extra:
            raise SpecError(f"spec entry has unknown fields {extra}")
        try:
            return cls(**raw)
        except TypeError as exc:
            raise SpecError(f"spec entry is incomplete: {exc}") from exc

    def body(self) -> Body:
        return rule_kind(self.rule_kind).body.parse(self.rule_body)

    def columns(self) -> list[str]:
        """Every column the rule reads: declared inputs, then those named inside the body."""
        return rule_kind(self.rule_kind).columns(list(self.inputs), self.rule_body)

    def patched(self, patch: Mapping[str, Any] | None) -> SpecEntry:
        """Entry with top-level body fields replaced by a decision; an empty patch changes nothing."""
        return replace(self, rule_body={**self.rule_body, **patch}) if patch else self


@dataclass(frozen=True)
class Spec:
    derivations: list[SpecEntry]
    version: str = "1"

    def __post_init__(self) -> None:
        if not self.derivations:
            raise SpecError("a spec needs at least one derivation")
        names = [d.name for d in self.derivations]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise SpecError(f"duplicate derivation names: {twice}")

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> Spec:
        extra = sorted(set(raw) - {"version", "derivations"})
        if extra:
            raise SpecError(f"spec has unknown fields {extra}")
        return cls([SpecEntry.parse(e) for e in raw.get("derivations") or []], str(raw.get("version", "1")))

    @classmethod
    def from_entries(cls, entries: Iterable[Mapping[str, Any]]) -> Spec:
        return cls.parse({"derivations": list(entries)})

    @classmethod
    def load(cls, path: str | Path) -> Spec:
        """Read a YAML or JSON spec document."""
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls.parse(json.loads(text))
        import yaml

        return cls.parse(yaml.safe_load(text))

    @classmethod
    def from_table(cls, entries: DataFrame, study_id: str) -> Spec:
        """One study's spec out of a `spec_entries` table."""
        rows = entries.where(entries.study_id == study_id).drop("study_id").collect()
        return cls.from_entries([{**r.asDict(), "rule_body": json.loads(r["rule_body"])} for r in rows])

    def entries_df(self, spark: SparkSession, study_id: str = "spec") -> DataFrame:
        rows = [
            (study_id, e.name, list(e.inputs), e.rule_kind, json.dumps(e.rule_body, sort_keys=True),
             e.rationale, e.ambiguity_notes)
            for e in self.derivations
        ]
        return spark.createDataFrame(rows, ENTRY_SCHEMA)

    def names(self) -> list[str]:
        return [d.name for d in self.derivations]

    def entry(self, name: str) -> SpecEntry:
        for d in self.derivations:
            if d.name == name:
                return d
        raise KeyError(name)

    def patched(self, patches: Mapping[str, Mapping[str, Any]]) -> Spec:
        return Spec([d.patched(patches.get(d.name)) for d in self.derivations], self.version)

    def patched_from_file(self, path: str | Path) -> Spec:
        """Apply a decisions document (JSON array); the last decision for a target wins."""
        decisions = json.loads(Path(path).read_text(encoding="utf-8"))
        return self.patched({d["target"]: d.get("body_patch") or {} for d in decisions})


def missing_columns(spec: Spec, columns: Iterable[str]) -> dict[str, list[str]]:
    """Referenced columns that neither the dataset nor the spec offers, per derivation."""
    offered = set(columns) | set(spec.names())
    found = {d.name: [c for c in d.columns() if c not in offered] for d in spec.derivations}
    return {name: cols for name, cols in sorted(found.items()) if cols}


def require_columns(spec: Spec, columns: Iterable[str]) -> None:
    columns = list(columns)
    missing = missing_columns(spec, columns)
    if missing:
        parts = "; ".join(f"{name} needs {', '.join(cols)}" for name, cols in missing.items())
        raise DatasetError(f"dataset lacks source columns: {parts}; available: {sorted(columns)}")


def dependency_levels(spec: Spec, columns: Iterable[str]) -> list[list[str]]:
    """Derivations grouped by depth, alphabetical inside a level; a level needs only earlier levels."""
    columns, pending = set(columns), {d.name: d for d in spec.derivations}
    needs = {n: {c for c in d.columns() if c not in columns} for n, d in pending.items()}
    for n, cols in needs.items():
        if not cols <= set(pending):
            raise SpecError(f"derivation {n!r} reads {sorted(cols - set(pending))}: neither column nor derivation")
    done: set[str] = set()
    levels = []
    while pending:
        ready = sorted(n for n in pending if needs[n] <= done)
        if not ready:
            raise SpecError(f"spec has a cycle among {sorted(pending)}")
        levels.append(ready)
        done.update(ready)
        for n in ready:
            del pending[n]
    return levels


def execution_order(spec: Spec, columns: Iterable[str]) -> list[str]:
    """One-by-one order: always the alphabetically first derivation whose inputs are there."""
    columns, pending = set(columns), {d.name: d for d in spec.derivations}
    done: list[str] = []
    while pending:
        ready = sorted(n for n, d in pending.items() if all(c in columns or c in done for c in d.columns()))
        if not ready:
            raise SpecError(f"spec has a cycle among {sorted(pending)}")
        done.append(ready[0])
        del pending[ready[0]]
    return done
