"""Typed rule bodies. Unknown fields are refused; defaults are filled; numbers given as text are coerced."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any, ClassVar

from rulefold.plans.errors import SpecError

OPS = ("==", "!=", ">=", "<=", ">", "<", "is_null", "not_null", "in")
ORDER_OPS = (">=", "<=", ">", "<")
UNIT_DAYS = {"days": 1.0, "weeks": 7.0, "months": 30.0, "years": 365.0}


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _text(value: Any, name: str) -> str:
    _check(isinstance(value, str), f"{name} must be text, got {value!r}")
    return value


def _choice(value: Any, name: str, options: tuple[str, ...]) -> str:
    _check(value in options, f"{name} must be one of {list(options)}, got {value!r}")
    return value


def _only_with(policy: str, mode: str, value: Any, name: str) -> None:
    _check((value is not None) == (policy == mode), f"{name} must be given exactly when its policy is {mode!r}")


@dataclass(frozen=True)
class Body:
    """Base of all bodies: strict construction from a mapping."""

    kind: ClassVar[str] = ""

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> Body:
        if isinstance(raw, cls):
            return raw
        _check(isinstance(raw, Mapping), f"{cls.kind} body must be a mapping, got {type(raw).__name__}")
        known = {f.name for f in fields(cls)}
        extra = sorted(set(raw) - known)
        _check(not extra, f"{cls.kind} body has unknown fields {extra}")
        try:
            return cls(**raw)
        except TypeError as exc:
            raise SpecError(f"{cls.kind} body is incomplete: {exc}") from exc

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def _set(self, name: str, value: Any) -> None:
        object.__setattr__(self, name, value)


@dataclass(frozen=True)
class BinBody(Body):
    kind: ClassVar[str] = "bin"
    edges: list[float]
    labels: list[str]
    null_handling: str = "null"
    null_label: str | None = None

    def __post_init__(self) -> None:
        try:
            self._set("edges", [float(e) for e in self.edges])
        except (TypeError, ValueError) as exc:
            raise SpecError(f"edges must be numbers: {self.edges!r}") from exc
        self._set("labels", [_text(v, "label") for v in self.labels])
        _check(len(self.edges) >= 1, "edges must not be empty")
        _check(all(a < b for a, b in zip(self.edges, self.edges[1:])), f"edges must increase strictly: {self.edges}")
        _check(len(set(self.labels)) == len(self.labels), f"labels must be unique: {self.labels}")
        _check(len(self.labels) == len(self.edges) + 1,
               f"{len(self.edges)} edges need {len(self.edges) + 1} labels, got {len(self.labels)}")
        _choice(self.null_handling, "null_handling", ("null", "label", "error"))
        _only_with(self.null_handling, "label", self.null_label, "null_label")


@dataclass(frozen=True)
class FlagBody(Body):
    kind: ClassVar[str] = "flag"
    map: dict[str, str]
    null_handling: str = "null"
    null_value: str | None = None
    unmapped_handling: str = "null"
    unmapped_value: str | None = None

    def __post_init__(self) -> None:
        _check(isinstance(self.map, Mapping) and len(self.map) >= 1, "map must hold at least one entry")
        self._set("map", {_text(k, "map key"): _text(v, "map value") for k, v in self.map.items()})
        _choice(self.null_handling, "null_handling", ("null", "value", "error"))
        _choice(self.unmapped_handling, "unmapped_handling", ("null", "value", "error"))
        _only_with(self.null_handling, "value", self.null_value, "null_value")
        _only_with(self.unmapped_handling, "value", self.unmapped_value, "unmapped_value")


@dataclass(frozen=True)
class DurationBody(Body):
    kind: ClassVar[str] = "duration"
    start_column: str
    end_column: str
    unit: str = "days"
    null_handling: str = "null"

    def __post_init__(self) -> None:
        _check(bool(_text(self.start_column, "start_column")), "start_column must not be empty")
        _check(bool(_text(self.end_column, "end_column")), "end_column must not be empty")
        _check(self.start_column != self.end_column, f"start and end column are both {self.start_column!r}")
        _choice(self.unit, "unit", tuple(UNIT_DAYS))
        _choice(self.null_handling, "null_handling", ("null", "error"))


@dataclass(frozen=True)
class Condition(Body):
    kind: ClassVar[str] = "condition"
    column: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        _check(bool(_text(self.column, "column")), "condition column must not be empty")
        _choice(self.op, "op", OPS)
        if self.op in ("is_null", "not_null"):
            _check(self.value is None, f"op {self.op!r} takes no value")
        elif self.op == "in":
            _check(isinstance(self.value, list), "op 'in' needs a list value")
        else:
            _check(self.value is not None, f"op {self.op!r} needs a value")
            if self.op in ORDER_OPS:
                _check(isinstance(self.value, (int, float)), f"op {self.op!r} needs a number, got {self.value!r}")


@dataclass(frozen=True)
class CompoundBody(Body):
    kind: ClassVar[str] = "compound"
    conditions: list[Condition]
    combinator: str = "and"
    true_value: str = "Y"
    false_value: str = "N"
    null_handling: str = "false"

    def __post_init__(self) -> None:
        self._set("conditions", [Condition.parse(c) for c in self.conditions])
        _check(len(self.conditions) >= 1, "conditions must not be empty")
        _choice(self.combinator, "combinator", ("and", "or"))
        _text(self.true_value, "true_value")
        _text(self.false_value, "false_value")
        _choice(self.null_handling, "null_handling", ("null", "false", "true", "error"))


@dataclass(frozen=True)
class Tier(Body):
    kind: ClassVar[str] = "tier"
    label: str
    conditions: list[Condition]
    combinator: str = "and"

    def __post_init__(self) -> None:
        _check(bool(_text(self.label, "tier label")), "tier label must not be empty")
        self._set("conditions", [Condition.parse(c) for c in self.conditions])
        _check(len(self.conditions) >= 1, f"tier {self.label!r} has no conditions")
        _choice(self.combinator, "combinator", ("and", "or"))


@dataclass(frozen=True)
class RiskScoreBody(Body):
    kind: ClassVar[str] = "risk_score"
    tiers: list[Tier]
    fallback_label: str
    null_handling: str = "fallback"

    def __post_init__(self) -> None:
        self._set("tiers", [Tier.parse(t) for t in self.tiers])
        _check(len(self.tiers) >= 1, "tiers must not be empty")
        labels = [t.label for t in self.tiers]
        _check(len(set(labels)) == len(labels), f"tier labels must be unique: {labels}")
        _check(bool(_text(self.fallback_label, "fallback_label")), "fallback_label must not be empty")
        _choice(self.null_handling, "null_handling", ("null", "fallback", "error"))
