"""Rule-driven derivation, verification and lineage on Spark DataFrames."""

from rulefold.operators.verify import verify
from rulefold.plans.apply import apply_rule, apply_spec
from rulefold.plans.spec import Spec, SpecEntry

__all__ = ["Spec", "SpecEntry", "apply_rule", "apply_spec", "verify"]
