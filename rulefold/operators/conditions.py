"""Column-against-constant predicates with three-valued truth.

NULL means undefined: the operand is missing, or an ordering was asked of something that is not a number.
Type mismatches in equality are decided while building the expression, so no cast can fail at run time.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import TEMPORAL, col, is_missing, is_numeric, num
from rulefold.plans.bodies import Condition
from rulefold.plans.errors import SpecError


def _same_family(value: Any, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    return is_numeric(dtype) and isinstance(value, (bool, int, float))


def _constant(value: Any, dtype: T.DataType) -> Column:
    """Literal comparable to the operand of `_operand`."""
    if isinstance(dtype, T.StringType) or is_integer_like(dtype, value):
        return F.lit(value)
    return F.lit(float(value))


def is_integer_like(dtype: T.DataType, value: Any) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and type(value) is int


def _equals(c: Column, dtype: T.DataType, value: Any) -> Column:
    """Equality for a non-missing operand; a type mismatch is simply false."""
    if isinstance(dtype, T.StringType):
        return c == F.lit(str(value))
    if isinstance(dtype, TEMPORAL) and isinstance(value, str):
        return F.coalesce(c.cast("timestamp_ntz") == F.lit(value).try_cast("timestamp_ntz"), F.lit(False))
    if not _same_family(value, dtype):
        return F.lit(False)
    operand = c if is_integer_like(dtype, value) else num(c, dtype)
    return operand == _constant(value, dtype)


def truth(cond: Condition, schema: T.StructType) -> Column:
    """Truth of one condition: TRUE, FALSE or NULL (undefined)."""
    if cond.column not in schema.fieldNames():
        raise SpecError(f"condition reads unknown column {cond.column!r}; available: {schema.fieldNames()}")
    c, dtype = col(cond.column), schema[cond.column].dataType
    missing = is_missing(c, dtype)
    if cond.op == "is_null":
        return missing
    if cond.op == "not_null":
        return ~missing
    if cond.op in (">=", "<=", ">", "<"):
        value = cond.value
        operand = c if is_integer_like(dtype, value) else num(c, dtype)
        bound = F.lit(value) if is_integer_like(dtype, value) else F.lit(float(value))
        return {">=": operand >= bound, "<=": operand <= bound, ">": operand > bound, "<": operand < bound}[cond.op]
    if cond.op == "in":
        members = [v for v in cond.value if v is not None and _same_family(v, dtype)]
        operand = c if isinstance(dtype, T.StringType) else num(c, dtype)
        hit = operand.isin([v if isinstance(v, str) else float(v) for v in members]) if members else F.lit(False)
        return F.when(~missing, hit)
    equal = _equals(c, dtype, cond.value)
    return F.when(~missing, equal if cond.op == "==" else ~equal)


def fold(conditions: list[Condition], combinator: str, schema: T.StructType) -> Column:
    """AND / OR over conditions; Spark's own three-valued logic is the one wanted."""
    truths = [truth(c, schema) for c in conditions]
    return reduce((lambda a, b: a & b) if combinator == "and" else (lambda a, b: a | b), truths)


def describe(conditions: list[Condition], combinator: str) -> str:
    parts = [f"{c.column} {c.op}" + ("" if c.value is None else f" {c.value}") for c in conditions]
    return f" {combinator.upper()} ".join(parts)
