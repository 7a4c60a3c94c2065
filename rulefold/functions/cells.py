"""Cell-level helpers: missing test, numeric coercion, text form of a value.

NaN counts as missing everywhere; Spark itself orders NaN above every number, so no comparison may be
written without going through these helpers first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    """Column by exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans: booleans are ordered and binned as 0/1."""
    return isinstance(dtype, (*FLOATING, *INTEGRAL, T.DecimalType, T.BooleanType))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    return (c.isNull() | F.isnan(c)) if isinstance(dtype, FLOATING) else c.isNull()


def num(c: Column, dtype: T.DataType) -> Column:
    """Value as double; anything that is not a plain number becomes NULL."""
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        # The pattern is needed because a cast also accepts forms such as '5d'.
        return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def key_text(c: Column, dtype: T.DataType) -> Column:
    """Text under which a value is looked up in a declared map."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, TEMPORAL):
        micros = F.date_format(c, "SSSSSS")
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return c.cast("string")
