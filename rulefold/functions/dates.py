"""Date parsing with one format per column.

A text column has one date format; cells of another shape are treated as missing. The format is chosen by
majority over FORMATS in a single aggregate (ties go to the earlier entry), or given by the caller.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import FLOATING, TEMPORAL, col, is_numeric

# Fixed values: (pattern a cell must match, parse format).
FORMATS: list[tuple[str, str]] = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$",
     "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]


def parse_text(c: Column, fmt: str) -> Column:
    """Text to timestamp under one format; NULL when it does not fit."""
    pattern = next((p for p, f in FORMATS if f == fmt), None)
    parsed = F.try_to_timestamp(c, F.lit(fmt))
    return parsed if pattern is None else F.when(c.rlike(pattern), parsed)


def as_timestamp(c: Column, dtype: T.DataType, fmt: str | None) -> Column:
    """Zone-free timestamp of a temporal or text column."""
    if isinstance(dtype, TEMPORAL):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        if fmt is None:
            raise ValueError("a text date column needs a format; see detect_formats")
        return parse_text(c, fmt).cast("timestamp_ntz")
    raise ValueError(f"cannot read dates from a {dtype.simpleString()} column")


MONTH_FIRST = next(i for i, (_, f) in enumerate(FORMATS) if f == "M/d/yyyy")
DAY_FIRST = MONTH_FIRST + 1
EITHER = len(FORMATS)


# Text with every digit written as 9, for each format without month names; the others are told by their pattern.
_DAY, _CLOCK, _FRACTIONS = "9999-99-99", "99:99:99", ["." + "9" * n for n in range(1, 7)]
_SLASHED = [f"{a}/{b}" for a in ("9", "99") for b in ("9", "99")]
SHAPES: dict[int, list[str]] = {
    0: [_DAY],
    1: [f"{_DAY} {_CLOCK}"],
    2: [f"{_DAY} {_CLOCK}{f}" for f in _FRACTIONS],
    3: [f"{_DAY}T{_CLOCK}"],
    4: [f"{_DAY}T{_CLOCK}{f}{z}" for f in ("", *_FRACTIONS) for z in ("Z", "+99:99", "-99:99")],
    MONTH_FIRST: [f"{x}/9999" for x in _SLASHED],
    7: [f"9999/{x}" for x in _SLASHED],
    10: ["9" * 8],
}


def format_index(name: str) -> Column:
    """Position in FORMATS of the format a text cell fits (EITHER for month- or day-first), else NULL.

    Shapes exclude each other, so a cell is parsed once, under the format of its shape. Written as one SQL
    expression because it has many parts.
    """
    c = "`" + name.replace("`", "``") + "`"

    def fits(fmt: str) -> str:
        quoted = fmt.replace("'", "\\'")
        return f"try_to_timestamp({c}, '{quoted}') IS NOT NULL"

    cases = []
    for i, (pattern, fmt) in enumerate(FORMATS):
        if i == MONTH_FIRST:
            # a part above 12 is no month: what cannot be parsed is not tried
            month, day = (f"CAST(split_part({c}, '/', {k}) AS INT) <= 12" for k in (1, 2))
            first, other = f"({month} AND {fits(fmt)})", f"({day} AND {fits(FORMATS[DAY_FIRST][1])})"
            hit = f"CASE WHEN {first} THEN IF({other}, {EITHER}, {i}) WHEN {other} THEN {DAY_FIRST} END"
        else:
            hit = f"CASE WHEN {fits(fmt)} THEN {i} END"
        if i != DAY_FIRST:
            cases.append((i in SHAPES, f"WHEN {_of_shape(c, SHAPES[i]) if i in SHAPES else f"{c} RLIKE r'{pattern}'"} THEN {hit}"))
    # shapes are compared first, patterns only with what has none of them
    return F.expr(f"CASE {' '.join(text for known, text in sorted(cases, key=lambda x: not x[0]))} END")


def _of_shape(c: str, shapes: list[str]) -> str:
    """SQL that tells whether a cell has one of the shapes; its length decides first, as most cells have another."""
    sizes, texts = sorted({len(x) for x in shapes}), ", ".join(f"'{x}'" for x in shapes)
    return f"length({c}) BETWEEN {sizes[0]} AND {sizes[-1]} AND translate({c}, '012345678', '999999999') IN ({texts})"


def format_counts(index: str, name: str) -> list[Column]:
    """Aggregates counting cells per format over a `format_index` column; read back with `format_hits`."""
    return [F.expr(f"count_if({index} = {j}) AS {name}_{j}") for j in range(EITHER + 1)]


def format_hits(row, name: str) -> list[int]:
    """Cells per format, ambiguous ones counted for both."""
    hits = [row[f"{name}_{j}"] for j in range(EITHER)]
    for j in (MONTH_FIRST, DAY_FIRST):
        hits[j] += row[f"{name}_{EITHER}"]
    return hits


def detect_formats(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent parse format per text column, in one aggregate over the table."""
    return decide(df, columns, {}, [])[0]


def decide(df: DataFrame, columns: list[str], formats: Mapping[str, str], spans: list[tuple[str, str, int]]) -> tuple[dict[str, str], dict[tuple[str, str, int], bool]]:
    """Formats of text columns and, for pairs of date columns, whether all their differences are whole: one pass over the table.

    `columns` are text columns to find the most frequent format of, `formats` gives those of others. The second result tells per span (start, end, days of
    its unit) if some difference is present and all are whole numbers of the unit, under the formats found: a row is looked at under the formats its
    cells have (a month- or day-first one under both), and differences are kept apart by these, so text is parsed once.
    """
    columns = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    pairs, widths = list(dict.fromkeys((a, b) for a, b, _ in spans)), sorted({n for _, _, n in spans})
    if not columns and not pairs:
        return {}, {}
    number = {c: i for i, c in enumerate(columns)}
    indexed = df.select("*", *[format_index(c).alias(f"__format_{i}") for c, i in number.items()])
    ends = dict.fromkeys(c for pair in pairs for c in pair)
    read: list[Column] = [F.col(f"__format_{i}") for i in number.values()]
    for k, c in enumerate(ends):
        for j, (of_format, at) in enumerate(_readings(c, df.schema[c].dataType, formats.get(c), number.get(c), all(n == 1 for a, b, n in spans if c in (a, b)))):
            read += [F.when(at.isNotNull(), of_format).alias(f"__of_{k}_{j}"), at.alias(f"__at_{k}_{j}")]
    rows = indexed.select(*read)
    place = {c: k for k, c in enumerate(ends)}
    steps = []
    for p, (a, b) in enumerate(pairs):
        for i in (0, 1):
            for j in (0, 1):
                x, y = (f"{place[a]}_{i}", f"{place[b]}_{j}")
                if {f"__at_{x}", f"__at_{y}"} <= set(rows.columns):
                    steps.append((p, f"__m_{p}_{i}{j}", x, y))
    rows = rows.select("*", *[micros_between(F.col(f"__at_{x}"), F.col(f"__at_{y}")).alias(m) for _, m, x, y in steps])
    found: list[Column] = []
    for _, m, x, y in steps:
        bits = sum((F.when(F.col(m) % (n * DAY_MICROS) != 0, 1 << u).otherwise(0) for u, n in enumerate(widths)), F.lit(0))
        broken = F.when(F.col(m).isNotNull(), bits)
        if {*pairs[p]} & {*number}:
            found.append(F.collect_set(F.when(broken.isNotNull(), F.struct(F.col(f"__of_{x}").alias("a"), F.col(f"__of_{y}").alias("b"), broken.alias("broken")))).alias(m))
        else:  # one reading: a number is enough
            found.append(F.when(F.bit_or(broken).isNotNull(), F.array(F.struct(F.lit(FIXED).alias("a"), F.lit(FIXED).alias("b"), F.bit_or(broken).alias("broken")))).alias(m))
    counts = [a for i in number.values() for a in format_counts(f"__format_{i}", f"__n_{i}")]
    row = rows.agg(*counts, *found).first()  # a few numbers for each column, and at most len(FORMATS) ** 2 * 2 ** len(widths) marks for each pair
    chosen = {}
    for c, i in number.items():
        hits = format_hits(row, f"__n_{i}")
        chosen[c] = hits.index(max(hits))
    whole = {}
    for p, (a, b) in enumerate(pairs):
        marks = [x["broken"] for q, m, _, _ in steps if q == p for x in row[m] or [] if x["a"] in (FIXED, chosen.get(a)) and x["b"] in (FIXED, chosen.get(b))]
        for u, n in enumerate(widths):
            whole[a, b, n] = bool(marks) and not any(x >> u & 1 for x in marks)
    return {c: FORMATS[i][1] for c, i in chosen.items()}, whole


DAY_MICROS = 86_400_000_000
FIXED = -1  # stands for the one reading of a column whose format is known


def _readings(name: str, dtype: T.DataType, fmt: str | None, number: int | None, whole_days: bool) -> list[tuple[Column, Column]]:
    """How a cell can be read: (position of the format or FIXED, timestamp); two ways only where month and day may be either.

    With `whole_days` only the time of day matters, and a date is not parsed: any midnight will do.
    """
    c = col(name)
    if number is None:
        return [(F.lit(FIXED), as_timestamp(c, dtype, fmt))]
    index = F.col(f"__format_{number}")

    def at(i: int) -> Column:
        if whole_days and "H" not in FORMATS[i][1]:
            return F.lit(datetime.datetime(2000, 1, 1)).cast("timestamp_ntz")
        return F.try_to_timestamp(c, F.lit(FORMATS[i][1])).cast("timestamp_ntz")

    first = F
    for i in range(len(FORMATS)):
        first = first.when(F.when(index == EITHER, MONTH_FIRST).otherwise(index) == i, at(i))
    return [(F.when(index == EITHER, MONTH_FIRST).otherwise(index), first.otherwise(F.lit(None).cast("timestamp_ntz"))),
            (F.lit(DAY_FIRST), F.when(index == EITHER, at(DAY_FIRST)))]


def micros_between(start: Column, end: Column) -> Column:
    """end - start of two zone-free timestamps in microseconds (bigint), independent of the session zone; decimals stay short."""
    between = end - start
    minutes = between.cast("interval minute").cast("bigint")
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), between) * 1_000_000).cast("bigint")


def is_date_source(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*TEMPORAL, T.StringType)) and not is_numeric(dtype) and not isinstance(dtype, FLOATING)
