"""Column profiles.

One wide aggregate covers every column (missing, min, max, approximate distinct, date hits); exact distinct
counts follow. Columns that may be low-cardinality get them, with their values, from sets of a
few dozen entries; the remaining ones together from one aggregate over (column, value), only when `exact` is asked for.

`profile_states` gives the same as states that can be stored and merged: the profile of old and new data needs no second look at the old.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold import fixed_values as fixed
from rulefold.functions.cells import FLOATING, INTEGRAL, TEMPORAL, col, is_missing, is_numeric, key_text
from rulefold.functions.dates import format_counts, format_hits, format_index

LOW_CARDINALITY = 20
CANDIDATE = 40
DATE_SHARE = 0.8
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

PROFILE = (
    "dataset string, column string, position int, kind string, dtype string, null_fraction double, "
    "n_unique bigint, min double, max double, values array<string>, sample_values array<string>"
)
STATES = (
    "dataset string, part string, column string, position int, dtype string, n bigint, present bigint, low double, high double, hits array<bigint>, "
    "sketch binary, values array<string>"
)
SAMPLES = 5
CLASSES = 64


def _present(f: T.StructField) -> Column:
    if isinstance(f.dataType, NESTED):
        return F.when(col(f.name).isNotNull(), F.lit(True))
    return F.when(~is_missing(col(f.name), f.dataType), col(f.name))


def _cell(i: int, f: T.StructField) -> Column:
    """(position, value) of a present cell for distinct counting; long texts go by their digest so they do not travel whole."""
    c, dtype = _present(f), f.dataType
    whole, real = isinstance(dtype, INTEGRAL), isinstance(dtype, FLOATING)
    text = key_text(c, dtype)
    if isinstance(dtype, T.StringType):
        text = F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)
    return F.when(c.isNotNull(), F.struct(
        F.lit(i).alias("position"), (c.cast("bigint") if whole else F.lit(None).cast("bigint")).alias("whole"),
        (c.cast("double") if real else F.lit(None).cast("double")).alias("real"),
        (F.lit(None).cast("string") if whole or real else text).alias("text")))


def _may_be_date(f: T.StructField) -> bool:
    return bool(re.search(fixed.DATE_NAME, f.name, re.IGNORECASE))


def _is_nested(f: T.StructField) -> bool:
    return isinstance(f.dataType, NESTED)


def _counted(df: DataFrame, sketches: bool) -> tuple[list[dict], int]:
    """Per column what one aggregate over the table tells: n, present, low, high, hits of date formats, distinct (estimated), sketch."""
    fields = list(df.schema)
    wanted = [F.count(F.lit(1)).alias("n")]
    dates: dict[str, Column] = {}
    for i, f in enumerate(fields):
        c = _present(f)
        wanted.append(F.count(c).alias(f"p{i}"))
        if _is_nested(f):
            continue
        if sketches:
            sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)))
            wanted += [sketch.alias(f"s{i}"), F.hll_sketch_estimate(sketch).alias(f"a{i}")]
        else:
            wanted.append(F.approx_count_distinct(c, 0.05).alias(f"a{i}"))
        if is_numeric(f.dataType):
            wanted += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
        if _may_be_date(f) and isinstance(f.dataType, T.StringType):
            dates[f"_date{i}"] = format_index(f.name)
            wanted += format_counts(f"_date{i}", f"d{i}")
    row = df.withColumns(dates).agg(*wanted).first().asDict()
    found = []
    for i, f in enumerate(fields):
        found.append({
            "column": f.name, "position": i, "dtype": f.dataType.simpleString(), "present": row[f"p{i}"], "low": row.get(f"lo{i}"), "high": row.get(f"hi{i}"),
            "hits": format_hits(row, f"d{i}") if f"_date{i}" in dates else None, "sketch": row.get(f"s{i}"), "distinct": row.get(f"a{i}"), "values": None})
    # sets run apart: in one aggregate with the rest, every row would carry them
    small = [i for i, f in enumerate(fields) if not _is_nested(f) and (found[i]["distinct"] or 0) <= CANDIDATE]
    if small:
        sets = df.agg(*[F.collect_set(key_text(_present(fields[i]), fields[i].dataType)).alias(f"v{i}") for i in small]).first()
        for i in small:
            found[i]["values"] = sorted(sets[f"v{i}"])
            found[i]["distinct"] = len(found[i]["values"])
    return found, row["n"]


def _profiled(fields: dict[str, T.DataType], found: dict, n: int, dataset: str, samples: dict[str, list[str]]) -> tuple:
    name, present = found["column"], found["present"]
    gap = (n - present) / n if n else None
    f = T.StructField(name, fields[name])
    if _is_nested(f):
        return (dataset, name, found["position"], "nested", found["dtype"], gap, None, None, None, None, samples.get(name))
    kind = _kind(f, found["hits"], present, found["distinct"])
    numeric = kind == "numeric"
    return (
        dataset, name, found["position"], kind, found["dtype"], gap, found["distinct"],
        found["low"] if numeric else None, found["high"] if numeric else None,
        found["values"] if kind == "low_cardinality" else None, samples.get(name))


def profile(df: DataFrame, dataset: str = "dataset", *, exact: bool = True, key: str | None = None) -> DataFrame:
    """One row per column: kind, type, missing share, distinct count, range, low-cardinality values and up to five sample values.

    With exact=False the distinct count of a high-cardinality column is approximate. Samples are the first present values in the order of
    `key`; without a key, those that a scan of the table meets first. Nested columns have kind, type, missing share and samples.
    """
    fields = list(df.schema)
    found, n = _counted(df, sketches=False)
    large = [i for i, f in enumerate(fields) if not _is_nested(f) and found[i]["values"] is None]
    if exact and large:
        cells = df.select(F.explode(F.array(*[_cell(i, fields[i]) for i in large])).alias("c")).select("c.*").where("position IS NOT NULL")
        for r in cells.distinct().groupBy("position").count().collect():
            found[r["position"]]["distinct"] = r["count"]
    samples = _first_met(df) if key is None else _by_column(sample_values(df, key, SAMPLES))
    types = {f.name: f.dataType for f in fields}
    return df.sparkSession.createDataFrame([_profiled(types, x, n, dataset, samples) for x in found], PROFILE)


def profile_states(df: DataFrame, part: str, dataset: str = "dataset") -> DataFrame:
    """One row per column of a named part of a dataset (STATES), to be stored; `merged_profile` turns the states of all parts into a profile.

    Distinct values are held as a sketch of some kilobytes, and by name where they are few dozens. An empty part has no values and no sketch.
    """
    found, n = _counted(df, sketches=True)
    rows = [(dataset, part, x["column"], x["position"], x["dtype"], n, x["present"], x["low"], x["high"], x["hits"], x["sketch"], x["values"]) for x in found]
    return df.sparkSession.createDataFrame(rows, STATES)


def merged_profile(states: DataFrame) -> DataFrame:
    """Profile of all the parts whose states are given, without samples; the parts themselves are not read, and one stored twice counts once.

    Distinct counts are exact where all parts have their values by name, else estimated from the merged sketches (about 2 %). Parts may
    add columns, which count as missing in the others; a column whose type differs between parts is an error.
    """
    once = states.dropDuplicates(["dataset", "part", "column"])
    rows = once.select("dataset", "part", "n").distinct().groupBy("dataset").agg(F.sum("n").alias("n"))
    merged = once.groupBy("dataset", "column").agg(
        F.min("position").alias("position"), F.min("dtype").alias("dtype"), F.max("dtype").alias("other"), F.sum("present").alias("present"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
        F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"),
        (F.count("values") == F.count("*")).alias("named"))
    out = []
    for r in merged.join(rows, "dataset").orderBy("dataset", "position", "column").collect():  # a row per column
        if r["dtype"] != r["other"]:
            raise ValueError(f"column {r['column']!r} of {r['dataset']!r} is {r['dtype']} in one part and {r['other']} in another")
        found = r.asDict() | {"hits": [sum(x) for x in zip(*r["hits"], strict=True)] or None}
        found["values"], found["distinct"] = (r["values"], len(r["values"])) if r["named"] else (None, r["distinct"])
        out.append(_profiled({r["column"]: T.DataType.fromDDL(r["dtype"])}, found, r["n"], r["dataset"], {}))
    return states.sparkSession.createDataFrame(out, PROFILE)


def _kind(f: T.StructField, hits: list[int] | None, present: int, unique: int) -> str:
    if present and _may_be_date(f) and not isinstance(f.dataType, T.BooleanType):
        if isinstance(f.dataType, TEMPORAL) or is_numeric(f.dataType):
            return "date"
        if isinstance(f.dataType, T.StringType):
            if max(hits) / present >= DATE_SHARE:
                return "date"
    if is_numeric(f.dataType):
        return "numeric"
    if not present:
        return "unknown"
    return "low_cardinality" if unique <= LOW_CARDINALITY else "high_cardinality"


def redacted(profiles: DataFrame) -> DataFrame:
    """Profile without cell contents: no samples, value lists only when tiny, missing share rounded."""
    return profiles.select(
        "dataset", "column", "position", "kind", "dtype", F.bround("null_fraction", 2).alias("null_fraction"),
        "n_unique", "min", "max", F.when(F.size("values") <= 6, F.col("values")).alias("values"))


def _shown(f: T.StructField) -> Column:
    """Text of a present cell, null for a missing one; nested ones as JSON."""
    c = col(f.name)
    if _is_nested(f):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias(f.name))))
    return F.when(~is_missing(c, f.dataType), key_text(c, f.dataType))


def sample_values(df: DataFrame, key: str, n: int = SAMPLES) -> DataFrame:
    """First n present values of every column, the key's among them, in key order: (column, place, value); nested ones as JSON.

    Two scans at any number of columns. The first gives a bound per column: the n-th smallest of the smallest keys of some classes of
    rows, at or above the n-th smallest key. The second ranks the cells up to their column's bound, a few per column unless keys repeat;
    tasks hand on n cells per column at most. Rows without a key come first.
    """
    fields = list(df.schema)
    k = col(key)
    least = df.groupBy(F.pmod(F.xxhash64(k), F.lit(max(CLASSES, n))).alias("class")).agg(
        *[F.min(F.when(_shown(f).isNotNull(), k)).alias(f"k{i}") for i, f in enumerate(fields)])
    bounds = least.agg(F.struct(*[F.try_element_at(F.array_sort(F.collect_list(f"k{i}")), F.lit(n)).alias(f"b{i}") for i in range(len(fields))]).alias("b")).scalar()
    cells = [
        F.when(k.isNull() | bounds[f"b{i}"].isNull() | (k <= bounds[f"b{i}"]), F.struct(F.lit(f.name).alias("column"), _shown(f).alias("value")))
        for i, f in enumerate(fields)]
    listed = df.select(k.alias("key"), F.explode(F.array(*cells)).alias("c")).select("key", "c.*").where("value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("column").orderBy("key", "value"))
    return listed.withColumn("place", place).where(F.col("place") <= n).select("column", "place", "value")


def _by_column(samples: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in samples.orderBy("column", "place").collect():  # at most SAMPLES for a column
        out.setdefault(r["column"], []).append(r["value"])
    return out


def _first_met(df: DataFrame) -> dict[str, list[str]]:
    """Samples in the order of a scan, which ends when it has them: some first rows, and further ones for columns they leave short."""
    fields = list(df.schema)
    shown = df.select(*[_shown(f).alias(f"c{i}") for i, f in enumerate(fields)])
    head = shown.head(4 * SAMPLES)
    out = {}
    for i, f in enumerate(fields):
        values = [r[i] for r in head if r[i] is not None][:SAMPLES]
        if len(values) < SAMPLES <= len(head):
            values = [r[0] for r in shown.select(f"c{i}").where(F.col(f"c{i}").isNotNull()).head(SAMPLES)]
        out[f.name] = values
    return out
