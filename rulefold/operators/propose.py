"""Derivation proposals from column profiles, for any number of datasets at once.

The profile table has one row per dataset and column, so a dataset's group is as wide as its schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefold import fixed_values as fixed

FIELDS = ["dataset", "seq", "name", "inputs", "rule_kind", "rule_body", "rationale", "confidence", "reason"]


def _named(pattern: str) -> Column:
    return F.col("column").rlike(f"(?i){pattern}")


def _proposal(df: DataFrame, **c: Column) -> DataFrame:
    return df.select("dataset", *[c[f].alias(f) for f in FIELDS[1:]])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def age_groups(profiles: DataFrame) -> DataFrame:
    lo, hi = F.coalesce("min", F.lit(0.0)), F.coalesce("max", F.lit(100.0))
    edges = F.array_compact(F.array(F.when(lo < 18, F.lit(18.0)), F.when(hi >= 65, F.lit(65.0))))
    labels = F.array_compact(F.array(
        F.when(lo < 18, F.lit("minor")), F.lit("adult"), F.when(hi >= 65, F.lit("senior"))))
    rows = profiles.where((F.col("kind") == "numeric") & _named(fixed.AGE_NAME)).where(F.size(labels) >= 2)
    return _proposal(
        rows, seq=F.col("position") * 2, name=F.lit("AGE_GROUP"), inputs=F.array("column"), rule_kind=F.lit("bin"),
        rule_body=_json(edges=edges, labels=labels),
        rationale=F.concat(F.lit("Age bands over "), F.col("column")), confidence=F.lit(0.90),
        reason=F.concat(F.col("column"), F.lit(" is numeric and named like an age")))


def _word(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(low.isin(fixed.YES_WORDS), F.lit("Y")).when(low.isin(fixed.NO_WORDS), F.lit("N"))
        .when(low.isin(fixed.UNKNOWN_WORDS), F.lit("U")).otherwise(F.substring(F.upper(value), 1, 3))
    )


def flags(profiles: DataFrame) -> DataFrame:
    rows = profiles.where((F.col("kind") == "low_cardinality") & _named(fixed.FLAG_NAME)).where(
        F.size("values").between(1, 6))
    body = _json(
        map=F.map_from_arrays("values", F.transform("values", _word)),
        unmapped_handling=F.lit("value"), unmapped_value=F.lit("U"))
    return _proposal(
        rows, seq=F.col("position") * 2 + 1, name=F.concat(F.upper("column"), F.lit("_FLAG")), inputs=F.array("column"),
        rule_kind=F.lit("flag"), rule_body=body,
        rationale=F.concat(F.lit("Short codes for "), F.col("column")), confidence=F.lit(0.85),
        reason=F.concat(F.col("column"), F.lit(" has few values and is named like a category")))


LAST = 1_000_000


def _first(cond: Column) -> Column:
    return F.min_by("column", F.when(cond, F.col("position")))


def durations(profiles: DataFrame) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("position", "column")))
    rows = profiles.where("kind = 'date'").groupBy("dataset").agg(
        _first(_named(fixed.START_NAME)).alias("s"), _first(_named(fixed.END_NAME)).alias("e"), in_order.alias("all"))
    rows = rows.where(F.size("all") >= 2)
    paired = F.coalesce(F.col("s") != F.col("e"), F.lit(False))
    start = F.when(paired, F.col("s")).otherwise(F.col("all")[0]["column"])
    end = F.when(paired, F.col("e")).otherwise(F.col("all")[1]["column"])
    return _proposal(
        rows, seq=F.lit(LAST), name=F.lit("TREATMENT_DURATION"), inputs=F.array(start, end), rule_kind=F.lit("duration"),
        rule_body=_json(start_column=start, end_column=end, unit=F.lit("days"), null_handling=F.lit("null")),
        rationale=F.concat(F.lit("Days from "), start, F.lit(" to "), end), confidence=F.lit(0.80),
        reason=F.concat(F.lit("date columns "), start, F.lit(" and "), end))


def populations(profiles: DataFrame) -> DataFrame:
    age = (F.col("kind") == "numeric") & _named(fixed.AGE_NAME)
    outcome = (F.col("kind") == "low_cardinality") & _named(fixed.OUTCOME_NAME)
    rows = profiles.groupBy("dataset").agg(_first(age).alias("a"), _first(outcome).alias("o"))
    rows = rows.where(F.col("a").isNotNull() & F.col("o").isNotNull())
    adult = F.struct(F.col("a").alias("column"), F.lit(">=").alias("op"), F.lit(18).alias("value"))
    recorded = F.struct(F.col("o").alias("column"), F.lit("not_null").alias("op"), F.lit(None).cast("int").alias("value"))
    return _proposal(
        rows, seq=F.lit(LAST + 1), name=F.lit("ANALYSIS_POP_FLAG"), inputs=F.array("a", "o"), rule_kind=F.lit("compound"),
        rule_body=_json(conditions=F.array(adult, recorded), combinator=F.lit("and"), true_value=F.lit("Y"),
                        false_value=F.lit("N"), null_handling=F.lit("false")),
        rationale=F.concat(F.lit("Adults with a recorded "), F.col("o")), confidence=F.lit(0.70),
        reason=F.concat(F.col("a"), F.lit(" and "), F.col("o"), F.lit(" are both present")))


def risk_groups(profiles: DataFrame) -> DataFrame:
    numeric = F.col("kind") == "numeric"
    age = numeric & _named(fixed.AGE_NAME)
    measure = numeric & ~_named(fixed.AGE_NAME) & _named(fixed.MEASUREMENT_NAME)

    def top(cond: Column) -> Column:
        return F.min_by(F.col("max"), F.when(cond, F.col("position")))

    rows = profiles.groupBy("dataset").agg(
        _first(age).alias("a"), _first(measure).alias("m"), top(age).alias("a_max"), top(measure).alias("m_max"))
    rows = rows.where(F.col("a").isNotNull() & F.col("m").isNotNull())
    a_max, m_max = F.coalesce("a_max", F.lit(90.0)), F.coalesce("m_max", F.lit(100.0))
    old = F.when(a_max >= 65, F.lit(65.0)).otherwise(F.bround(a_max * 0.8, 0))

    def at_least(column: str, value: Column) -> Column:
        return F.struct(F.col(column).alias("column"), F.lit(">=").alias("op"), value.alias("value"))

    def tier(label: str, combinator: str, *conditions: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(combinator).alias("combinator"),
                        F.array(*conditions).alias("conditions"))

    body = _json(
        tiers=F.array(
            tier("high", "and", at_least("a", old), at_least("m", F.bround(m_max * 0.75, 0))),
            tier("medium", "or", at_least("m", F.bround(m_max * 0.5, 0)), at_least("a", old))),
        fallback_label=F.lit("low"), null_handling=F.lit("fallback"))
    return _proposal(
        rows, seq=F.lit(LAST + 2), name=F.lit("RISK_GROUP"), inputs=F.array("a", "m"), rule_kind=F.lit("risk_score"),
        rule_body=body, rationale=F.concat(F.lit("Tiers over "), F.col("a"), F.lit(" and "), F.col("m")),
        confidence=F.lit(0.55), reason=F.concat(F.col("a"), F.lit(" and "), F.col("m"), F.lit("; cut points are placeholders")))


def band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.90, F.lit("Strong")).when(confidence >= 0.70, F.lit("Likely"))
        .when(confidence >= 0.50, F.lit("Tentative")).otherwise(F.lit("Weak"))
    )


def propose(profiles: DataFrame) -> DataFrame:
    """Ranked proposals per dataset; of equal (name, kind) the first stays."""
    parts = [f(profiles) for f in (age_groups, flags, durations, populations, risk_groups)]
    rows = reduce(DataFrame.unionByName, parts)
    keys = ["dataset", "name", "rule_kind"]
    rest = [f for f in FIELDS if f not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("confidence"), "seq"))
    return firsts.withColumn("place", place).withColumn("band", band(F.col("confidence")))


def add_extras(proposals: DataFrame, extras: DataFrame) -> DataFrame:
    """Proposals from elsewhere that do not reuse a name already proposed for their dataset."""
    fresh = extras.join(proposals.select("dataset", "name"), ["dataset", "name"], "left_anti")
    return proposals.unionByName(fresh, allowMissingColumns=True)


def accepted_entries(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Spec entries of the accepted proposals; accepted(dataset, name, new_name) may rename."""
    return proposals.join(accepted, ["dataset", "name"]).select(
        F.col("dataset").alias("study_id"), F.coalesce("new_name", "name").alias("name"), "inputs", "rule_kind",
        "rule_body", "rationale", F.lit(None).cast("string").alias("ambiguity_notes"))
