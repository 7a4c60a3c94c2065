"""Rule libraries as tables: parsing, linting, normalising, patching and fixing of many specs at once.

Input is a `spec_entries` table (study_id, name, inputs, rule_kind, rule_body JSON text, rationale,
ambiguity_notes). Everything row-wise is one projection; only name uniqueness and joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.functions.signatures import canonical_json, digest, sorted_map
from rulefold.operators.rules import known_rule_kinds
from rulefold.plans.bodies import OPS, ORDER_OPS, UNIT_DAYS

CONDITION = "struct<column:string,op:string,value:variant>"
BODY = (
    "edges array<string>, labels array<string>, null_handling string, null_label string, "
    "map map<string,string>, null_value string, unmapped_handling string, unmapped_value string, "
    "start_column string, end_column string, unit string, "
    f"conditions array<{CONDITION}>, combinator string, true_value string, false_value string, "
    f"tiers array<struct<label:string,conditions:array<{CONDITION}>,combinator:string>>, fallback_label string"
)

# Fields each rule kind accepts in its body.
BODY_FIELDS = {
    "bin": ["edges", "labels", "null_handling", "null_label"],
    "flag": ["map", "null_handling", "null_value", "unmapped_handling", "unmapped_value"],
    "duration": ["start_column", "end_column", "unit", "null_handling"],
    "compound": ["conditions", "combinator", "true_value", "false_value", "null_handling"],
    "risk_score": ["tiers", "fallback_label", "null_handling"],
}

# Fixed values: (rule kind, violated property, body field to reset, new value).
FIXES = [
    ("bin", "P-bin-2", "null_handling", "null"),
    ("flag", "P-flag-2", "null_handling", "null"),
    ("flag", "P-flag-3", "unmapped_handling", "null"),
]


def parsed(entries: DataFrame) -> DataFrame:
    """Entries with the body parsed once as `_b` and its field names as `_keys`."""
    return entries.select(
        "*", F.from_json("rule_body", BODY).alias("_b"),
        F.coalesce(F.json_object_keys("rule_body"), F.array().cast("array<string>")).alias("_keys"),
    )


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) == 0


def _one_of(c: Column, options, default: str) -> Column:
    return F.coalesce(c, F.lit(default)).isin(list(options))


def _only_with(policy: Column, mode: str, value: Column) -> Column:
    """True when `value` is given although the policy does not use it, or the reverse."""
    return F.coalesce(policy == mode, F.lit(False)) != value.isNotNull()


def _condition_wrong(c: Column) -> Column:
    value = c["value"]
    given = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
    shape = F.coalesce(F.schema_of_variant(value), F.lit(""))
    is_list = shape.startswith("ARRAY")
    is_number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    op = c["op"]
    wrong = (
        F.when(op.isin("is_null", "not_null"), given)
        .when(op == "in", ~is_list)
        .when(op.isin(list(ORDER_OPS)), ~is_number)
        .when(op.isin(list(OPS)), ~given)
        .otherwise(F.lit(True))
    )
    return wrong | _blank(c["column"])


def _any_wrong(conditions: Column) -> Column:
    return F.coalesce(F.exists(conditions, _condition_wrong), F.lit(False))


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def _duplicates(a: Column) -> Column:
    return _size(F.array_distinct(a)) != _size(a)


def body_problems() -> list[tuple[str, str, Column]]:
    """(rule kind, property, predicate) over a `parsed` row; the predicate is true when violated."""
    b = F.col("_b")
    edges = F.transform(b["edges"], lambda e: e.try_cast("double"))
    tiers = b["tiers"]
    null_policy = {
        "bin": ["null", "label", "error"], "flag": ["null", "value", "error"], "duration": ["null", "error"],
        "compound": ["null", "false", "true", "error"], "risk_score": ["null", "fallback", "error"],
    }
    rows = [
        ("bin", "bin.edges_present", (_size(edges) == 0) | F.coalesce(F.exists(edges, lambda e: e.isNull()), F.lit(False))),
        ("bin", "bin.edges_increasing",
         F.coalesce(F.size(F.filter(edges, lambda e, i: (i > 0) & ~(F.get(edges, i - 1) < e))) > 0, F.lit(False))),
        ("bin", "bin.labels_unique", _duplicates(b["labels"])),
        ("bin", "bin.labels_match_edges", _size(b["labels"]) != _size(edges) + 1),
        ("bin", "bin.null_label", _only_with(b["null_handling"], "label", b["null_label"])),
        ("flag", "flag.map_present", _size(F.map_keys(b["map"])) == 0),
        ("flag", "flag.null_value", _only_with(b["null_handling"], "value", b["null_value"])),
        ("flag", "flag.unmapped_value", _only_with(b["unmapped_handling"], "value", b["unmapped_value"])),
        ("flag", "flag.unmapped_handling", ~_one_of(b["unmapped_handling"], ["null", "value", "error"], "null")),
        ("duration", "duration.columns_present", _blank(b["start_column"]) | _blank(b["end_column"])),
        ("duration", "duration.columns_distinct", F.coalesce(b["start_column"] == b["end_column"], F.lit(False))),
        ("duration", "duration.unit", ~_one_of(b["unit"], UNIT_DAYS, "days")),
        ("compound", "compound.conditions_present", _size(b["conditions"]) == 0),
        ("compound", "compound.condition_values", _any_wrong(b["conditions"])),
        ("compound", "compound.combinator", ~_one_of(b["combinator"], ["and", "or"], "and")),
        ("risk_score", "risk_score.tiers_present",
         (_size(tiers) == 0) | F.coalesce(F.exists(tiers, lambda t: _size(t["conditions"]) == 0), F.lit(False))),
        ("risk_score", "risk_score.labels_unique", _duplicates(F.transform(tiers, lambda t: t["label"]))),
        ("risk_score", "risk_score.condition_values",
         F.coalesce(F.exists(tiers, lambda t: _any_wrong(t["conditions"])), F.lit(False))),
        ("risk_score", "risk_score.combinator",
         F.coalesce(F.exists(tiers, lambda t: ~_one_of(t["combinator"], ["and", "or"], "and")), F.lit(False))),
        ("risk_score", "risk_score.fallback_present", _blank(b["fallback_label"])),
    ]
    for kind, options in null_policy.items():
        rows.append((kind, f"{kind}.null_handling", ~_one_of(b["null_handling"], options, "null")))
        rows.append((kind, f"{kind}.unknown_fields",
                     F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in BODY_FIELDS[kind]]))) > 0))
    return rows


def problems() -> Column:
    """Array of violated body properties of a `parsed` row."""
    return F.array_compact(F.array(*[
        F.when((F.col("rule_kind") == kind) & bad, F.lit(prop)) for kind, prop, bad in body_problems()
    ]))


def summary(found: Column) -> Column:
    """All problems as text."""
    return F.array_join(found, "; ")


def lint(entries: DataFrame) -> DataFrame:
    """All rule-library problems: (study_id, derivation, property_id)."""
    entry_level = F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0, F.lit("entry.name_blank")),
        F.when(~F.coalesce(F.col("rule_kind").isin(known_rule_kinds()), F.lit(False)), F.lit("entry.kind_unknown")),
        F.when(F.coalesce(F.size("inputs"), F.lit(0)) <= 0, F.lit("entry.inputs_present")),
    ))
    rowwise = parsed(entries).select(
        "study_id", F.col("name").alias("derivation"), F.explode(F.concat(entry_level, problems())).alias("property_id"))
    twice = (
        entries.groupBy("study_id", F.col("name").alias("derivation")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("study_id", "derivation", F.lit("entry.name_unique").alias("property_id"))
    )
    return rowwise.unionByName(twice)


def _conditions_json(conditions: Column) -> Column:
    """Conditions with alphabetical fields and explicit nulls."""
    return F.transform(conditions, lambda c: F.struct(
        c["column"].alias("column"), c["op"].alias("op"), c["value"].alias("value")))


def canonical_body() -> Column:
    """Normalised body of a `parsed` row: defaults filled, numbers typed, fields alphabetical."""
    b = F.col("_b")

    def default(name: str, value: str) -> Column:
        return F.coalesce(b[name], F.lit(value)).alias(name)

    forms = {
        "bin": F.struct(
            F.transform(b["edges"], lambda e: e.try_cast("double")).alias("edges"), b["labels"].alias("labels"),
            default("null_handling", "null"), b["null_label"].alias("null_label")),
        "flag": F.struct(
            sorted_map(b["map"]).alias("map"), default("null_handling", "null"), b["null_value"].alias("null_value"),
            default("unmapped_handling", "null"), b["unmapped_value"].alias("unmapped_value")),
        "duration": F.struct(
            b["end_column"].alias("end_column"), default("null_handling", "null"),
            b["start_column"].alias("start_column"), default("unit", "days")),
        "compound": F.struct(
            default("combinator", "and"), _conditions_json(b["conditions"]).alias("conditions"),
            default("false_value", "N"), default("null_handling", "false"), default("true_value", "Y")),
        "risk_score": F.struct(
            b["fallback_label"].alias("fallback_label"), default("null_handling", "fallback"),
            F.transform(b["tiers"], lambda t: F.struct(
                F.coalesce(t["combinator"], F.lit("and")).alias("combinator"),
                _conditions_json(t["conditions"]).alias("conditions"), t["label"].alias("label"))).alias("tiers")),
    }
    text = F
    for kind, form in forms.items():
        text = text.when(F.col("rule_kind") == kind, canonical_json(form))
    return text.otherwise(F.lit(None).cast("string"))


def normalise(entries: DataFrame) -> DataFrame:
    """Entries with outcome (match / no_match), reason, canonical body and its signature."""
    known = F.coalesce(F.col("rule_kind").isin(known_rule_kinds()), F.lit(False))
    rows = parsed(entries).withColumn(
        "reason", F.when(~known, F.lit("entry.kind_unknown")).otherwise(summary(problems())))
    rows = rows.withColumn("outcome", F.when(F.col("reason") == "", F.lit("match")).otherwise(F.lit("no_match")))
    rows = rows.withColumn("body", F.when(F.col("outcome") == "match", canonical_body()))
    return rows.withColumn("body_signature", digest(F.col("body"))).drop("_b", "_keys")


def merged_body(body: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects; fields of the patch win, an explicit null included."""
    empty = F.lit("{}")
    both = F.map_zip_with(
        F.from_json(F.coalesce(body, empty), "map<string,variant>"),
        F.from_json(F.coalesce(patch, empty), "map<string,variant>"),
        lambda k, old, new: F.coalesce(new, old),
    )
    keys = F.array_sort(F.map_keys(both))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: both[k])), {"ignoreNullFields": "false"})


def patch_entries(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply decisions (study_id, name, body_patch JSON), at most one per entry, to a library."""
    joined = entries.join(patches.select("study_id", "name", "body_patch"), ["study_id", "name"], "left")
    empty = F.col("body_patch").isNull() | F.col("body_patch").isin("", "{}")
    return joined.withColumn(
        "rule_body", F.when(empty, F.col("rule_body")).otherwise(merged_body(F.col("rule_body"), F.col("body_patch")))
    ).select(*entries.columns)


def suggest_fixes(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Revised body per entry with findings (study_id, name, property_id), or escalation with a reason.

    A property can contribute only the few fields of FIXES, so the per-entry set stays tiny however many
    findings an entry has; it is combined before the shuffle.
    """
    fields = sorted({f for _, _, f, _ in FIXES})
    hits = findings.join(entries, ["study_id", "name"])
    applies = {f: F.bool_or(_matches([(k, p) for k, p, g, _ in FIXES if g == f])) for f in fields}
    value = {f: next(v for _, _, g, v in FIXES if g == f) for f in fields}
    grouped = hits.groupBy("study_id", "name").agg(*[c.alias(f"_fix_{f}") for f, c in applies.items()])
    patch = F.to_json(F.struct(*[F.when(F.col(f"_fix_{f}"), F.lit(value[f])).alias(f) for f in fields]))
    patched = entries.join(grouped, ["study_id", "name"]).withColumn("patch", patch)
    patched = patched.withColumn("revised_body", merged_body(F.col("rule_body"), F.col("patch")))
    checked = parsed(patched.withColumn("rule_body", F.col("revised_body"))).withColumn(
        "_wrong", summary(problems()))
    none = F.col("patch") == "{}"
    reason = (
        F.when(none, F.lit("no fix matches the findings"))
        .when(F.col("_wrong") != "", F.concat(F.lit("patched body did not validate: "), F.col("_wrong")))
        .otherwise(F.lit("applied fixes"))
    )
    escalate = none | (F.col("_wrong") != "")
    return checked.select(
        "study_id", "name", "rule_kind", "patch", F.when(~escalate, F.col("revised_body")).alias("revised_body"),
        escalate.alias("escalate"), reason.alias("reason"))


def _matches(rules: list[tuple[str, str]]) -> Column:
    found = F.lit(False)
    for kind, prop in rules:
        found = found | ((F.col("rule_kind") == kind) & (F.col("property_id") == prop))
    return found


# ---------------------------------------------------------------- probe batches

PROBES = 100


def numeric_batch(rule_id: Column, edges: Column, seed: int = 1) -> Column:
    """Probe values of a bucket rule: edges, edges +- 1e-9, then uniform values up to PROBES.

    The fill is drawn from a hash of rule, position and seed, so it does not depend on partitioning.
    """
    near = F.concat(edges, F.flatten(F.transform(edges, lambda x: F.array(x - 1e-9, x + 1e-9))))
    lo, hi = F.array_min(edges) - 5.0, F.array_max(edges) + 5.0
    unit = (lambda i: F.pmod(F.xxhash64(rule_id, i, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    open_places = F.slice(
        F.sequence(F.lit(1), F.lit(PROBES)), F.lit(1), F.greatest(F.lit(PROBES) - F.size(near), F.lit(0)))
    return F.concat(near, F.transform(open_places, lambda i: lo + unit(i) * (hi - lo)))


def categorical_batch(mapping: Column, unmapped: int = 10, nulls: int = 3) -> Column:
    """Probe values of a map rule: declared keys, strings that are not keys, and nulls."""
    keys = F.map_keys(mapping)
    invented = F.transform(
        F.sequence(F.lit(1), F.size(keys) + unmapped), lambda i: F.format_string("__unmapped_%07d__", i))
    fresh = F.slice(F.array_except(invented, keys), 1, unmapped)
    return F.concat(keys, fresh, F.array_repeat(F.lit(None).cast("string"), nulls))


def numeric_probes(rules: DataFrame, seed: int = 1) -> DataFrame:
    """One row per rule (rule_id, edges, ...) and probe value."""
    return rules.select("*", F.posexplode(numeric_batch(F.col("rule_id"), F.col("edges"), seed)).alias("probe_no", "value"))


def categorical_probes(rules: DataFrame) -> DataFrame:
    """One row per rule (rule_id, map, ...) and probe value."""
    return rules.select("*", F.posexplode(categorical_batch(F.col("map"))).alias("probe_no", "value"))


def bucket_of(value: Column, edges: Column, labels: Column) -> Column:
    """Bucket label by rule columns instead of literals, for tables of rules."""
    return F.when(~(value.isNull() | F.isnan(value)) & (value < F.lit(float("inf"))),
                  F.get(labels, F.size(F.filter(edges, lambda e: e <= value))))
