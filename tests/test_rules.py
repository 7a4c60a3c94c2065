"""The five rule kinds on tiny tables."""

import pytest
from pyspark.sql import functions as F

from rulefold.plans.apply import apply_rule, apply_spec
from rulefold.plans.errors import DatasetError, NullInputError, SpecError, UnmappedInputError
from rulefold.plans.spec import Spec, dependency_levels, execution_order

AGE = {"edges": [18, 65], "labels": ["minor", "adult", "senior"]}
NAN = float("nan")


def out(df, name="t"):
    return [r[name] for r in df.orderBy("id").collect()]


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x double")


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x string")


@pytest.mark.parametrize("values, expected", [
    ([17.9999, 18.0, 18.0001], ["minor", "adult", "adult"]),
    ([64.9999, 65.0, 65.0001], ["adult", "senior", "senior"]),
    ([float("inf"), float("-inf"), NAN, None], [None, "minor", None, None]),
])
def test_bin_edges(spark, values, expected):
    assert out(apply_rule(numbers(spark, values), "t", "bin", AGE, "x")) == expected


def test_bin_single_edge(spark):
    body = {"edges": [0], "labels": ["neg", "non_neg"]}
    got = out(apply_rule(numbers(spark, [-2.5, -0.0001, 0.0, 0.0001, 100.0]), "t", "bin", body, "x"))
    assert got == ["neg", "neg", "non_neg", "non_neg", "non_neg"]


def test_bin_null_modes(spark):
    df = numbers(spark, [10.0, NAN, 70.0])
    label = {**AGE, "null_handling": "label", "null_label": "unknown_age"}
    assert out(apply_rule(df, "t", "bin", label, "x")) == ["minor", "unknown_age", "senior"]
    with pytest.raises(NullInputError, match="1 of 3 rows are null"):
        apply_rule(df, "t", "bin", {**AGE, "null_handling": "error"}, "x")
    assert out(apply_rule(numbers(spark, [10.0]), "t", "bin", {**AGE, "null_handling": "error"}, "x")) == ["minor"]


def test_bin_label_mode_leaves_infinity_null(spark):
    label = {**AGE, "null_handling": "label", "null_label": "none"}
    assert out(apply_rule(numbers(spark, [float("inf"), None]), "t", "bin", label, "x")) == [None, "none"]


def test_bin_missing_column_empty_input_overwrite_and_types(spark):
    df = numbers(spark, [10.0, 70.0])
    with pytest.raises(DatasetError, match="available"):
        apply_rule(df, "t", "bin", AGE, "nope")
    empty = apply_rule(df.where("false"), "t", "bin", AGE, "x")
    assert empty.columns == ["id", "x", "t"] and empty.count() == 0
    again = apply_rule(df.selectExpr("*", "'old' as t"), "t", "bin", AGE, "x")
    assert again.columns == ["id", "x", "t"] and out(again) == ["minor", "senior"]
    assert out(apply_rule(df, "x", "bin", AGE, "x"), "x") == ["minor", "senior"]
    with pytest.raises(SpecError, match="numeric"):
        apply_rule(texts(spark, ["a"]), "t", "bin", AGE, "x")
    flags = spark.createDataFrame([(0, True), (1, False)], "id int, x boolean")
    assert out(apply_rule(flags, "t", "bin", {"edges": [1], "labels": ["no", "yes"]}, "x")) == ["yes", "no"]


RESPONSE = {"map": {"responder": "Y", "non_responder": "N"}}


@pytest.mark.parametrize("extra, values, expected", [
    ({}, ["responder", "non_responder", "responder"], ["Y", "N", "Y"]),
    ({"null_handling": "value", "null_value": "MISSING"}, ["responder", None], ["Y", "MISSING"]),
    ({"unmapped_handling": "value", "unmapped_value": "U"}, ["responder", "unknown"], ["Y", "U"]),
    ({}, ["unknown", None], [None, None]),
])
def test_flag_policies(spark, extra, values, expected):
    assert out(apply_rule(texts(spark, values), "t", "flag", {**RESPONSE, **extra}, "x")) == expected


def test_flag_errors(spark):
    df = texts(spark, ["responder", "unknown", "later"])
    with pytest.raises(UnmappedInputError, match=r"\['later', 'unknown'\]"):
        apply_rule(df, "t", "flag", {**RESPONSE, "unmapped_handling": "error"}, "x")
    with pytest.raises(NullInputError, match="1 of 2 rows"):
        apply_rule(texts(spark, ["responder", None]), "t", "flag", {**RESPONSE, "null_handling": "error"}, "x")


def test_flag_key_text_and_large_map(spark):
    ints = spark.createDataFrame([(0, 1), (1, 2)], "id int, x bigint")
    assert out(apply_rule(ints, "t", "flag", {"map": {"1": "one"}}, "x")) == ["one", None]
    assert out(apply_rule(numbers(spark, [18.0]), "t", "flag", {"map": {"18.0": "e"}}, "x")) == ["e"]
    flags = spark.createDataFrame([(0, True), (1, False)], "id int, x boolean")
    assert out(apply_rule(flags, "t", "flag", {"map": {"True": "Y", "False": "N"}}, "x")) == ["Y", "N"]
    big = {"map": {f"k{i}": f"v{i}" for i in range(500)}, "unmapped_handling": "value", "unmapped_value": "U",
           "null_handling": "value", "null_value": "M"}
    assert out(apply_rule(texts(spark, ["k7", "k499", "z", None]), "t", "flag", big, "x")) == ["v7", "v499", "U", "M"]


def test_large_map_is_verified_too(spark):
    from rulefold.operators.verify import coverage, verify

    big = {"map": {f"k{i}": f"v{i}" for i in range(500)}, "unmapped_handling": "value", "unmapped_value": "U"}
    spec = Spec.from_entries([entry("T", ["x"], "flag", big)])
    done = apply_spec(texts(spark, ["k7", "z", None, "k8"]), spec)
    assert done.df.columns == ["id", "x", "T"]
    assert verify(done.df, done.rules, done.bodies).findings.isEmpty()
    changed = done.df.withColumn("T", F.when(F.col("x") == "k8", F.lit("v7")).otherwise(F.col("T")))
    assert [r["property_id"] for r in verify(changed, done.rules).findings.collect()] == ["P-flag-1"]
    parts = {r["partition"]: r["n_rows"] for r in coverage(done.df, done.rules).collect()}
    assert parts == {"declared": 2, "unmapped": 1, "null": 1}


def days(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")


def test_duration_units_types_and_formats(spark):
    df = days(spark, [("2025-01-15", "2025-03-15"), ("2025-03-15", "2025-01-15"), ("bad", "2025-01-01"), (None, None)])
    body = {"start_column": "a", "end_column": "b"}
    whole = apply_rule(df, "t", "duration", body)
    assert whole.schema["t"].dataType.simpleString() == "bigint"
    assert out(whole) == [59, -59, None, None]
    weeks = apply_rule(df, "t", "duration", {**body, "unit": "weeks"})
    assert weeks.schema["t"].dataType.simpleString() == "double"
    assert out(weeks)[0] == pytest.approx(59 / 7)
    assert out(apply_rule(df, "t", "duration", {**body, "unit": "years"}))[0] == pytest.approx(59 / 365)
    us = days(spark, [("1/15/2025", "3/15/2025"), ("1/16/2025", "3/16/2025"), ("2025-01-01", "3/16/2025")])
    assert out(apply_rule(us, "t", "duration", body)) == [59, 59, None]
    with pytest.raises(NullInputError, match="2 of 4"):
        apply_rule(df, "t", "duration", {**body, "null_handling": "error"})
    with pytest.raises(SpecError):
        apply_rule(numbers(spark, [1.0]), "t", "duration", {"start_column": "x", "end_column": "id"})


def test_duration_of_timestamps_keeps_fractions(spark):
    df = spark.sql("select 0 id, timestamp_ntz'2025-01-01 00:00:00' a, timestamp_ntz'2025-01-02 12:00:00' b")
    assert out(apply_rule(df, "t", "duration", {"start_column": "a", "end_column": "b"})) == [1.5]


def cond(column, op, value=None):
    return {"column": column, "op": op, "value": value} if value is not None else {"column": column, "op": op}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(0, 70, "81.5", "yes"), (1, 70, "pending", "no"), (2, 30, None, None), (3, None, "12", "yes")]
    return spark.createDataFrame(rows, "id int, age bigint, lab string, ok string")


@pytest.mark.parametrize("conditions, comb, policy, expected", [
    ([cond("age", ">=", 65), cond("lab", ">=", 60)], "and", "null", ["Y", None, "N", "N"]),
    ([cond("age", ">=", 65), cond("lab", ">=", 60)], "or", "null", ["Y", "Y", None, None]),
    ([cond("age", ">=", 65), cond("lab", ">=", 60)], "or", "true", ["Y", "Y", "Y", "Y"]),
    ([cond("age", ">=", 65), cond("lab", ">=", 60)], "or", "false", ["Y", "Y", "N", "N"]),
    ([cond("lab", "is_null")], "and", "null", ["N", "N", "Y", "N"]),
    ([cond("lab", "not_null"), cond("ok", "==", "yes")], "and", "null", ["Y", "N", "N", "Y"]),
    ([cond("ok", "!=", "yes")], "and", "null", ["N", "Y", None, "N"]),
    ([cond("ok", "in", ["no", "maybe"])], "and", "null", ["N", "Y", None, "N"]),
    ([cond("age", "in", [30, 31])], "and", "null", ["N", "N", "Y", None]),
    ([cond("age", "in", ["30"])], "and", "null", ["N", "N", "N", None]),
    ([cond("age", "==", "70")], "and", "null", ["N", "N", "N", None]),
    ([cond("age", "!=", "70")], "and", "null", ["Y", "Y", "Y", None]),
    ([cond("age", "==", 70.0)], "and", "null", ["Y", "Y", "N", None]),
    ([cond("lab", "==", 12)], "and", "null", ["N", "N", None, "Y"]),
])
def test_compound(mixed, conditions, comb, policy, expected):
    body = {"conditions": conditions, "combinator": comb, "null_handling": policy}
    assert out(apply_rule(mixed, "t", "compound", body)) == expected


def test_compound_error(mixed):
    with pytest.raises(NullInputError, match="1 of 4"):
        apply_rule(mixed, "t", "compound", {"conditions": [cond("age", ">", 1)], "null_handling": "error"})


LADDER = {
    "tiers": [
        {"label": "high", "combinator": "and", "conditions": [cond("age", ">=", 65), cond("lab", ">=", 60)]},
        {"label": "medium", "combinator": "or", "conditions": [cond("lab", ">=", 60), cond("age", ">=", 65)]},
    ],
    "fallback_label": "low",
}


def test_risk_score(spark, mixed):
    assert out(apply_rule(mixed, "t", "risk_score", LADDER)) == ["high", "medium", "low", "low"]
    rows = spark.createDataFrame([(0, None, None), (1, 30, None), (2, None, "1")], "id int, age bigint, lab string")
    assert out(apply_rule(rows, "t", "risk_score", {**LADDER, "null_handling": "null"})) == [None, "low", "low"]
    assert out(apply_rule(rows, "t", "risk_score", LADDER)) == ["low", "low", "low"]
    with pytest.raises(NullInputError, match="1 of 3"):
        apply_rule(rows, "t", "risk_score", {**LADDER, "null_handling": "error"})


@pytest.mark.parametrize("kind, body", [
    ("bin", {"edges": [2, 1], "labels": ["a", "b", "c"]}),
    ("bin", {"edges": [1, 1], "labels": ["a", "b", "c"]}),
    ("bin", {"edges": [1], "labels": ["a", "a"]}),
    ("bin", {"edges": [1], "labels": ["a"]}),
    ("bin", {"edges": [], "labels": ["a"]}),
    ("bin", {"edges": [1], "labels": ["a", "b"], "null_handling": "label"}),
    ("bin", {"edges": [1], "labels": ["a", "b"], "null_label": "x"}),
    ("bin", {"edges": [1], "labels": ["a", "b"], "closed": "left"}),
    ("bin", {"labels": ["a", "b"]}),
    ("flag", {"map": {}}),
    ("flag", {"map": {"a": 1}}),
    ("flag", {"map": {"a": "b"}, "null_handling": "value"}),
    ("flag", {"map": {"a": "b"}, "unmapped_value": "U"}),
    ("duration", {"start_column": "a", "end_column": "a"}),
    ("duration", {"start_column": "a", "end_column": "b", "unit": "hours"}),
    ("compound", {"conditions": []}),
    ("compound", {"conditions": [{"column": "a", "op": "is_null", "value": 1}]}),
    ("compound", {"conditions": [{"column": "a", "op": "in", "value": "x"}]}),
    ("compound", {"conditions": [{"column": "a", "op": ">="}]}),
    ("risk_score", {"tiers": [], "fallback_label": "low"}),
    ("risk_score", {"tiers": [LADDER["tiers"][0]] * 2, "fallback_label": "low"}),
])
def test_bad_bodies(kind, body):
    from rulefold.operators.rules import rule_kind

    with pytest.raises(SpecError):
        rule_kind(kind).body.parse(body)


def entry(name, inputs, kind, body, **more):
    return {"name": name, "inputs": inputs, "rule_kind": kind, "rule_body": body, **more}


def test_spec_checks(spark):
    spec = Spec.from_entries([
        entry("AA", ["x"], "compound", {"conditions": [cond("ZZ", "not_null")]}), entry("ZZ", ["x"], "bin", AGE)])
    assert execution_order(spec, ["x"]) == ["ZZ", "AA"]
    assert dependency_levels(spec, ["x"]) == [["ZZ"], ["AA"]]
    cycle = Spec.from_entries([entry("A", ["B"], "bin", AGE), entry("B", ["A"], "bin", AGE)])
    with pytest.raises(SpecError, match="cycle"):
        dependency_levels(cycle, ["x"])
    with pytest.raises(DatasetError, match="nope"):
        apply_spec(numbers(spark, [1.0]), Spec.from_entries([entry("A", ["nope"], "bin", AGE)]))
    with pytest.raises(SpecError, match="overwrite"):
        apply_spec(numbers(spark, [1.0]), Spec.from_entries([entry("x", ["id"], "bin", AGE)]))
    with pytest.raises(SpecError, match="duplicate"):
        Spec.from_entries([entry("A", ["x"], "bin", AGE)] * 2)
    with pytest.raises(SpecError, match="unknown rule kind"):
        Spec.from_entries([entry("A", ["x"], "bucket", AGE)])


def test_skip_cascade(spark):
    spec = Spec.from_entries([
        entry("F", ["x"], "flag", {}), entry("D", ["F"], "flag", {"map": {"a": "b"}}), entry("OK", ["x"], "bin", AGE)])
    done = apply_spec(numbers(spark, [1.0]), spec, on_error="skip")
    assert done.df.columns == ["id", "x", "OK"]
    assert {n: o.status for n, o in done.outcomes.items()} == {"F": "unresolved", "D": "skipped", "OK": "verified"}


def test_error_policy_skips_in_skip_mode(spark):
    spec = Spec.from_entries([
        entry("B", ["x"], "bin", {**AGE, "null_handling": "error"}), entry("C", ["B"], "flag", {"map": {"minor": "m"}}),
        entry("OK", ["x"], "bin", AGE)])
    done = apply_spec(numbers(spark, [1.0, None]), spec, on_error="skip")
    assert done.df.columns == ["id", "x", "OK"]
    assert "1 of 2 rows are null" in done.outcomes["B"].reason


def test_error_policy_while_overwriting_the_source(spark):
    strict = {**AGE, "null_handling": "error"}
    with pytest.raises(NullInputError, match="1 of 2"):
        apply_rule(numbers(spark, [1.0, NAN]), "x", "bin", strict, "x")
    done = apply_rule(numbers(spark, [1.0, 70.0]), "x", "bin", strict, "x")
    assert done.columns == ["id", "x"] and out(done, "x") == ["minor", "senior"]
    big = {"map": {f"k{i}": f"v{i}" for i in range(200)}, "unmapped_handling": "error"}
    with pytest.raises(UnmappedInputError, match="zz"):
        apply_rule(texts(spark, ["k1", "zz"]), "x", "flag", big, "x")
    assert out(apply_rule(texts(spark, ["k1", None]), "x", "flag", big, "x"), "x") == ["v1", None]


def test_explain(spark):
    df = apply_rule(numbers(spark, [18.0, NAN]), "t", "bin", AGE, "x", explain=True)
    assert out(df, "t__why") == ["18.0 is 18.0 to under 65.0: adult", "missing value: null handling"]
