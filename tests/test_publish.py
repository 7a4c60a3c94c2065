"""One pass that derives, checks and writes; what fails is not seen."""

import os

import pytest
from pyspark.sql import functions as F

from rulefold.functions.dates import decide
from rulefold.operators.rules import RULE_KINDS, Check, register_rule_kind
from rulefold.plans.apply import apply_spec
from rulefold.plans.bodies import BinBody
from rulefold.plans.publish import NotPublished, publish
from rulefold.plans.spec import Spec

ENTRIES = [
    {"name": "BAND", "inputs": ["x"], "rule_kind": "bin", "rule_body": {"edges": [10], "labels": ["lo", "hi"], "null_handling": "null"}},
    {"name": "KIND", "inputs": ["k"], "rule_kind": "flag", "rule_body": {"map": {"a": "A", "b": "B"}, "null_handling": "null", "unmapped_handling": "null"}},
    {"name": "DAYS", "inputs": ["d1", "d2"], "rule_kind": "duration", "rule_body": {"start_column": "d1", "end_column": "d2"}},
    {"name": "BOTH", "inputs": ["BAND"], "rule_kind": "compound", "rule_body": {"conditions": [{"column": "BAND", "op": "==", "value": "hi"}, {"column": "DAYS", "op": ">", "value": 3}]}},
]


@pytest.fixture
def rows(spark):
    shape = "id bigint, x double, k string, d1 date, d2 date"
    return spark.createDataFrame([(i, float(i), "abc"[i % 3] if i % 7 else None, None, None) for i in range(40)], shape).withColumns(
        {"d1": F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "d2": F.date_add(F.lit("2024-02-01").cast("date"), (F.col("id") * 2).cast("int"))})


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup(f"publish-{os.urandom(4).hex()}", "")
    group = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    try:
        result = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_one_pass_derives_checks_and_writes(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/in")
    source, path = spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out"
    scanned = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    result = publish(source.mapInArrow(counted, source.schema), Spec.from_entries(ENTRIES), path, key="id")
    assert scanned.value == 40  # every row was read once, for all levels, checks and the write
    assert result.published and result.rows_read == result.rows_written == 40 and not result.failed
    out = spark.read.parquet(path)
    want = apply_spec(source, Spec.from_entries(ENTRIES)).df
    assert sorted(map(tuple, out.drop("lineage_id").collect())) == sorted(map(tuple, want.collect()))
    assert [c for c in out.columns if c.startswith("__")] == [] and out.where("lineage_id IS NULL").isEmpty()
    assert result.checks.checks.where("property_id = 'L1.row_count_preserved' AND n_violations = 0").count() == 4
    assert {f for f in os.listdir(tmp_path) if not f.startswith(".")} == {"in", "out"}
    with pytest.raises(FileExistsError):
        publish(source, Spec.from_entries(ENTRIES), path)


def test_nothing_is_seen_of_what_fails(spark, rows, tmp_path):
    strict = Spec.from_entries([e if e["name"] != "KIND" else e | {"rule_body": {"map": {"a": "A"}, "null_handling": "error", "unmapped_handling": "error"}} for e in ENTRIES])
    with pytest.raises(NotPublished, match="KIND") as error:
        publish(rows, strict, f"{tmp_path}/out")
    missing = rows.where("k IS NULL").count()
    assert error.value.result.blocked["KIND"].by_policy == {"null": missing, "unmapped": rows.where("k <> 'a'").count()}
    build = RULE_KINDS["bin"].build

    def failing(scope, source, body):
        rule = build(scope, source, body)
        rule.checks.append(Check("P-odd", "odd ids are not allowed", lambda out: F.col("id") % 2 == 1))
        return rule

    register_rule_kind("failing", BinBody, failing)
    try:
        spec = Spec.from_entries([ENTRIES[0] | {"rule_kind": "failing"}, *ENTRIES[1:]])
        result = publish(rows, spec, f"{tmp_path}/out", raise_on_failure=False, sample=True)
    finally:
        del RULE_KINDS["failing"]
    assert not result.published and result.failed == {"BAND"}
    found = result.checks.findings.collect()
    assert [(r["property_id"], r["n_violations"]) for r in found] == [("P-odd", 20)] and found[0]["sample"]
    assert os.listdir(tmp_path) == []


def test_an_empty_table_is_published(spark, rows, tmp_path):
    result = publish(rows.where("1 = 0"), Spec.from_entries(ENTRIES), f"{tmp_path}/out", partition_by=["BAND"])
    assert result.published and result.rows_written == 0
    assert spark.read.schema("id bigint").parquet(f"{tmp_path}/out").count() == 0


DURATIONS = [
    {"name": f"D{i}{u[0]}", "inputs": [a, b], "rule_kind": "duration", "rule_body": {"start_column": a, "end_column": b, "unit": u}}
    for i, (a, b) in enumerate([("t1", "t2"), ("s1", "s2"), ("s1", "t2"), ("m1", "s2"), ("m1", "t1")]) for u in ("days", "weeks")]


@pytest.fixture
def dated(spark):
    cells = [(f"2024-03-{d:02}", f"{1 + d // 20}/{d}/2024", f"2024-03-{d:02} 00:00:00") for d in range(1, 29)]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "id int, s1 string, m1 string, t string").select(
        "id", "s1", F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.date_format(F.date_add("s1", F.lit(14)), "yyyy-MM-dd")).alias("s2"), "m1",
        F.col("t").cast("timestamp").alias("t1"), F.expr("CAST(t AS timestamp) + make_dt_interval(7, 0, 0, if(id = 3, 0.5, 0))").alias("t2"))


def test_formats_and_types_take_one_pass(spark, dated):
    spec = Spec.from_entries(DURATIONS + [{"name": "LONG", "inputs": ["D1d"], "rule_kind": "compound", "rule_body": {"conditions": [{"column": "D1d", "op": ">", "value": 3}]}}])
    done, jobs = jobs_of(spark, lambda: apply_spec(dated, spec))
    assert jobs <= 2  # an aggregate and its shuffle, whatever the number of levels
    kinds = dict(done.df.dtypes)
    assert {n: kinds[n] for n in ("D0d", "D1d", "D1w", "D2d", "D3d", "D4d")} == {
        "D0d": "double", "D1d": "bigint", "D1w": "bigint", "D2d": "double", "D3d": "bigint", "D4d": "bigint"}
    assert kinds["D3w"] == "double"
    by_hand = {n: done.df.where(f"{n} <> floor({n})").isEmpty() for n in kinds if n[0] == "D" and n[1:2].isdigit()}
    assert {n: k == "bigint" for n, k in kinds.items() if n in by_hand} == by_hand
    assert done.df.where("id = 4").first()["D1w"] == 2 and done.df.where("id = 9").first()["D1d"] is None


def test_month_or_day_first_is_decided_with_the_format(spark):
    day = spark.createDataFrame([("13/1/2024", "2024-01-14"), ("2/1/2024", "2024-01-09"), ("20/2/2024", None)], "a string, b string")
    formats, whole = decide(day, ["a", "b"], {}, [("a", "b", 1), ("a", "b", 7)])
    assert formats == {"a": "d/M/yyyy", "b": "yyyy-MM-dd"} and whole == {("a", "b", 1): True, ("a", "b", 7): False}
    month = spark.createDataFrame([("2/1/2024", "2024-02-15"), ("1/25/2024", "2024-02-08")], "a string, b string")
    formats, whole = decide(month, ["a", "b"], {}, [("a", "b", 7)])
    assert formats["a"] == "M/d/yyyy" and whole == {("a", "b", 7): True}
    times = spark.createDataFrame([("2024-01-01", "2024-02-15 00:00:00"), ("2024-01-02", "2024-02-15 00:00:00"), ("2024-01-02", None)], "a string, b string")
    assert decide(times, ["a", "b"], {}, [("a", "b", 1)])[1] == {("a", "b", 1): True}
    assert decide(times.withColumn("b", F.replace("b", F.lit("00:00:00"), F.lit("00:00:07"))), ["a", "b"], {}, [("a", "b", 1)])[1] == {("a", "b", 1): False}
    nothing = decide(month.where("1 = 0"), ["a"], {"b": "yyyy-MM-dd"}, [("a", "b", 7)])
    assert nothing[1] == {("a", "b", 7): False} and decide(month, [], {}, []) == ({}, {})
