"""Readers, profiles, labels, libraries, memory, review and audit on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from rulefold.functions import labels as lb
from rulefold.functions.signatures import signature_of
from rulefold.operators import audit as au
from rulefold.operators import library as lib
from rulefold.operators import memory as mem
from rulefold.operators import review as rv
from rulefold.operators.profile import profile, redacted
from rulefold.operators.propose import propose
from rulefold.operators.triage import suggest_kinds, suggest_terms
from rulefold.sources.delimited import read_delimited
from rulefold.sources.records import TICKETS, read_decisions, scan_records, write_result


def test_narrowing(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'i,f,b,s,d,e,big\n1,1.5,True,x,2024-01-01,,99999999999999999999\nNA,2,false,"a,""b""",2024-01-02,null,1\n')
    df = read_delimited(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "e": "string",
                               "big": "double"}
    assert [tuple(r)[:5] for r in df.orderBy("f").collect()] == [
        (1, 1.5, True, "x", "2024-01-01"), (None, 2.0, False, 'a,"b"', "2024-01-02")]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin-1", "cp1252"])
def test_encodings_and_header_row(spark, tmp_path, encoding):
    text = "remark é\nsecond\nname;n\nzoé;1\nbob;2\n"
    (tmp_path / "x.csv").write_bytes(text.encode(encoding))
    df = read_delimited(spark, str(tmp_path / "x.csv"), sep=";", header_row=2, encoding=encoding)
    assert sorted(map(tuple, df.collect())) == [("bob", 2), ("zoé", 1)]


def test_cp1252_only_characters(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("name,n\n€uro “q”,1\n".encode("cp1252"))
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "x.csv"), encoding="cp1252").collect()] == [("€uro “q”", 1)]


def test_header_row_in_every_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(f"made by {i}\nk,v\n{i},a\n{i},b\n")
    df = read_delimited(spark, str(tmp_path), header_row=1)
    assert df.count() == 6 and df.where("k is null").count() == 0


def test_tsv_by_name(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n1\tq\n")
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "x.tsv")).collect()] == [(1, "q")]


def test_sink_formats(spark, tmp_path):
    df = spark.range(3)
    write_result(df, str(tmp_path / "p"))
    write_result(df, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert read_delimited(spark, str(tmp_path / "c")).count() == 3
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "x"), "xlsx")


def test_quarantine_split(spark, tmp_path):
    from rulefold.operators.policy import accepted, diverted, quarantine
    from rulefold.sources.records import write_split

    df = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    marked = quarantine(df, {"T": {"null": F.col("v").isNull()}})
    write_split(marked, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert [(r["id"], r["_violations"]) for r in back.where("not accepted").collect()] == [(1, ["T:null"])]
    assert [r["id"] for r in accepted(marked).collect()] == [2] and [r["id"] for r in diverted(marked).collect()] == [1]


def test_ticket_documents(spark, tmp_path):
    for run in ("run-a", "run-b"):
        inbox = tmp_path / run / "hitl" / "inbox"
        inbox.mkdir(parents=True)
        (inbox / "evt-1.ticket.json").write_text(json.dumps(
            {"event_id": f"evt-{run}", "ticket_kind": "ambiguity", "target": "T", "options_offered": ["a"],
             "context": {"x": "y"}}, indent=2))
    rows = scan_records(spark, str(tmp_path / "run-*" / "hitl" / "inbox" / "*.ticket.json"), TICKETS).collect()
    assert sorted((r["run_id"], r["event_id"]) for r in rows) == [("run-a", "evt-run-a"), ("run-b", "evt-run-b")]


def test_decisions_document_last_wins(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([
        {"ticket_kind": "ambiguity", "target": "A", "chosen_option": "first"},
        {"ticket_kind": "ambiguity", "target": "A", "chosen_option": "second", "body_patch": {"x": 1}}], indent=1))
    tickets = spark.createDataFrame([("e1", "ambiguity", "A"), ("e2", "ambiguity", "B")], "event_id string, ticket_kind string, target string")
    got = {r["event_id"]: r for r in rv.replay(tickets, read_decisions(spark, str(tmp_path / "d.json")), "position").collect()}
    assert got["e1"]["chosen_option"] == "second" and json.loads(got["e1"]["body_patch"]) == {"x": 1}
    assert got["e1"]["resolved_by"] == "auto-replay" and not got["e2"]["resolved"]


def test_profile_and_proposals(spark):
    rows = [(i, 10 + i % 70, "F" if i % 2 else "M", ["responder", "non_responder", "unknown"][i % 3], float(i), "1/2/2025",
             f"{1 + i % 12}/15/2025", f"note {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, age int, sex string, response string, lab_value double, start_date string, "
                                     "visit_date string, notes string")
    prof = profile(df, "d")
    kinds = {r["column"]: r["kind"] for r in prof.collect()}
    assert kinds == {"id": "numeric", "age": "numeric", "sex": "low_cardinality", "response": "low_cardinality",
                     "lab_value": "numeric", "start_date": "date", "visit_date": "date", "notes": "high_cardinality"}
    got = {r["name"]: r for r in propose(prof).collect()}
    assert [n for n, r in sorted(got.items(), key=lambda x: x[1]["place"])] == [
        "AGE_GROUP", "SEX_FLAG", "RESPONSE_FLAG", "TREATMENT_DURATION", "ANALYSIS_POP_FLAG", "RISK_GROUP"]
    assert json.loads(got["RESPONSE_FLAG"]["rule_body"])["map"] == {"responder": "Y", "non_responder": "N", "unknown": "U"}
    assert json.loads(got["SEX_FLAG"]["rule_body"])["map"] == {"F": "F", "M": "M"}
    assert json.loads(got["TREATMENT_DURATION"]["rule_body"])["start_column"] == "start_date"
    tiers = json.loads(got["RISK_GROUP"]["rule_body"])["tiers"]
    assert [c["value"] for c in tiers[0]["conditions"]] == [65.0, 74.0]
    assert redacted(prof).where("column = 'notes'").first()["values"] is None


@pytest.mark.parametrize("text, tz, expected", [
    ("2026-05-22T20:32:25.944584+00:00", "UTC", "May 22, 2026, 8:32 PM UTC"),
    ("2026-05-22T20:32:25Z", "America/Toronto", "May 22, 2026, 4:32 PM EDT"),
    ("2026-01-22T02:02:25+00:00", "America/Toronto", "January 21, 2026, 9:02 PM EST"),
    ("2026-05-22T00:05:00+05:30", "UTC", "May 21, 2026, 6:35 PM UTC"),
    ("2026-05-22T12:00:00+00:00", "Asia/Kolkata", "May 22, 2026, 5:30 PM IST"),
    ("soon", "UTC", "soon"), ("2026", "UTC", "2026"), (None, "UTC", None),
])
def test_timestamp_label(spark, text, tz, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(lb.timestamp_label(F.col("v"), tz)).first()[0] == expected


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_labels(spark):
    assert one(spark, lambda c: lb.run_label(c, "America/Toronto"), "run-20260522T203140Z-39f341") == "May 22, 2026 at 4:31 PM EDT (39f341)"
    assert one(spark, lb.run_label, "other") == "other"
    assert one(spark, lambda c: lb.label_of("event_type", c), "some_NEW_type") == "Some new type"
    assert one(spark, lambda c: lb.label_of("layer", c), "L7") == "L7"
    assert one(spark, lb.short_fingerprint, None) == "(none)"
    assert one(spark, lb.short_event_id, "evt-381f3b7a4dd6") == "381f3b7a"
    assert one(spark, lb.short_event_id, "evt-") == "evt-"
    assert one(spark, lb.resolution_summary, '{"chosen_option": "Other text"}') == "Other text"
    assert one(spark, lb.resolution_summary, '{"chosen_option": 5}') == '{"chosen_option": 5}'
    assert one(spark, lb.resolution_summary, "[1]") == "[1]"
    assert one(spark, lb.options_summary, '{"options": []}') == "(no options recorded)"
    assert one(spark, lb.options_summary, '["reject", "x"]') == "Reject the rule and do not produce this variable; x"
    assert lb.column_labels(["event_id", "hitl_event_id", "resolution_event_id", "my_col"]) == {
        "event_id": "Question ID", "hitl_event_id": "Question ID (hitl_event_id)",
        "resolution_event_id": "Question ID (resolution_event_id)", "my_col": "My col"}


ENTRY = "study_id string, name string, inputs array<string>, rule_kind string, rule_body string, rationale string, ambiguity_notes string"


def test_table_signature_equals_driver_signature(spark):
    bodies = [
        ("bin", {"edges": [18.0, 65.0], "labels": ["a", "b", "c"], "null_handling": "null", "null_label": None}),
        ("flag", {"map": {"b": "2", "a": "1"}, "null_handling": "null", "null_value": None, "unmapped_handling": "null",
                  "unmapped_value": None}),
        ("compound", {"conditions": [{"column": "x", "op": "in", "value": [1, "y"]}, {"column": "x", "op": "is_null", "value": None}],
                      "combinator": "or", "true_value": "Y", "false_value": "N", "null_handling": "false"}),
    ]
    rows = [("s", f"n{i}", ["x"], k, json.dumps(b), "", None) for i, (k, b) in enumerate(bodies)]
    got = {r["name"]: r for r in lib.normalise(spark.createDataFrame(rows, ENTRY)).collect()}
    for i, (_, b) in enumerate(bodies):
        assert got[f"n{i}"]["outcome"] == "match", got[f"n{i}"]
        assert got[f"n{i}"]["body_signature"] == signature_of(b), got[f"n{i}"]["body"]


def test_table_lint_agrees_with_typed_bodies(spark):
    from rulefold.operators.rules import rule_kind
    from rulefold.plans.errors import SpecError
    from tests.test_rules import LADDER

    cases = [
        ("bin", {"edges": [1, 2], "labels": ["a", "b", "c"]}), ("bin", {"edges": [2, 1], "labels": ["a", "b", "c"]}),
        ("bin", {"edges": ["1", "2.5"], "labels": ["a", "b", "c"]}), ("bin", {"edges": ["x"], "labels": ["a", "b"]}),
        ("bin", {"edges": [1], "labels": ["a", "b"], "null_handling": "label", "null_label": "c"}), ("bin", {}),
        ("bin", {"edges": [1], "labels": ["a", "b"], "null_handling": "odd"}), ("flag", {"map": {"a": "b"}}), ("flag", {}),
        ("flag", {"map": {"a": "b"}, "null_value": "x"}), ("duration", {"start_column": "a", "end_column": "b"}),
        ("duration", {"start_column": "a"}), ("duration", {"start_column": "a", "end_column": "b", "unit": "years", "x": 1}),
        ("compound", {"conditions": [{"column": "a", "op": ">", "value": "x"}]}),
        ("compound", {"conditions": [{"column": "a", "op": "==", "value": None}]}),
        ("compound", {"conditions": [{"column": "a", "op": "in", "value": []}], "combinator": "xor"}),
        ("compound", {"conditions": [{"column": "a", "op": "in", "value": ["b"]}]}), ("risk_score", LADDER),
        ("risk_score", {**LADDER, "fallback_label": ""}), ("risk_score", {**LADDER, "tiers": [{"label": "a", "conditions": []}]}),
    ]
    rows = [("s", f"n{i}", ["x"], k, json.dumps(b), "", None) for i, (k, b) in enumerate(cases)]
    got = {r["name"]: r["outcome"] for r in lib.normalise(spark.createDataFrame(rows, ENTRY)).collect()}
    for i, (k, b) in enumerate(cases):
        try:
            rule_kind(k).body.parse(b)
            expected = "match"
        except SpecError:
            expected = "no_match"
        assert got[f"n{i}"] == expected, (k, b)


def test_fixes(spark):
    rows = [("s", "F", ["x"], "flag", json.dumps({"map": {"a": "b"}, "unmapped_handling": "error"}), "", None),
            ("s", "B", ["x"], "bin", json.dumps({"edges": [1], "labels": ["a", "b"], "null_handling": "label", "null_label": "n"}), "", None)]
    findings = spark.createDataFrame([("s", "F", "P-flag-3"), ("s", "B", "P-bin-2")], "study_id string, name string, property_id string")
    got = {r["name"]: r for r in lib.suggest_fixes(spark.createDataFrame(rows, ENTRY), findings).collect()}
    assert json.loads(got["F"]["revised_body"])["unmapped_handling"] == "null" and not got["F"]["escalate"]
    assert got["B"]["escalate"] and "did not validate" in got["B"]["reason"]


def test_second_run_is_served_from_memory(spark):
    rows = [("s", f"n{i}", ["x"], "bin", json.dumps({"edges": [i], "labels": ["a", "b"]}), "r", "unknown or missing" if i == 0 else None)
            for i in range(5)]
    entries = spark.createDataFrame(rows, ENTRY)
    normal = lib.normalise(entries)
    verified = normal.selectExpr("'run-1' run_id", "'t1' ts", "rule_kind", "body_signature", "body", "true passed", "false ltm_hit")
    empty = spark.createDataFrame([], "rule_kind string, body_signature string, body string, first_seen_run_id string, "
                                      "first_seen_at string, approval_event_id string, status string")
    patterns = mem.promote_rules(empty, verified)
    assert patterns.count() == 5
    again = mem.lookup(normal, patterns, mem.KEYS["rule_patterns"], [])
    assert again.where("ltm_hit").count() == 5
    hits = again.selectExpr("'run-2' run_id", "'t2' ts", "rule_kind", "body_signature", "body", "true passed", "ltm_hit")
    assert mem.promote_rules(patterns, hits).count() == 0
    found = rv.review(entries)
    assert [r["ambiguity_class"] for r in found.collect()] == ["null_handling_undefined"]
    kept = found.selectExpr("signature", "'{}' resolution")
    assert [r["auto_resolved"] for r in rv.review(entries, kept).collect()] == [True]


def test_step_numbers_with_a_hot_key(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(0)).alias("k"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 97 % 20000).cast("timestamp_ntz").alias("ts"))
    got = au.step_numbers(rows, ["k"], "ts", "seq")
    from pyspark.sql import Window

    direct = rows.withColumn("step_no", F.row_number().over(Window.partitionBy("k").orderBy("ts", "seq")).cast("bigint"))
    cols = ["k", "seq", "step_no"]
    assert got.select(cols).exceptAll(direct.select(cols)).isEmpty() and got.count() == 2000


def test_a_burst_in_one_second_is_spread(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), (F.col("id") * 7919 % 3000).alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit(1_700_000_000)).otherwise(F.col("id")).alias("s"), F.lit("x").alias("_n"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    rows = rows.select("k", "seq", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "m")
    tied = rows.withColumn("seq", F.when(F.col("k") == "hot", 5).otherwise(F.col("seq")))  # equal in all that orders them
    for frame in (rows, tied.drop("m").withColumn("cell", F.monotonically_increasing_id())):
        sizes = au.in_ranges(frame, ["k", "ts", "seq"]).where("k = 'hot'").groupBy("_range").count().collect()
        assert len(sizes) >= 2 and max(r["count"] for r in sizes) < 1000  # of four ranges, a third of the rows takes more than one
    got = au.step_numbers(rows, ["k"], "ts", "seq")
    assert [r["seq"] for r in got.where("k = 'hot'").orderBy("step_no").collect()] == sorted(r["seq"] for r in rows.where("k = 'hot'").collect())
    assert sorted(r["step_no"] for r in au.step_numbers(tied.drop("m"), ["k"], "ts", "seq").where("k = 'hot'").collect()) == list(range(1, 1001))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [row_number" in line)
    assert au.step_numbers(rows.where("1 = 0"), ["k"], "ts", "seq").count() == 0


def test_agent_chain(spark):
    kinds = ["cg_complete", "v_complete", "r_complete", "v_complete", "apply_complete"]
    rows = spark.createDataFrame([(f"2024-01-01 00:00:0{i}", "run-1", k, "T", i) for i, k in enumerate(kinds)],
                                 "ts string, run_id string, event_type string, target string, event_seq int")
    steps = au.agent_steps(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert [r["agent_chain"] for r in au.agent_chains(steps).collect()] == ["CG>V>R>V"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similarity_equals_brute_force(spark):
    from rulefold.operators.rules import known_rule_kinds

    codes = ["bin", "flagg", "durration", "Risk", "compund", "zzz", "map", "", "label bin " * 40]
    df = spark.createDataFrame([(c,) for c in codes + codes] + [(None,)], "c string")
    got = {(r["code"], r["place"]): (r["term"], r["score"], r["strong"]) for r in suggest_terms(df, "c").collect()}
    want = {}
    for c in codes:
        scored = sorted((edits(c.lower(), k) / max(len(c), len(k)) - 1, k) for k in known_rule_kinds())
        for i, (s, k) in enumerate([x for x in scored if x[0] < 0][:3]):
            want[(c, i + 1)] = (k, pytest.approx(-s), -s >= 0.60)
    assert got == want


def test_suggest_kinds(spark):
    rows = [
        ("s", "A", ["x"], "bins", "{}", "", None),
        ("s", "B", ["x"], "TBD", '{"edges":[1],"labels":["a","b"],"null_handling":"null"}', "", None),
        ("s", "C", ["x"], "q", "{}", "days between visits", None),
        ("s", "D", ["x"], "bin", "{}", "", None),
    ]
    got = {r["name"]: (r["suggestion"], r["confidence"]) for r in suggest_kinds(spark.createDataFrame(rows, ENTRY)).where("place = 1").collect()}
    assert got["A"] == ("bin", 0.75) and got["B"] == ("bin", 0.75) and got["C"] == ("duration", 0.75) and "D" not in got


def test_register_rule_kind(spark):
    from dataclasses import dataclass
    from typing import ClassVar

    from rulefold.functions.cells import col
    from rulefold.operators.rules import RULE_KINDS, RuleColumns, register_rule_kind
    from rulefold.plans.apply import apply_rule
    from rulefold.plans.bodies import Body

    @dataclass(frozen=True)
    class Upper(Body):
        kind: ClassVar[str] = "upper"
        suffix: str = ""

    register_rule_kind("upper", Upper, lambda scope, src, body: RuleColumns(
        F.concat(F.upper(col(src)), F.lit(body.suffix)), "string", F.lit("upper case"), [src]))
    try:
        df = spark.createDataFrame([("a",)], "x string")
        assert apply_rule(df, "t", "upper", {"suffix": "!"}, "x").first()["t"] == "A!"
    finally:
        del RULE_KINDS["upper"]


def test_rows_to_readable_table(spark):
    df = spark.createDataFrame([("run-x", "evt-0123456789", "bin", 3)], "run_id string, event_id string, rule_kind string, n int")
    out = lb.reviewer_table(df)
    assert out.columns == ["Run", "Question ID", "Rule type", "N"] and tuple(out.first()) == ("run-x", "01234567", "Bucketing", 3)


def test_read_dataset_by_name(spark, tmp_path):
    from rulefold.sources.dataset import read_dataset

    (tmp_path / "a.csv").write_text("k\n1\n")
    spark.range(2).write.parquet(str(tmp_path / "b.pq"))
    assert read_dataset(spark, str(tmp_path / "a.csv")).count() == 1
    assert read_dataset(spark, str(tmp_path / "b.pq")).count() == 2
    with pytest.raises(ValueError, match="format"):
        read_dataset(spark, "x.xlsx")


def test_time_bucket_follows_density(spark):
    rows = spark.range(1000).select(F.timestamp_seconds("id").alias("ts"))
    assert au.time_bucket(rows, "ts") == "DAY"
    crowded, au.BUCKET_ROWS = au.BUCKET_ROWS, 100
    try:
        assert au.time_bucket(rows, "ts") == "MINUTE"
    finally:
        au.BUCKET_ROWS = crowded


def test_probe_batches(spark):
    rules = spark.createDataFrame([("r1", [18.0, 65.0], ["a", "b", "c"]), ("r2", [0.5], ["x", "y"])], "rule_id string, edges array<double>, labels array<string>")
    probes = lib.numeric_probes(rules)
    again = lib.numeric_probes(rules.repartition(7))
    cols = ["rule_id", "probe_no", "value"]
    assert probes.count() == 200 and probes.select(cols).exceptAll(again.select(cols)).isEmpty()
    label = lib.bucket_of(F.col("value"), F.col("edges"), F.col("labels"))
    assert probes.where(label.isNull()).isEmpty()
    near = [r["l"] for r in probes.where("rule_id = 'r1' and probe_no < 6").orderBy("probe_no").select(label.alias("l")).collect()]
    assert near == ["b", "c", "a", "b", "b", "c"]
    maps = spark.createDataFrame([("m", {"a": "1", "__unmapped_0000001__": "2"})], "rule_id string, map map<string,string>")
    values = [r["value"] for r in lib.categorical_probes(maps).orderBy("probe_no").collect()]
    assert len(values) == 15 and values[2] == "__unmapped_0000002__" and values[-3:] == [None] * 3


def test_unmapped_error_has_all_values(spark):
    from rulefold.plans.apply import apply_rule
    from rulefold.plans.errors import UnmappedInputError

    df = spark.range(300).select(F.concat(F.lit("v"), "id").alias("x")).union(spark.createDataFrame([("ok",)], "x string"))
    with pytest.raises(UnmappedInputError, match="300 values") as caught:
        apply_rule(df, "t", "flag", {"map": {"ok": "Y"}, "unmapped_handling": "error"}, "x")
    assert caught.value.values.count() == 300


def test_nested_columns_are_profiled(spark):
    df = spark.createDataFrame([(1, [1, 2], ("a",), None), (2, None, ("b",), None)], "k int, arr array<int>, s struct<f:string>, m map<string,int>")
    got = {r["column"]: (r["kind"], r["null_fraction"]) for r in profile(df).collect()}
    assert got["arr"] == ("nested", 0.5) and got["s"] == ("nested", 0.0) and got["m"] == ("nested", 1.0) and got["k"][0] == "numeric"
    from rulefold.operators.profile import sample_values

    samples = {(r["column"], r["place"]): r["value"] for r in sample_values(df, "k").collect()}
    assert samples["k", 1] == "1" and samples["arr", 1] == '{"arr":[1,2]}' and ("m", 1) not in samples


def test_samples_of_ties_gaps_and_lost_keys(spark):
    from rulefold.operators.profile import sample_values

    rows = [(k // 3, f"v{k:03}", float("nan") if k % 2 else k / 2, k if k in (95, 97) else None) for k in range(100)] + [(None, "first", None, None)]
    df = spark.createDataFrame(rows, "k int, text string, number double, `rare.one` int").repartition(5)
    got = {}
    for r in sample_values(df, "k", 4).orderBy("column", "place").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"k": ["0", "0", "0", "1"], "text": ["first", "v000", "v001", "v002"], "number": ["0.0", "1.0", "2.0", "3.0"], "rare.one": ["95", "97"]}
    assert sample_values(df.limit(0), "k").collect() == []
    one_key = sample_values(df.withColumn("k", F.lit(1)), "k", 2).where("column = 'text'").orderBy("place").collect()
    assert [r["value"] for r in one_key] == ["first", "v000"]
    plan = sample_values(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks hand on a few cells per column


def test_profiles_have_samples(spark):
    df = spark.range(60, numPartitions=3).select("id", F.when(F.col("id") > 50, F.col("id").cast("string")).alias("late"), F.lit(None).cast("int").alias("none"), F.array("id").alias("list"))
    got = {r["column"]: r["sample_values"] for r in profile(df).collect()}
    assert got == {"id": [str(k) for k in range(5)], "late": ["51", "52", "53", "54", "55"], "none": [], "list": [f'{{"list":[{k}]}}' for k in range(5)]}
    assert {r["column"]: r["sample_values"] for r in profile(df.orderBy(F.desc("id")), key="id").collect()}["late"] == got["late"]
    assert "sample_values" not in redacted(profile(df)).columns


def test_profiles_of_parts_merge(spark):
    from rulefold.operators.profile import merged_profile, profile_states

    def rows(start, stop):
        return spark.range(start, stop).select(
            "id", (F.col("id") % 500).cast("double").alias("amount"), F.concat(F.lit("c"), F.col("id") % 7).alias("code"),
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 900).cast("int")), "yyyy-MM-dd").alias("visit_date"),
            F.when(F.col("id") % 4 == 0, F.col("id")).alias("gap"), F.array("id").alias("list"))

    states = profile_states(rows(0, 3000), "a").unionByName(profile_states(rows(2000, 5000).withColumn("more", F.lit(True)), "b")).unionByName(profile_states(rows(0, 0), "none"))
    got = {r["column"]: r for r in merged_profile(states.unionByName(states)).collect()}
    want = {r["column"]: r for r in profile(rows(0, 3000).unionByName(rows(2000, 5000).withColumn("more", F.lit(True)), allowMissingColumns=True)).collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g = got[name]
        assert [g[c] for c in ("kind", "dtype", "null_fraction", "min", "max", "values")] == [w[c] for c in ("kind", "dtype", "null_fraction", "min", "max", "values")], name
        assert g["n_unique"] == w["n_unique"] or abs(g["n_unique"] - w["n_unique"]) <= 0.05 * w["n_unique"], name
    assert merged_profile(states.limit(0)).collect() == []
    other = profile_states(rows(0, 5).withColumn("code", F.lit(1)), "c")
    with pytest.raises(ValueError, match="'code'"):
        merged_profile(states.unionByName(other))


def test_steps_without_time_or_run_are_kept(spark):
    rows = spark.createDataFrame(
        [("2024-01-01 00:00:00", "r", 1), (None, "r", 2), ("2024-01-02 00:00:00", None, 3), (None, None, 4), ("2024-01-03 00:00:00", "r", 5)],
        "ts string, run_id string, seq int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["seq"]: r["step_no"] for r in au.step_numbers(rows, ["run_id"], "ts", "seq").collect()}
    assert got == {2: 1, 1: 2, 5: 3, 4: 1, 3: 2}


def test_lookup_of_keys_written_twice(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "signature string, n int")
    memory = spark.createDataFrame([("a", "late", "2024-02"), ("a", "early", "2024-01")], "signature string, resolution string, resolved_at string")
    got = {r["signature"]: (r["resolution"], r["ltm_hit"]) for r in mem.lookup(rows, memory, ["signature"], ["resolution"]).collect()}
    assert got == {"a": ("early", True), "b": (None, False)}


def test_one_signature_for_one_body(spark):
    from rulefold.operators.lineage import body_signatures
    from rulefold.plans.apply import apply_spec
    from rulefold.plans.spec import Spec

    spec = Spec.from_entries([
        {"name": "A", "inputs": ["x"], "rule_kind": "bin", "rule_body": {"edges": [1e-7, 65.0, 1e16], "labels": ["é", "漢", "c", "d"]}},
        {"name": "B", "inputs": ["x"], "rule_kind": "compound", "rule_body": {"conditions": [{"column": "x", "op": ">=", "value": 65.0}]}}])
    derived = apply_spec(spark.createDataFrame([(1.0,)], "x double"), spec)
    library = {r["name"]: r["body_signature"] for r in lib.normalise(spec.entries_df(spark)).collect()}
    assert body_signatures(spark, derived) == library
    two = [("s", "n", ["x"], "bin", b, "r", "unknown") for b in ('{"edges":[1],"labels":["a","b"]}', '{ "labels" : ["a", "b"], "edges": [1] }')]
    assert len({r["signature"] for r in rv.review(spark.createDataFrame(two, ENTRY)).collect()}) == 1
