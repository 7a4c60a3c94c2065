"""A small apiary through reading, review decisions, derivation, verification and lineage."""

import json

import pytest

from rulefold.operators.lineage import column_lineage, with_lineage
from rulefold.operators.verify import is_deterministic, verify
from rulefold.plans.apply import apply_spec
from rulefold.plans.spec import Spec
from rulefold.sources.delimited import read_delimited

HIVES = """hive,site,weight_kg,queen,opened,checked,mites
H1,north,31.5,marked,2024/3/1,15-Mar-2024,2
H2,south,18,none,2024/3/2,9-Mar-2024,14
H3,north,22.25,unmarked,2024/3/5,,41
H4,east,,marked,2024/3/10,31-Mar-2024,9
H5,south,19.75,unmarked,2024/4/1,1-Apr-2024,N/A
H6,east,40,swarm,2024/4/2,20-Apr-2024,0
"""


def rule(name, inputs, kind, notes=None, **body):
    return {"name": name, "inputs": inputs, "rule_kind": kind, "rule_body": body} | ({"ambiguity_notes": notes} if notes else {})


def when(column, op, value):
    return {"column": column, "op": op, "value": value}


HEAVY, SOME, TRACE = ({"label": label, "conditions": [when("mites", ">=", n)]} for label, n in (("heavy", 30), ("some", 10), ("trace", 1)))
# three levels: VISIT reads TREAT, which reads two others
ENTRIES = [
    rule("VISIT", ["TREAT", "GAP", "QUEEN_OK"], "risk_score", fallback_label="later", null_handling="fallback", tiers=[
        {"label": "now", "conditions": [when("TREAT", "==", "Y"), when("GAP", ">=", 14)]},
        {"label": "soon", "combinator": "or", "conditions": [when("QUEEN_OK", "==", "lost"), when("GAP", ">", 17)]}]),
    rule("TREAT", ["MITE_LEVEL", "LIGHT"], "compound", conditions=[when("MITE_LEVEL", "!=", "clean"), when("LIGHT", "==", "N")]),
    rule("MITE_LEVEL", ["mites"], "risk_score", tiers=[HEAVY, SOME, TRACE], fallback_label="clean", null_handling="null"),
    rule("LIGHT", ["weight_kg", "queen"], "compound", combinator="or", conditions=[when("weight_kg", "<", 20), when("queen", "==", "none")]),
    rule("GAP", ["opened", "checked"], "duration", start_column="opened", end_column="checked", unit="weeks", null_handling="null"),
    rule("QUEEN_OK", ["queen"], "flag", "is a swarm a lost queen", map={"marked": "seen", "unmarked": "seen", "none": "lost"}),
]
DECISIONS = [
    {"ticket_kind": "ambiguity", "target": target, "chosen_option": option, "body_patch": patch} for target, option, patch in (
        ("MITE_LEVEL", "drop_tier", {"tiers": [HEAVY, SOME]}), ("GAP", "count_days", {"unit": "days"}), ("LIGHT", "reject", {}),
        ("QUEEN_OK", "lost", {"unmapped_handling": "value", "unmapped_value": "lost"}))]


@pytest.fixture(scope="module")
def hives(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hives") / "hives.csv"
    path.write_text(HIVES)
    return read_delimited(spark, str(path))


@pytest.fixture(scope="module")
def spec(tmp_path_factory):
    path = tmp_path_factory.mktemp("decided") / "decisions.json"
    path.write_text(json.dumps(DECISIONS))
    return Spec.from_entries(ENTRIES), path


@pytest.fixture(scope="module")
def derived(hives, spec):
    return apply_spec(hives, spec[0].patched_from_file(spec[1]))


def test_types_after_reading(hives):
    assert dict(hives.dtypes) == {
        "hive": "string", "site": "string", "weight_kg": "double", "queen": "string", "opened": "string", "checked": "string", "mites": "bigint"}
    assert hives.where("weight_kg IS NULL OR checked IS NULL OR mites IS NULL").count() == 3


@pytest.mark.parametrize("name, expected", [
    ("QUEEN_OK", ["seen", "lost", "seen", "seen", "seen", "lost"]),
    ("GAP", [14, 7, None, 21, 0, 18]),
    ("MITE_LEVEL", ["clean", "some", "heavy", "clean", None, "clean"]),
    ("LIGHT", ["N", "Y", "N", "N", "Y", "N"]),
    ("TREAT", ["N", "N", "Y", "N", "N", "N"]),
    ("VISIT", ["later", "soon", "later", "soon", "later", "soon"]),
])
def test_derived_columns(derived, name, expected):
    assert [r[name] for r in derived.df.orderBy("hive").collect()] == expected


def test_undecided_rules(hives, spec):
    row = apply_spec(hives, spec[0]).df.where("hive = 'H6'").first()
    assert (row["GAP"], row["MITE_LEVEL"], row["QUEEN_OK"]) == (18 / 7, "clean", None)
    assert apply_spec(hives, spec[0]).df.where("MITE_LEVEL = 'trace'").count() == 2


def test_levels(derived):
    assert derived.levels == [["GAP", "LIGHT", "MITE_LEVEL", "QUEEN_OK"], ["TREAT"], ["VISIT"]]


def test_verification_finds_changes(derived):
    sound = verify(derived.df, derived.rules, derived.bodies, expected_rows=6)
    assert sound.findings.where("severity = 'error'").isEmpty() and sound.verdicts.where("passed").count() == 6
    changed = derived.df.selectExpr("* EXCEPT (QUEEN_OK)", "if(hive = 'H1', 'odd', QUEEN_OK) AS QUEEN_OK")
    found = verify(changed, derived.rules, derived.bodies, expected_rows=7).findings
    ids = {(r["derivation"], r["property_id"]) for r in found.collect()}
    assert {("QUEEN_OK", "P-flag-1"), ("QUEEN_OK", "P-flag-4"), ("VISIT", "L1.row_count_preserved")} <= ids
    assert json.loads(found.where("property_id = 'P-flag-4'").first()["sample"]) == {"queen": "marked", "QUEEN_OK": "odd"}
    for table in (derived.df, derived.df.where("1 = 0")):  # what the schema lacks is missing on no rows too
        gone = verify(table.drop("VISIT"), derived.rules)
        assert [r["property_id"] for r in gone.findings.collect() if r["derivation"] == "VISIT"] == ["L1.target_column_present"]
        assert not gone.verdicts.where("derivation = 'VISIT'").first()["passed"]


def test_determinism(hives, spec, derived):
    assert is_deterministic(lambda: apply_spec(hives, spec[0]).df, ["hive"], derived.derived_names())


def test_lineage(spark, derived, spec):
    row = with_lineage(derived, "hive", {"QUEEN_OK": {"hitl_event_ids": ["evt-7"]}}).where("hive = 'H6'").first()
    parsed = json.loads(row["lineage_id"])
    assert (parsed["GAP"]["value"], parsed["QUEEN_OK"]["value"], parsed["QUEEN_OK"]["hitl_event_ids"]) == (18, "lost", ["evt-7"])
    assert parsed["VISIT"]["source_row_ids"] == ["H6"]
    both = json.loads(with_lineage(derived, ["site", "hive"]).where("hive = 'H6'").first()["lineage_id"])
    assert both["MITE_LEVEL"]["source_row_ids"] == ["east", "H6"]
    edges = {(r["derivation"], r["column"], r["origin"]) for r in column_lineage(spark, spec[0]).collect()}
    assert {("VISIT", "GAP", "derived"), ("TREAT", "LIGHT", "derived"), ("LIGHT", "weight_kg", "source")} <= edges


def test_lineage_escapes_text(spark):
    from rulefold.operators.lineage import json_value
    from pyspark.sql import types as T
    from pyspark.sql import functions as F

    cells = ['plain', 'quo"te', 'back\\slash', 'line\nbreak', 'é', "tab\t", "end\n", "", None]
    rows = spark.createDataFrame([(c,) for c in cells], "v string").select(json_value(F.col("v"), T.StringType()).alias("j")).collect()
    assert [json.loads(r["j"]) for r in rows] == cells


def test_spec_table_round_trip(spark, spec):
    back = Spec.from_table(spec[0].entries_df(spark, "apiary"), "apiary")
    assert {n: back.entry(n).body() for n in back.names()} == {n: spec[0].entry(n).body() for n in spec[0].names()}


def test_runs_share_memory(hives, spec):
    from rulefold.plans.run import Memory, PendingTickets, run_spec

    with pytest.raises(PendingTickets, match="QUEEN_OK"):
        run_spec(hives, spec[0], "hive")
    memory, decided = Memory.empty(hives.sparkSession), DECISIONS[-1:]
    first = run_spec(hives, spec[0], "hive", memory=memory, decisions=decided)
    assert (first.counts["derivations_verified"], first.counts["rule_patterns"], first.counts["ambiguity_resolutions"]) == (6, 6, 1)
    assert (first.counts["hitl_tickets_opened"], first.counts["sr_auto_resolved"], first.counts["cg_ltm_hits"]) == (1, 0, 0)
    assert first.events.where("event_type = 'ltm_write'").count() == 7
    assert [(r["target"], json.loads(r["resolution"])["chosen_option"]) for r in first.feedback.collect()] == [("QUEEN_OK", "lost")]
    told = json.loads(first.dataset.where("hive = 'H6'").first()["lineage_id"])["QUEEN_OK"]
    assert told["value"] == "lost" and told["hitl_event_ids"][0].startswith("evt-")
    second = run_spec(hives, spec[0], "hive", memory=first.memory_after(memory))
    assert (second.counts["cg_ltm_hits"], second.counts["sr_auto_resolved"], second.counts["hitl_tickets_opened"], second.counts["rule_patterns"]) == (6, 1, 0, 0)
    assert run_spec(hives, spec[0], "hive", decisions=decided).counts["rule_patterns"] == 0


def test_run_skips_what_a_policy_forbids(hives):
    from rulefold.plans.run import run_spec

    done = run_spec(hives, Spec.from_entries([
        rule("MARK", ["queen"], "flag", map={"marked": "Y"}, unmapped_handling="error"),
        rule("NEXT", ["MARK"], "compound", conditions=[when("MARK", "==", "Y")]),
        rule("SIZE", ["weight_kg"], "bin", edges=[20], labels=["small", "large"])]), "hive")
    assert (done.counts["derivations_verified"], done.counts["derivations_skipped"]) == (1, 1)
    assert "SIZE" in done.dataset.columns and not {"MARK", "NEXT"} & set(done.dataset.columns)


def test_run_withholds_what_fails_its_checks(spark):
    from rulefold.plans.run import Memory, run_spec

    spec = Spec.from_entries([
        {"name": "B", "inputs": ["x"], "rule_kind": "bin", "rule_body": {"edges": [1], "labels": ["lo", "hi"]}},
        {"name": "T", "inputs": ["x"], "rule_kind": "duration", "rule_body": {"start_column": "begun", "end_column": "ended"}},
        {"name": "C", "inputs": ["T"], "rule_kind": "compound", "rule_body": {"conditions": [{"column": "T", "op": "not_null"}]}}])
    df = spark.createDataFrame([(1, 0.5, "2024-01-01", "2024-01-02"), (2, float("inf"), "2024-01-01", "2024-01-03")], "k int, x double, begun string, ended string")
    memory = Memory.empty(spark)
    good = run_spec(df, spec, "k", memory=memory)  # +inf has no bucket, as declared: no failure
    assert {"B", "T", "C"} <= set(good.dataset.columns) and good.counts["rule_patterns"] == 3

    from rulefold.operators.rules import RULE_KINDS, Check, RuleColumns, register_rule_kind
    from rulefold.plans.bodies import BinBody
    from pyspark.sql import functions as F

    build = RULE_KINDS["bin"].build

    def failing(scope, source, body) -> RuleColumns:
        rule = build(scope, source, body)
        rule.checks.append(Check("P-never", "never holds", lambda out: F.lit(True)))
        return rule

    register_rule_kind("failing", BinBody, failing)
    try:
        entries = [d.__dict__ for d in spec.derivations if d.name != "B"]
        bad = Spec.from_entries([
            {"name": "B", "inputs": ["x"], "rule_kind": "failing", "rule_body": {"edges": [1], "labels": ["lo", "hi"]}},
            {"name": "D", "inputs": ["B"], "rule_kind": "compound", "rule_body": {"conditions": [{"column": "B", "op": "not_null"}]}},
            *[{k: e[k] for k in ("name", "inputs", "rule_kind", "rule_body")} for e in entries]])
        run = run_spec(df, bad, "k", memory=memory)
        assert not {"B", "D"} & set(run.dataset.columns) and {"T", "C"} <= set(run.dataset.columns)
        assert set(json.loads(run.dataset.first()["lineage_id"])) == {"T", "C"}
        assert {r["rule_kind"] for r in run.new_patterns.collect()} == {"duration", "compound"} and run.counts["rule_patterns"] == 2
        ends = {(r["event_type"], r["target"]) for r in run.events.collect()}
        assert {("derivation_unresolved", "B"), ("derivation_skipped", "D"), ("apply_complete", "C")} <= ends
        assert ("apply_complete", "D") not in ends
    finally:
        del RULE_KINDS["failing"]
