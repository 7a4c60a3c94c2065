"""Verification and lineage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions.cells import INTEGRAL
from rulefold.functions.signatures import signature_of
from rulefold.operators import verify as v
from rulefold.operators.audit import findings_signatures
from rulefold.operators.lineage import RECORD_FIELDS, read_lineage, with_lineage
from rulefold.operators.lookup import find, write_keyed
from rulefold.operators.rules import RULE_KINDS, Check, RuleColumns, Scope, register_rule_kind, rule_kind
from rulefold.plans.apply import apply_rule
from rulefold.plans.bodies import BinBody
from rulefold.plans.publish import publish
from rulefold.plans.run import Memory, run_spec
from rulefold.plans.spec import Spec
from rulefold.queries import query
from rulefold.queries.derivations import FLAGSHIP, FLAGSHIP_SQL, _cond, flagship, shipped
from rulefold.session import fresh_folder, table

# A stored table whose outputs were partly changed after the rules ran.
STORED_SQL = """
o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS s,
             CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS p, o_orderdate,
             CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + to_days((o_custkey % 50 - 10)::INTEGER) END AS due FROM orders),
st AS (SELECT *, CASE WHEN o_custkey % 100 = 1 THEN 'odd' WHEN o_custkey % 100 = 2 THEN NULL WHEN p IS NULL THEN NULL
                      WHEN p < 100000 THEN 'low' WHEN p < 300000 THEN 'mid' ELSE 'top' END AS band,
       CASE WHEN o_custkey % 100 = 3 THEN 'X' WHEN o_custkey % 100 = 4 THEN NULL WHEN s IS NULL THEN 'M' WHEN s = 'F' THEN 'done'
            ELSE 'U' END AS state,
       CASE WHEN o_custkey % 100 = 5 THEN 'maybe' WHEN p >= 200000 AND s = 'F' THEN 'Y' ELSE 'N' END AS pop,
       CASE WHEN o_custkey % 100 = 6 THEN 'low' WHEN p >= 300000 AND s = 'F' THEN 'high' WHEN p >= 300000 OR s = 'F'
            THEN 'medium' WHEN (p >= 300000) IS NULL AND (s = 'F') IS NULL THEN NULL ELSE 'low' END AS risk,
       CASE WHEN o_custkey % 100 = 7 THEN -1 WHEN o_custkey % 100 = 8 THEN 0 WHEN o_custkey % 100 = 9 THEN days + 1
            WHEN o_custkey % 100 = 10 THEN abs(days) ELSE days END AS wait
       FROM (SELECT *, epoch(due - o_orderdate) / 86400 AS days FROM o))"""

STORED_RULES = {
    "band": ("bin", "p", {"edges": [100000, 300000], "labels": ["low", "mid", "top"]}),
    "state": ("flag", "s", {"map": {"F": "done"}, "null_handling": "value", "null_value": "M",
                            "unmapped_handling": "value", "unmapped_value": "U"}),
    "pop": ("compound", None, {"conditions": [_cond("p", ">=", 200000), _cond("s", "==", "F")]}),
    "risk": ("risk_score", None, {"tiers": [
        {"label": "high", "conditions": [_cond("p", ">=", 300000), _cond("s", "==", "F")]},
        {"label": "medium", "combinator": "or", "conditions": [_cond("p", ">=", 300000), _cond("s", "==", "F")]},
        {"label": "never", "conditions": [_cond("p", "<", 0)]}],
        "fallback_label": "low", "null_handling": "null"}),
    "wait": ("duration", None, {"start_column": "o_orderdate", "end_column": "due"}),
}


def stored(spark: SparkSession, folder: str):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("p"), "o_orderdate",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.expr("o_orderdate + make_dt_interval(CAST(o_custkey % 50 AS INT) - 10)")).alias("due"))
    scope = Scope(df.schema)
    bodies = {n: rule_kind(k).body.parse(b) for n, (k, _, b) in STORED_RULES.items()}
    rules = {n: rule_kind(k).build(scope, src, bodies[n]) for n, (k, src, _) in STORED_RULES.items()}
    part = F.col("o_custkey") % 100
    none = F.lit(None).cast("string")
    df = df.withColumns({
        "band": F.when(part == 1, F.lit("odd")).when(part == 2, none).otherwise(rules["band"].value),
        "state": F.when(part == 3, F.lit("X")).when(part == 4, none).otherwise(rules["state"].value),
        "pop": F.when(part == 5, F.lit("maybe")).otherwise(rules["pop"].value),
        "risk": F.when(part == 6, F.lit("low")).otherwise(rules["risk"].value),
        "wait": F.when(part == 7, -1).when(part == 8, 0).when(part == 9, rules["wait"].value + 1).when(part == 10, F.abs(rules["wait"].value)).otherwise(rules["wait"].value),
    })
    return df, rules, bodies


T1, T2 = "(p >= 300000 AND s = 'F')", "(p >= 300000 OR s = 'F')"
UNDEF = f"({T1} IS NULL AND {T2} IS NULL AND p IS NULL)"
# (property, derivation, condition of a violation), as the rules are meant
BROKEN = [
    ("P-bin-1", "band", "p IS NOT NULL AND (band IS NULL OR band NOT IN ('low','mid','top'))"),
    ("P-bin-2", "band", "p IS NULL AND band IS NOT NULL"),
    ("P-bin-3", "band", "band IS NOT NULL AND band NOT IN ('low','mid','top')"),
    ("P-flag-1", "state", "s = 'F' AND state IS DISTINCT FROM 'done'"),
    ("P-flag-2", "state", "s IS NULL AND state IS DISTINCT FROM 'M'"),
    ("P-flag-3", "state", "s IS NOT NULL AND s <> 'F' AND state IS DISTINCT FROM 'U'"),
    ("P-flag-4", "state", "state IS NULL OR state NOT IN ('done','M','U')"),
    ("P-compound-1", "pop", "(p >= 200000 AND s = 'F') IS NOT NULL AND pop IS DISTINCT FROM (CASE WHEN p >= 200000 AND s = 'F' THEN 'Y' ELSE 'N' END)"),
    ("P-compound-2", "pop", "(p >= 200000 AND s = 'F') IS NULL AND pop IS DISTINCT FROM 'N'"),
    ("P-compound-3", "pop", "pop IS NULL OR pop NOT IN ('Y','N')"),
    ("P-risk_score-2", "risk", f"coalesce({T2}, false) AND risk IS DISTINCT FROM (CASE WHEN {T1} THEN 'high' ELSE 'medium' END)"),
    ("P-risk_score-3", "risk", f"NOT coalesce({T2}, false) AND NOT {UNDEF} AND risk IS DISTINCT FROM 'low'"),
    ("P-risk_score-4", "risk", f"{UNDEF} AND risk IS NOT NULL"),
    ("P-duration-1", "wait", "due >= o_orderdate AND wait < 0"),
    ("P-duration-2", "wait", "due IS NULL AND wait IS NOT NULL"),
    ("P-duration-3", "wait", "due IS NOT NULL AND (wait IS NULL OR abs(wait - days) > 1e-9)"),
    ("P-duration-4", "wait", "due < o_orderdate AND NOT coalesce(wait < 0, false)"),
]
STORED_CHECKS = " UNION ALL ".join(
    f"SELECT '{name}' AS derivation, '{prop}' AS property_id, 'error' AS severity, count(*) AS n_rows, count(*) FILTER ({cond}) AS n_violations FROM st"
    for prop, name, cond in BROKEN)
REACH = " UNION ALL ".join(
    f"SELECT 'risk', 'P-risk_score-1', 'warning', count(*), CAST(count(*) FILTER ({c}) = 0 AS BIGINT) FROM st"
    for c in (T1, f"{T2} AND NOT coalesce({T1}, false)", "p < 0"))
# what the schema and the bodies decide: all columns are there, all handlings are declared
DECLARED = [*(("L1.target_column_present", n) for n in STORED_RULES), *((f"L2.bin.{x}", "band") for x in ("null_handling_explicit", "null_label_present")),
            *((f"L2.flag.{x}", "state") for x in ("null_handling_explicit", "unmapped_handling_explicit", "null_value_present", "unmapped_value_present"))]
DECLARED_SQL = " UNION ALL ".join(f"SELECT '{name}', '{prop}', 'error', count(*), 0 FROM st" for prop, name in DECLARED)


@query("findings_all", f"WITH {STORED_SQL} {STORED_CHECKS} UNION ALL {REACH} UNION ALL {DECLARED_SQL}")
def findings_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every check of every layer and rule."""
    df, rules, bodies = stored(spark, folder)
    return v.verify(df, rules, bodies).checks.select("derivation", "property_id", "severity", "n_rows", "n_violations")


_INPUTS = {"band": ["p"], "state": ["s"], "pop": ["p", "s"], "risk": ["p", "s"], "wait": ["o_orderdate", "due"]}


def _smallest(prop: str, name: str, cond: str) -> str:
    cells = " || ',' || ".join(f"""'"{c}":' || coalesce('"' || CAST({c} AS VARCHAR) || '"', 'null')""" for c in (*_INPUTS[name], name))
    return f"SELECT '{name}' AS derivation, '{prop}' AS property_id, min('{{' || {cells} || '}}') FILTER ({cond}) AS sample FROM st HAVING count(*) FILTER ({cond}) > 0"


@query("finding_samples", f"""
WITH {STORED_SQL} {" UNION ALL ".join(_smallest(*x) for x in BROKEN)}
UNION ALL SELECT derivation, property_id, NULL FROM ({REACH.replace("SELECT 'risk', 'P-risk_score-1', 'warning', count(*), ", "SELECT 'risk' AS derivation, 'P-risk_score-1' AS property_id, ").replace(" FROM st", " AS n FROM st")}) WHERE n > 0""")
def finding_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A violating row for each finding of every rule."""
    df, rules, bodies = stored(spark, folder)
    return v.verify(df, rules, bodies).findings.select("derivation", "property_id", "sample")


@query("verdicts", f"""
WITH {STORED_SQL}, ch AS ({STORED_CHECKS} UNION ALL {REACH})
SELECT derivation, count(*) FILTER (severity = 'error' AND n_violations > 0) = 0 AS passed,
       count(*) FILTER (n_violations > 0) AS n_findings FROM ch GROUP BY derivation
UNION ALL SELECT 'QTY_GROUP', true, 0 UNION ALL SELECT 'RETURN_FLAG', true, 0 UNION ALL SELECT 'SHIP_DAYS', true, 0
UNION ALL SELECT 'POP_FLAG', true, 0 UNION ALL SELECT 'RISK', true, 0""")
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    df, rules, bodies = stored(spark, folder)
    clean = flagship(spark, folder)
    return v.verify(df, rules, bodies, sample=False).verdicts.unionByName(
        v.verify(clean.df, clean.rules, clean.bodies, sample=False).verdicts)


@query("row_count_preserved", """
SELECT 'L1.row_count_preserved' AS property_id, 0::BIGINT AS n_violations, count(*) AS n_rows
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def row_count_preserved(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts before and after a derivation; both counts read the join keys only."""
    before = shipped(spark, folder)
    done = apply_rule(before, "QTY_GROUP", "bin", FLAGSHIP.entry("QTY_GROUP").rule_body, "l_quantity")
    counts = before.agg(F.count(F.lit(1)).alias("n")).unionAll(done.agg(F.count(F.lit(1)).alias("n")))
    return counts.agg(
        F.lit("L1.row_count_preserved").alias("property_id"), (F.max("n") - F.min("n")).alias("n_violations"),
        F.max("n").alias("n_rows"))


@query("coverage_partitions", f"""
WITH {STORED_SQL}
SELECT 'band' AS derivation, 'declared' AS "partition", count(p) AS n_rows FROM st
UNION ALL SELECT 'band', 'null', count(*) - count(p) FROM st
UNION ALL SELECT 'band', 'out_of_range', 0 FROM st WHERE o_orderkey = (SELECT min(o_orderkey) FROM st)
UNION ALL SELECT 'state', 'declared', count(*) FILTER (s = 'F') FROM st
UNION ALL SELECT 'state', 'null', count(*) FILTER (s IS NULL) FROM st
UNION ALL SELECT 'state', 'unmapped', count(*) FILTER (s <> 'F') FROM st
UNION ALL SELECT 'pop', 'true', count(*) FILTER (p >= 200000 AND s = 'F') FROM st
UNION ALL SELECT 'pop', 'false', count(*) FILTER (NOT (p >= 200000 AND s = 'F')) FROM st
UNION ALL SELECT 'pop', 'null', count(*) FILTER ((p >= 200000 AND s = 'F') IS NULL) FROM st
UNION ALL SELECT 'wait', 'declared', count(due) FROM st UNION ALL SELECT 'wait', 'null', count(*) - count(due) FROM st
UNION ALL SELECT 'risk', 'matched', count(*) FILTER ({T2}) FROM st
UNION ALL SELECT 'risk', 'null', count(*) FILTER ({UNDEF}) FROM st
UNION ALL SELECT 'risk', 'fallback', count(*) FILTER (NOT coalesce({T2}, false) AND NOT {UNDEF}) FROM st""")
def coverage_partitions(spark: SparkSession, folder: str) -> DataFrame:
    df, rules, _ = stored(spark, folder)
    return v.coverage(df, rules)


@query("undeclared_values", """
SELECT o_orderpriority AS value, count(*) AS n_rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
GROUP BY o_orderpriority""")
def undeclared(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderpriority")
    kind = rule_kind("flag")
    rule = kind.build(Scope(df.schema), "o_orderpriority", kind.body.parse({"map": {"1-URGENT": "Y", "5-LOW": "N"}}))
    return v.undeclared_values(df, rule)


@query("inconsistent_inputs", f"""
WITH {STORED_SQL}
SELECT s, count(*) AS n_rows FROM st GROUP BY s HAVING count(DISTINCT coalesce(state, chr(0))) > 1""")
def inconsistent(spark: SparkSession, folder: str) -> DataFrame:
    df, _, _ = stored(spark, folder)
    return v.inconsistent_inputs(df, ["s"], "state")


@query("determinism", """
SELECT count(*) AS n_rows, true AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def determinism(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of two evaluations side by side: two scans, two one-row results."""
    keys, names = ["l_orderkey", "l_linenumber"], FLAGSHIP.names()
    a = v.fingerprint(flagship(spark, folder).df, keys, names)
    b = v.fingerprint(flagship(spark, folder).df, keys, names)
    rows = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return rows.agg(
        F.max("n_rows").alias("n_rows"),
        ((F.min("n_rows") == F.max("n_rows")) & (F.min("hash_sum") == F.max("hash_sum"))
         & (F.min("hash_xor") == F.max("hash_xor"))).alias("same"))


@query("findings_signature", f"""
WITH {STORED_SQL}, ch AS ({STORED_CHECKS})
SELECT 'stored' AS run_id, left(sha256('[' || string_agg('["L_p","' || property_id || '","' || derivation || '"]', ','
       ORDER BY property_id, derivation) || ']'), 16) AS findings_signature FROM ch WHERE n_violations > 0""")
def findings_signature(spark: SparkSession, folder: str) -> DataFrame:
    df, rules, _ = stored(spark, folder)
    findings = v.verify(df, rules, sample=False).findings.where("severity = 'error'")
    return findings_signatures(findings.withColumn("run_id", F.lit("stored")), ["run_id"])


@query("publish_checked", f"""
WITH {FLAGSHIP_SQL}, n AS (SELECT count(*) AS n FROM d)
SELECT 'flagship' AS run, "RISK" AS what, count(*) AS n_rows FROM d GROUP BY ALL
UNION ALL SELECT 'flagship', 'rows read', n FROM n UNION ALL SELECT 'flagship', 'rows written', n FROM n
UNION ALL SELECT 'flagship', 'violations', 0
UNION ALL SELECT 'strict', 'RETURN_FLAG:unmapped', count(*) FILTER (l_returnflag NOT IN ('R', 'N')) FROM d
UNION ALL SELECT 'strict', 'tables left', 0""")
def publish_checked(spark: SparkSession, folder: str) -> DataFrame:
    """A spec that passes is published and read back; one whose policy forbids a value leaves nothing. Each reads the rows once."""
    rows, paths = shipped(spark, folder), [fresh_folder(spark, "publish") for _ in range(2)]
    good = publish(rows, FLAGSHIP, paths[0], key=["l_orderkey", "l_linenumber"], integral="always")
    strict = Spec.from_entries([
        {"name": d.name, "inputs": d.inputs, "rule_kind": d.rule_kind, "rule_body": {"map": d.rule_body["map"], "unmapped_handling": "error"} if d.name == "RETURN_FLAG" else d.rule_body}
        for d in FLAGSHIP.derivations])
    bad = publish(rows, strict, paths[1], integral="always", raise_on_failure=False)
    left = [p for p in paths[1:] if bad.published]
    facts = [("flagship", "rows read", good.rows_read), ("flagship", "rows written", good.rows_written), ("flagship", "violations", good.checks.checks.agg(F.sum("n_violations")).first()[0]),
             ("strict", "RETURN_FLAG:unmapped", bad.blocked["RETURN_FLAG"].by_policy["unmapped"]), ("strict", "tables left", len(left))]
    labels = spark.read.parquet(paths[0]).groupBy(F.lit("flagship").alias("run"), F.col("RISK").alias("what")).agg(F.count(F.lit(1)).alias("n_rows"))
    return labels.unionByName(spark.createDataFrame(facts, "run string, what string, n_rows bigint"))


# ---------------------------------------------------------------- lineage

def _sig(name: str) -> str:
    return signature_of(FLAGSHIP.entry(name).body().as_dict())


def _lineage_json(name: str, value: str) -> str:
    kind = FLAGSHIP.entry(name).rule_kind
    return (f"""'"{name}":{{"value":' || {value} || ',"rule_kind":"{kind}","body_signature":"{_sig(name)}","""
            """"agent_chain":["CG","V"],"hitl_event_ids":[],"ltm_pattern_ref":null,"source_row_ids":[' || l_orderkey || ',' || l_linenumber || ']}'""")


_TEXT = {n: f"""'"' || "{n}" || '"'""" for n in ("QTY_GROUP", "RETURN_FLAG", "POP_FLAG", "RISK")}
_VALUES = {**_TEXT, "SHIP_DAYS": '"SHIP_DAYS"'}
_ORDER = ["QTY_GROUP", "RETURN_FLAG", "SHIP_DAYS", "POP_FLAG", "RISK"]


@query("lineage_rows", f"""
WITH {FLAGSHIP_SQL}
SELECT l_orderkey, l_linenumber, '{{' || {" || ',' || ".join(_lineage_json(n, _VALUES[n]) for n in _ORDER)} || '}}' AS lineage_id
FROM d""")
def lineage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return with_lineage(flagship(spark, folder), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "lineage_id")


@query("lineage_read_back", f"""
WITH {FLAGSHIP_SQL}
{" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{n}' AS derivation, CAST(\"{n}\" AS VARCHAR) AS value, "
    f"'{FLAGSHIP.entry(n).rule_kind}' AS rule_kind, '{_sig(n)}' AS body_signature, 'CG>V' AS agent_chain, "
    f"l_orderkey || ',' || l_linenumber AS source_row_ids FROM d" for n in _ORDER)}""")
def lineage_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage of all rows, from the JSON."""
    rows = lineage_rows(spark, folder)
    fields = {n: RECORD_FIELDS[n] for n in ("value", "rule_kind", "body_signature", "agent_chain", "source_row_ids")}
    if all(isinstance(rows.schema[k].dataType, INTEGRAL) for k in ("l_orderkey", "l_linenumber")):
        fields["source_row_ids"] = "array<bigint>"
    return read_lineage(rows, fields=fields).select(
        "l_orderkey", "l_linenumber", "derivation", "value", "rule_kind", "body_signature",
        F.array_join("agent_chain", ">").alias("agent_chain"), F.array_join(F.col("source_row_ids").cast("array<string>"), ",").alias("source_row_ids"))


@query("lineage_lookup", f"""
WITH {FLAGSHIP_SQL}, w AS (SELECT min(o_orderkey) AS k, o_orderpriority FROM orders GROUP BY o_orderpriority)
{" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{n}' AS derivation, CAST(\"{n}\" AS VARCHAR) AS value FROM d WHERE l_orderkey IN (SELECT k FROM w)" for n in _ORDER)}""")
def lineage_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage of the first order of every priority, from lineage of all rows that is kept sorted by order."""
    path = fresh_folder(spark, "lineage")
    write_keyed(lineage_rows(spark, folder), path, ["l_orderkey", "l_linenumber"])
    wanted = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("l_orderkey"))
    found = find(spark, path, "l_orderkey", [r["l_orderkey"] for r in wanted.collect()])  # a row per priority
    return read_lineage(found, fields={"value": "string"}).select("l_orderkey", "l_linenumber", "derivation", "value")


@query("run_withholds_failed", """
SELECT 'dataset' AS what, CASE WHEN l_quantity < 10 THEN 'small' ELSE 'large' END AS value, count(*) AS n FROM lineitem GROUP BY value
UNION ALL SELECT 'column', unnest(['l_linenumber', 'l_orderkey', 'l_quantity', 'size', 'lineage_id']), 1
UNION ALL SELECT 'derivation_unresolved', 'share', count(*) FROM (SELECT 1 FROM lineitem WHERE l_quantity > 45 LIMIT 1)
UNION ALL SELECT 'derivation_skipped', 'usable', 1 UNION ALL SELECT 'apply_complete', 'size', 1 UNION ALL SELECT 'remembered', 'bin', 1
UNION ALL SELECT 'violations', 'share', count(*) FROM lineitem WHERE l_quantity > 45""")
def run_withholds_failed(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run with a good rule, one of an own kind that fails its check, and a rule that reads it."""
    def percent(scope: Scope, source: str, body: BinBody) -> RuleColumns:
        value = F.col(source) / body.edges[0]
        over = Check("P-percent-1", "share above one", lambda out: out > 1)
        return RuleColumns(value, "double precision", F.lit("share of the limit"), [source], checks=[over])

    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    register_rule_kind("percent", BinBody, percent)
    try:
        spec = Spec.from_entries([
            {"name": "size", "inputs": ["l_quantity"], "rule_kind": "bin", "rule_body": {"edges": [10], "labels": ["small", "large"]}},
            {"name": "share", "inputs": ["l_quantity"], "rule_kind": "percent", "rule_body": {"edges": [45], "labels": ["in", "out"]}},
            {"name": "usable", "inputs": ["share"], "rule_kind": "compound", "rule_body": {"conditions": [_cond("share", "not_null")]}}])
        run = run_spec(rows, spec, ["l_orderkey", "l_linenumber"], memory=Memory.empty(spark))
    finally:
        del RULE_KINDS["percent"]
    one = F.lit(1).cast("bigint").alias("n")
    ends = run.events.where("event_type IN ('derivation_unresolved', 'derivation_skipped', 'apply_complete')")
    return (
        run.dataset.groupBy(F.lit("dataset").alias("what"), F.col("size").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(spark.range(1).select(F.lit("column").alias("what"), F.explode(F.array(*[F.lit(c) for c in run.dataset.columns])).alias("value"), one))
        .unionByName(ends.select(F.col("event_type").alias("what"), F.col("target").alias("value"), one))
        .unionByName(run.new_patterns.select(F.lit("remembered").alias("what"), F.col("rule_kind").alias("value"), one))
        .unionByName(run.checks.findings.select(F.lit("violations").alias("what"), F.col("derivation").alias("value"), F.col("n_violations").alias("n"))))
