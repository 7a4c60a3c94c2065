"""Rule kinds, policies and whole specs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators.policy import quarantine
from rulefold.operators.rules import Scope, rule_kind
from rulefold.plans.apply import Derived, apply_rule, apply_spec
from rulefold.plans.spec import Spec
from rulefold.queries import query
from rulefold.session import table

QTY = {"edges": [10, 25, 40], "labels": ["small", "medium", "large", "bulk"]}


@query("bin_quantity", """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 25 THEN 'medium'
            WHEN l_quantity < 40 THEN 'large' ELSE 'bulk' END AS qty_band
FROM lineitem""")
def bin_quantity(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return apply_rule(df, "qty_band", "bin", QTY, "l_quantity")


@query("bin_acctbal_null_label", """
WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
                                  WHEN c_nationkey = 3 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, CASE WHEN bal IS NULL OR isnan(bal) THEN 'unknown' WHEN bal < 0 THEN 'debt'
                       WHEN bal < 5000 THEN 'normal' ELSE 'rich' END AS band
FROM c""")
def bin_acctbal_null_label(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING",
               F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))).alias("bal"),
    )
    body = {"edges": [0, 5000], "labels": ["debt", "normal", "rich"], "null_handling": "label", "null_label": "unknown"}
    return apply_rule(df, "band", "bin", body, "bal").drop("bal")


@query("bin_edge_boundaries", """
WITH p AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'inf'::DOUBLE WHEN p_brand = 'Brand#2' THEN '-inf'::DOUBLE
                                  ELSE p_size END AS x FROM part)
SELECT p_partkey, CASE WHEN x = 'inf'::DOUBLE THEN NULL WHEN x < 1 THEN 'none' WHEN x < 25 THEN 'low'
                       WHEN x < 50 THEN 'high' ELSE 'top' END AS size_band
FROM p""")
def bin_edge_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#1", F.lit(float("inf")))
        .when(F.col("p_brand") == "Brand#2", F.lit(float("-inf")))
        .otherwise(F.col("p_size").cast("double")).alias("x"),
    )
    body = {"edges": [1, 25, 50], "labels": ["none", "low", "high", "top"]}
    return apply_rule(df, "size_band", "bin", body, "x").drop("x")


@query("flag_returnflag", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' END AS state
FROM lineitem""")
def flag_returnflag(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return apply_rule(df, "state", "flag", {"map": {"R": "returned", "A": "accepted"}}, "l_returnflag").drop("l_returnflag")


@query("flag_priority_unmapped_value", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Y' WHEN '2-HIGH' THEN 'Y' WHEN '5-LOW' THEN 'N' ELSE 'U' END
       AS urgent
FROM orders""")
def flag_priority_unmapped_value(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    body = {"map": {"1-URGENT": "Y", "2-HIGH": "Y", "5-LOW": "N"}, "unmapped_handling": "value", "unmapped_value": "U"}
    return apply_rule(df, "urgent", "flag", body, "o_orderpriority").drop("o_orderpriority")


@query("flag_null_value", """
SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'MISSING'
                        WHEN o_orderstatus = 'F' THEN 'done' END AS state
FROM orders""")
def flag_null_value(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    body = {"map": {"F": "done"}, "null_handling": "value", "null_value": "MISSING"}
    return apply_rule(df, "state", "flag", body, "s").drop("s")


@query("flag_number_keys", """
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN p_size = 2 THEN 'two' ELSE 'many' END AS size_word,
       CASE WHEN p_retailprice = 900.0 THEN 'base' ELSE 'other' END AS price_word
FROM part""")
def flag_number_keys(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    rest = {"unmapped_handling": "value"}
    df = apply_rule(df, "size_word", "flag", {"map": {"1": "one", "2": "two"}, **rest, "unmapped_value": "many"}, "p_size")
    df = apply_rule(df, "price_word", "flag", {"map": {"900.0": "base"}, **rest, "unmapped_value": "other"}, "p_retailprice")
    return df.select("p_partkey", "size_word", "price_word")


@query("flag_large_map", """
SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 0 AND 89
                      THEN 'group' || (CAST(json_extract_string(props, '$.k') AS INT) % 7) ELSE 'U' END AS k_group
FROM events""")
def flag_large_map(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    body = {"map": {str(k): f"group{k % 7}" for k in range(90)}, "unmapped_handling": "value", "unmapped_value": "U"}
    return apply_rule(df, "k_group", "flag", body, "k").drop("k")


def shipped(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Line items with their order's date; the join side of orders is pruned to what the rules read."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", *more)
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("duration_order_to_ship", """
SELECT l_orderkey, l_linenumber,
       CAST(epoch(l_shipdate - o_orderdate) / 86400 AS BIGINT) AS days,
       round(epoch(l_shipdate - o_orderdate) / 86400 / 7, 6) AS weeks,
       round(epoch(l_shipdate - o_orderdate) / 86400 / 30, 6) AS months,
       round(epoch(l_shipdate - o_orderdate) / 86400 / 365, 6) AS years
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def duration_order_to_ship(spark: SparkSession, folder: str) -> DataFrame:
    df = shipped(spark, folder)
    units = ["days", "weeks", "months", "years"]
    spec = Spec.from_entries([
        {"name": u, "inputs": ["o_orderdate", "l_shipdate"], "rule_kind": "duration",
         "rule_body": {"start_column": "o_orderdate", "end_column": "l_shipdate", "unit": u}}
        for u in units])
    done = apply_spec(df, spec).df
    return done.select("l_orderkey", "l_linenumber", "days", *[F.round(u, 6).alias(u) for u in units[1:]])


@query("duration_text_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN NULL
                        ELSE CAST(o_custkey % 400 AS BIGINT) - 100 END AS open_days
FROM orders""")
def duration_text_dates(spark: SparkSession, folder: str) -> DataFrame:
    ends = F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 400 as int) - 100)")
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("opened"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.date_format(ends, "yyyy-MM-dd")).alias("closed"),
    )
    body = {"start_column": "opened", "end_column": "closed"}
    return apply_rule(df, "open_days", "duration", body).select("o_orderkey", "open_days")


def _cond(column: str, op: str, value=None) -> dict:
    return {"column": column, "op": op} if value is None else {"column": column, "op": op, "value": value}


@query("compound_and_not_null", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 AND nullif(o_orderstatus, 'P') IS NOT NULL THEN 'Y' ELSE 'N' END AS pop
FROM orders""")
def compound_and_not_null(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    body = {"conditions": [_cond("o_totalprice", ">=", 250000), _cond("status", "not_null")]}
    return apply_rule(df, "pop", "compound", body).select("o_orderkey", "pop")


@query("compound_or", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity > 45 OR l_discount <= 0.01 OR l_returnflag = 'R' THEN 'check' ELSE 'pass' END AS audit
FROM lineitem""")
def compound_or(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    body = {"combinator": "or", "true_value": "check", "false_value": "pass",
            "conditions": [_cond("l_quantity", ">", 45), _cond("l_discount", "<=", 0.01), _cond("l_returnflag", "==", "R")]}
    return apply_rule(df, "audit", "compound", body).select("l_orderkey", "l_linenumber", "audit")


@query("compound_in", """
SELECT o_orderkey, CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN NULL
                        WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS by_text,
       CASE WHEN o_custkey IN (1, 2, 3, 5, 8, 13) THEN 'Y' ELSE 'N' END AS by_number,
       'N' AS by_mismatch
FROM orders""")
def compound_in(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"))
    spec = Spec.from_entries([
        {"name": n, "inputs": [c], "rule_kind": "compound",
         "rule_body": {"conditions": [_cond(c, "in", v)], "null_handling": "null"}}
        for n, c, v in [("by_text", "prio", ["1-URGENT", "2-HIGH"]), ("by_number", "o_custkey", [1, 2, 3, 5, 8, 13]),
                        ("by_mismatch", "o_custkey", ["1", "2"])]])
    return apply_spec(df, spec).df.select("o_orderkey", *spec.names())


@query("compound_null_policies", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v,
                  CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS u FROM events),
     t AS (SELECT event_id, (v >= 20 AND u < 50) AS b2, (v >= 20 OR u < 50) AS any_of FROM e)
SELECT event_id, CASE WHEN b2 IS NULL THEN NULL WHEN b2 THEN 'Y' ELSE 'N' END AS and_null,
       CASE WHEN coalesce(b2, true) THEN 'Y' ELSE 'N' END AS and_true,
       CASE WHEN coalesce(b2, false) THEN 'Y' ELSE 'N' END AS and_false,
       CASE WHEN any_of IS NULL THEN NULL WHEN any_of THEN 'Y' ELSE 'N' END AS or_null,
       CASE WHEN coalesce(any_of, true) THEN 'Y' ELSE 'N' END AS or_true,
       CASE WHEN coalesce(any_of, false) THEN 'Y' ELSE 'N' END AS or_false
FROM t""")
def compound_null_policies(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("u"))
    conditions = [_cond("v", ">=", 20), _cond("u", "<", 50)]
    spec = Spec.from_entries([
        {"name": f"{comb}_{policy}", "inputs": ["v", "u"], "rule_kind": "compound",
         "rule_body": {"conditions": conditions, "combinator": comb, "null_handling": policy}}
        for comb in ("and", "or") for policy in ("null", "true", "false")])
    return apply_spec(df, spec).df.select("event_id", *spec.names())


@query("compound_text_numbers", r"""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'pending' WHEN event_type = 'view' THEN '<5'
                                 WHEN event_type = 'signup' THEN NULL ELSE CAST(value AS VARCHAR) END AS lab FROM events)
SELECT event_id, CASE WHEN TRY_CAST(lab AS DOUBLE) > 60 THEN 'Y' WHEN TRY_CAST(lab AS DOUBLE) IS NULL THEN NULL
                      ELSE 'N' END AS high,
       CASE WHEN lab IS NULL THEN NULL WHEN lab = 'pending' THEN 'Y' ELSE 'N' END AS waits,
       CASE WHEN lab IS NULL THEN NULL WHEN lab <> 'pending' THEN 'Y' ELSE 'N' END AS settled,
       CASE WHEN lab IS NULL THEN 'Y' ELSE 'N' END AS absent
FROM e""")
def compound_text_numbers(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("pending")).when(F.col("event_type") == "view", F.lit("<5"))
        .when(F.col("event_type") != "signup", F.col("value").cast("string")).alias("lab"))
    spec = Spec.from_entries([
        {"name": n, "inputs": ["lab"], "rule_kind": "compound",
         "rule_body": {"conditions": [c], "null_handling": "null"}}
        for n, c in [("high", _cond("lab", ">", 60)), ("waits", _cond("lab", "==", "pending")),
                     ("settled", _cond("lab", "!=", "pending")), ("absent", _cond("lab", "is_null"))]])
    return apply_spec(df, spec).df.select("event_id", *spec.names())


def _tiers(price: str, prio: str) -> dict:
    return {
        "tiers": [
            {"label": "high", "combinator": "and",
             "conditions": [_cond(price, ">=", 300000), _cond(prio, "in", ["1-URGENT", "2-HIGH"])]},
            {"label": "medium", "combinator": "or",
             "conditions": [_cond(price, ">=", 300000), _cond(prio, "==", "1-URGENT")]},
        ],
        "fallback_label": "low",
    }


@query("risk_order_tiers", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                        WHEN o_totalprice >= 300000 OR o_orderpriority = '1-URGENT' THEN 'medium' ELSE 'low' END AS risk
FROM orders""")
def risk_order_tiers(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return apply_rule(df, "risk", "risk_score", _tiers("o_totalprice", "o_orderpriority")).select("o_orderkey", "risk")


@query("risk_all_undefined", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS p,
                  CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS r FROM orders),
     t AS (SELECT *, (p >= 300000 AND r IN ('1-URGENT', '2-HIGH')) AS t1, (p >= 300000 OR r = '1-URGENT') AS t2 FROM o)
SELECT o_orderkey, CASE WHEN t1 THEN 'high' WHEN t2 THEN 'medium' WHEN t1 IS NULL AND t2 IS NULL THEN NULL
                        ELSE 'low' END AS risk_null,
       CASE WHEN t1 THEN 'high' WHEN t2 THEN 'medium' ELSE 'low' END AS risk_fallback
FROM t""")
def risk_all_undefined(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("p"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("r"))
    spec = Spec.from_entries([
        {"name": f"risk_{policy}", "inputs": ["p", "r"], "rule_kind": "risk_score",
         "rule_body": {**_tiers("p", "r"), "null_handling": policy}} for policy in ("null", "fallback")])
    return apply_spec(df, spec).df.select("o_orderkey", *spec.names())


FLAGSHIP = Spec.from_entries([
    {"name": "QTY_GROUP", "inputs": ["l_quantity"], "rule_kind": "bin", "rule_body": QTY},
    {"name": "RETURN_FLAG", "inputs": ["l_returnflag"], "rule_kind": "flag",
     "rule_body": {"map": {"R": "Y", "N": "N"}, "unmapped_handling": "value", "unmapped_value": "U"}},
    {"name": "SHIP_DAYS", "inputs": ["o_orderdate", "l_shipdate"], "rule_kind": "duration",
     "rule_body": {"start_column": "o_orderdate", "end_column": "l_shipdate"}},
    {"name": "POP_FLAG", "inputs": ["l_quantity"], "rule_kind": "compound",
     "rule_body": {"conditions": [_cond("l_quantity", ">=", 5), _cond("SHIP_DAYS", ">=", 7)]}},
    {"name": "RISK", "inputs": ["l_quantity", "l_discount"], "rule_kind": "risk_score",
     "rule_body": {"tiers": [
         {"label": "high", "conditions": [_cond("POP_FLAG", "==", "Y"), _cond("l_discount", ">=", 0.08)]},
         {"label": "medium", "combinator": "or",
          "conditions": [_cond("QTY_GROUP", "==", "bulk"), _cond("l_discount", ">=", 0.08)]}],
         "fallback_label": "low"}},
])

FLAGSHIP_SQL = """
b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag,
             CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 25 THEN 'medium' WHEN l_quantity < 40 THEN 'large'
                  ELSE 'bulk' END AS "QTY_GROUP",
             CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'N' THEN 'N' ELSE 'U' END AS "RETURN_FLAG",
             CAST(epoch(l_shipdate - o_orderdate) / 86400 AS BIGINT) AS "SHIP_DAYS"
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT *, CASE WHEN l_quantity >= 5 AND "SHIP_DAYS" >= 7 THEN 'Y' ELSE 'N' END AS "POP_FLAG" FROM b),
d AS (SELECT *, CASE WHEN "POP_FLAG" = 'Y' AND l_discount >= 0.08 THEN 'high'
                     WHEN "QTY_GROUP" = 'bulk' OR l_discount >= 0.08 THEN 'medium' ELSE 'low' END AS "RISK" FROM p)
"""


def flagship(spark: SparkSession, folder: str, **options) -> Derived:
    """Five derivations, three dependency levels, over the join of line items and orders."""
    return apply_spec(shipped(spark, folder), FLAGSHIP, integral=options.pop("integral", "always"), **options)


@query("spec_apply_chain", f"""
WITH {FLAGSHIP_SQL}
SELECT l_orderkey, l_linenumber, "QTY_GROUP", "RETURN_FLAG", "SHIP_DAYS", "POP_FLAG", "RISK" FROM d""")
def spec_apply_chain(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder).df.select("l_orderkey", "l_linenumber", *FLAGSHIP.names())


@query("label_distribution", f"""
WITH {FLAGSHIP_SQL}
SELECT 'QTY_GROUP' AS target, "QTY_GROUP" AS label, count(*) AS n_rows FROM d GROUP BY ALL
UNION ALL SELECT 'RETURN_FLAG', "RETURN_FLAG", count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'POP_FLAG', "POP_FLAG", count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'RISK', "RISK", count(*) FROM d GROUP BY ALL""")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    from rulefold.operators.verify import label_distribution as distribution

    return distribution(flagship(spark, folder).df, ["QTY_GROUP", "RETURN_FLAG", "POP_FLAG", "RISK"])


@query("spec_skip_downstream", """
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS "PRICE_GROUP",
       'PRICE_GROUP:verified,PRIO_FLAG:unresolved,PRIO_POP:skipped' AS outcomes
FROM orders""")
def spec_skip_downstream(spark: SparkSession, folder: str) -> DataFrame:
    spec = Spec.from_entries([
        {"name": "PRIO_FLAG", "inputs": ["o_orderpriority"], "rule_kind": "flag",
         "rule_body": {"map": {"1-URGENT": "Y"}, "unmapped_handling": "error"}},
        {"name": "PRIO_POP", "inputs": ["PRIO_FLAG"], "rule_kind": "compound",
         "rule_body": {"conditions": [_cond("PRIO_FLAG", "==", "Y")]}},
        {"name": "PRICE_GROUP", "inputs": ["o_totalprice"], "rule_kind": "bin",
         "rule_body": {"edges": [100000], "labels": ["low", "high"]}},
    ])
    done = apply_spec(table(spark, folder, "orders"), spec, on_error="skip")
    shown = ",".join(f"{n}:{o.status}" for n, o in sorted(done.outcomes.items()))
    return done.df.select(
        "o_orderkey", *[n for n in spec.names() if n in done.df.columns], F.lit(shown).alias("outcomes"))


@query("explain_trace", """
WITH o AS (SELECT o_orderkey, o_totalprice AS p, nullif(o_orderstatus, 'P') AS s FROM orders)
SELECT o_orderkey,
       CAST(p AS VARCHAR) || CASE WHEN p < 100000 THEN ' is below 100000.0: low'
            WHEN p < 300000 THEN ' is 100000.0 to under 300000.0: mid' ELSE ' is 300000.0 and above: top' END AS bin_why,
       CASE WHEN s IS NULL THEN 'missing value: null handling' WHEN s = 'F' THEN 'mapping F: done'
            ELSE s || ' is not in the mapping: fallback U' END AS flag_why,
       CASE WHEN p >= 300000 AND s = 'F' THEN 'first matching tier: high'
            WHEN p >= 300000 OR s = 'F' THEN 'first matching tier: medium'
            WHEN s IS NULL AND (p >= 300000 AND s = 'F') IS NULL AND (p >= 300000 OR s = 'F') IS NULL
                 THEN 'no tier resolved: null handling null'
            ELSE 'no tier matched: fallback low' END AS risk_why,
       CASE WHEN p >= 300000 AND s = 'F' THEN 1 WHEN p >= 300000 OR s = 'F' THEN 2 END AS risk_tier,
       'p >= 300000 AND s not_null: ' || CASE WHEN p >= 300000 AND s IS NOT NULL THEN 'true' ELSE 'false' END AS pop_why
FROM o""")
def explain_trace(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("p"), F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    spec = Spec.from_entries([
        {"name": "bin", "inputs": ["p"], "rule_kind": "bin",
         "rule_body": {"edges": [100000, 300000], "labels": ["low", "mid", "top"]}},
        {"name": "flag", "inputs": ["s"], "rule_kind": "flag",
         "rule_body": {"map": {"F": "done"}, "unmapped_handling": "value", "unmapped_value": "U"}},
        {"name": "risk", "inputs": ["p", "s"], "rule_kind": "risk_score",
         "rule_body": {"null_handling": "null", "fallback_label": "low", "tiers": [
             {"label": "high", "conditions": [_cond("p", ">=", 300000), _cond("s", "==", "F")]},
             {"label": "medium", "combinator": "or", "conditions": [_cond("p", ">=", 300000), _cond("s", "==", "F")]}]}},
        {"name": "pop", "inputs": ["p", "s"], "rule_kind": "compound",
         "rule_body": {"conditions": [_cond("p", ">=", 300000), _cond("s", "not_null")]}},
    ])
    done = apply_spec(df, spec, explain=True).df
    whys = [F.col(f"{n}__why").alias(f"{n}_why") for n in ("bin", "flag", "risk", "pop")]
    return done.select("o_orderkey", F.col("risk__tier").alias("risk_tier"), *whys)


@query("explain_duration", """
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || ' - ' || strftime(o_orderdate, '%Y-%m-%d') || ' = '
       || CAST(CAST(epoch(l_shipdate - o_orderdate) / 86400 AS BIGINT) AS VARCHAR) || ' days: '
       || CAST(CAST(CAST(epoch(l_shipdate - o_orderdate) / 86400 AS BIGINT) AS DOUBLE) AS VARCHAR) || ' days' AS why
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def explain_duration(spark: SparkSession, folder: str) -> DataFrame:
    body = {"start_column": "o_orderdate", "end_column": "l_shipdate"}
    df = apply_rule(shipped(spark, folder), "d", "duration", body, integral="never", explain=True)
    return df.select("l_orderkey", "l_linenumber", F.col("d__why").alias("why"))


@query("policy_blocked_counts", """
WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s, o_orderpriority AS r,
                  CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS p FROM orders)
SELECT 'B' AS derivation, 'null' AS policy, count(*) FILTER (p IS NULL) AS n_blocked, count(*) AS n_rows FROM o
UNION ALL SELECT 'F', 'null', count(*) FILTER (s IS NULL), count(*) FROM o
UNION ALL SELECT 'F', 'unmapped', count(*) FILTER (s IS NOT NULL AND s <> 'F'), count(*) FROM o
UNION ALL SELECT 'C', 'null', count(*) FILTER ((p >= 200000 AND s = 'F') IS NULL), count(*) FROM o
UNION ALL SELECT 'R', 'null', count(*) FILTER ((p >= 200000) IS NULL AND (s = 'F') IS NULL), count(*) FROM o
UNION ALL SELECT 'D', 'null', count(*) FILTER (o_orderstatus = 'O' OR o_orderstatus IS NULL), count(*) FROM orders""")
def policy_blocked_counts(spark: SparkSession, folder: str) -> DataFrame:
    df, blocked = _strict_orders(spark, folder, with_duration=True)
    items = [(n, p, c) for n, by in blocked.items() for p, c in by.items()]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(items)])
    cells = [F.struct(F.lit(n).alias("derivation"), F.lit(p).alias("policy"), F.col(f"c{i}").alias("n_blocked"),
                      F.col("n").alias("n_rows")) for i, (n, p, _) in enumerate(items)]
    return row.select(F.inline(F.array(*cells)))


def _strict_orders(spark: SparkSession, folder: str, with_duration: bool = False):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "O", F.date_add("o_orderdate", F.lit(9))).alias("closed"), F.expr("nullif(o_orderstatus, 'P')").alias("s"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("p"))
    bodies = {
        "B": ("bin", "p", {"edges": [1], "labels": ["a", "b"], "null_handling": "error"}),
        "F": ("flag", "s", {"map": {"F": "done"}, "null_handling": "error", "unmapped_handling": "error"}),
        "C": ("compound", None, {"conditions": [_cond("p", ">=", 200000), _cond("s", "==", "F")], "null_handling": "error"}),
        "R": ("risk_score", None, {"tiers": [{"label": "a", "conditions": [_cond("p", ">=", 200000)]},
                                             {"label": "b", "conditions": [_cond("s", "==", "F")]}],
                                   "fallback_label": "c", "null_handling": "error"}),
    }
    if with_duration:
        bodies["D"] = ("duration", None, {"start_column": "o_orderdate", "end_column": "closed", "null_handling": "error"})
    scope = Scope(df.schema)
    rules = {n: rule_kind(k).build(scope, src, rule_kind(k).body.parse(b)) for n, (k, src, b) in bodies.items()}
    return df, {n: r.blocked for n, r in rules.items()}


@query("quarantine_split", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s,
                  CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS p FROM orders),
     v AS (SELECT o_orderkey, concat_ws(',', CASE WHEN p IS NULL THEN 'B:null' END,
                  CASE WHEN (p >= 200000 AND s = 'F') IS NULL THEN 'C:null' END,
                  CASE WHEN s IS NULL THEN 'F:null' END,
                  CASE WHEN s IS NOT NULL AND s <> 'F' THEN 'F:unmapped' END,
                  CASE WHEN (p >= 200000) IS NULL AND (s = 'F') IS NULL THEN 'R:null' END) AS violations FROM o)
SELECT o_orderkey, violations, violations = '' AS accepted FROM v""")
def quarantine_split(spark: SparkSession, folder: str) -> DataFrame:
    df, blocked = _strict_orders(spark, folder)
    marked = quarantine(df, blocked)
    return marked.select(
        "o_orderkey", F.array_join("_violations", ",").alias("violations"), (F.size("_violations") == 0).alias("accepted"))
