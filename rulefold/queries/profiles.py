"""Profiles and proposals over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators.profile import merged_profile, profile, profile_states, redacted, sample_values
from rulefold.operators.propose import accepted_entries, add_extras, propose
from rulefold.queries import query
from rulefold.session import fresh_folder, table
from rulefold.sources.delimited import column_overview, preview

def _values():
    return F.array_join("values", "|").alias("values")


def _profile_sql(tbl: str, columns: list[tuple[str, str, str]]) -> str:
    """SQL profile of a table: (column expression, kind, dtype) in position order."""
    parts = []
    for i, (c, kind, dtype) in enumerate(columns):
        lo, hi = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if kind == "numeric" else ("NULL::DOUBLE",) * 2
        values = f"string_agg(DISTINCT {c}, '|' ORDER BY {c})" if kind == "low_cardinality" else "NULL::VARCHAR"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{kind}' AS kind, '{dtype}' AS dtype, "
            f"(count(*) - count({c})) / count(*) AS null_fraction, count(DISTINCT {c}) AS n_unique, "
            f"{lo} AS min, {hi} AS max, {values} AS \"values\" FROM {tbl}")
    return " UNION ALL ".join(parts)


ORDERS = [
    ("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"), ("o_orderstatus", "low_cardinality", "string"),
    ("o_totalprice", "numeric", "double"), ("o_orderdate", "date", "timestamp_ntz"),
    ("o_orderpriority", "low_cardinality", "string")]


@query("profile_orders", _profile_sql("orders", ORDERS))
def profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "orders")).select(
        "column", "position", "kind", "dtype", "null_fraction", "n_unique", "min", "max", _values())


@query("profile_documents", _profile_sql("documents", [
    ("doc_id", "numeric", "bigint"), ("text", "high_cardinality", "string"), ("lang", "low_cardinality", "string"),
    ("source", "low_cardinality", "string"), ("n_chars", "numeric", "bigint")]))
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "documents")).select(
        "column", "position", "kind", "dtype", "null_fraction", "n_unique", "min", "max", _values())


GAPS = """(SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS quantity,
  nullif(l_linestatus, 'F') AS line_status, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, NULL::VARCHAR AS nothing,
  strftime(l_shipdate, '%Y-%m-%d') AS note, l_discount > 0.05 AS discounted FROM lineitem) g"""


@query("profile_classify", _profile_sql(GAPS, [
    ("l_orderkey", "numeric", "bigint"), ("quantity", "numeric", "double"), ("line_status", "low_cardinality", "string"),
    ("ship_date", "date", "string"), ("nothing", "unknown", "string"), ("note", "high_cardinality", "string"),
    ("discounted", "numeric", "boolean")]))
def profile_classify(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
        F.expr("nullif(l_linestatus, 'F')").alias("line_status"), day.alias("ship_date"),
        F.lit(None).cast("string").alias("nothing"), day.alias("note"), (F.col("l_discount") > 0.05).alias("discounted"))
    return profile(df).select(
        "column", "position", "kind", "dtype", "null_fraction", "n_unique", "min", "max", _values())


@query("profile_redacted", f"""
WITH p AS ({_profile_sql("orders", ORDERS)})
SELECT "column", kind, round_even(null_fraction, 2) AS null_fraction, n_unique, min, max,
       CASE WHEN n_unique <= 6 THEN "values" END AS "values" FROM p""")
def profile_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(profile(table(spark, folder, "orders"))).select(
        "column", "kind", "null_fraction", "n_unique", "min", "max", _values())


CLINICAL_SQL = """v AS (SELECT l_quantity + 10 AS age, l_returnflag AS response, l_linestatus AS status,
  l_extendedprice AS lab_value, o_orderdate AS treatment_start_date, l_shipdate AS visit_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT min(age) AS lo, max(age) AS hi, max(lab_value) AS top FROM v)"""


def clinical(spark: SparkSession, folder: str) -> DataFrame:
    """Line items and orders under names that the proposal patterns know."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_quantity") + 10).alias("age"), F.col("l_returnflag").alias("response"),
        F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("lab_value"),
        F.col("o_orderdate").alias("treatment_start_date"), F.col("l_shipdate").alias("visit_date"))


PROPOSALS_SQL = CLINICAL_SQL + """,
f AS (SELECT c, '{"map":{' || string_agg('"' || x || '":"' || CASE lower(x) WHEN 'n' THEN 'N' WHEN 'y' THEN 'Y'
        ELSE substr(upper(x), 1, 3) END || '"', ',' ORDER BY x) || '},"unmapped_handling":"value","unmapped_value":"U"}' AS body
      FROM (SELECT DISTINCT 'response' AS c, response AS x FROM v UNION ALL SELECT DISTINCT 'status', status FROM v)
      GROUP BY c),
p AS (
SELECT 'AGE_GROUP' AS name, 'age' AS inputs, 'bin' AS rule_kind,
       '{"edges":[' || concat_ws(',', CASE WHEN lo < 18 THEN '18.0' END, CASE WHEN hi >= 65 THEN '65.0' END) || '],"labels":['
       || concat_ws(',', CASE WHEN lo < 18 THEN '"minor"' END, '"adult"', CASE WHEN hi >= 65 THEN '"senior"' END) || ']}'
       AS rule_body, 0.9::DOUBLE AS confidence, 'Strong' AS band, 1 AS place FROM s
UNION ALL SELECT upper(c) || '_FLAG', c, 'flag', body, 0.85, 'Likely', CASE c WHEN 'response' THEN 2 ELSE 3 END FROM f
UNION ALL SELECT 'TREATMENT_DURATION', 'treatment_start_date,visit_date', 'duration',
  '{"start_column":"treatment_start_date","end_column":"visit_date","unit":"days","null_handling":"null"}', 0.8, 'Likely', 4
UNION ALL SELECT 'ANALYSIS_POP_FLAG', 'age,response', 'compound',
  '{"conditions":[{"column":"age","op":">=","value":18},{"column":"response","op":"not_null"}],"combinator":"and",'
  || '"true_value":"Y","false_value":"N","null_handling":"false"}', 0.7, 'Likely', 5
UNION ALL SELECT 'RISK_GROUP', 'age,lab_value', 'risk_score',
  '{"tiers":[{"label":"high","combinator":"and","conditions":[{"column":"age","op":">=","value":' || old
  || '},{"column":"lab_value","op":">=","value":' || round_even(top * 0.75, 0) || '}]},{"label":"medium","combinator":"or",'
  || '"conditions":[{"column":"lab_value","op":">=","value":' || round_even(top * 0.5, 0)
  || '},{"column":"age","op":">=","value":' || old || '}]}],"fallback_label":"low","null_handling":"fallback"}',
  0.55, 'Tentative', 6
  FROM (SELECT *, CASE WHEN hi >= 65 THEN 65.0::DOUBLE ELSE round_even(hi * 0.8, 0) END AS old FROM s))"""


@query("propose_all", f"WITH {PROPOSALS_SQL} SELECT * FROM p")
def propose_all(spark: SparkSession, folder: str) -> DataFrame:
    proposals = propose(profile(clinical(spark, folder), "clinical", exact=False))
    return proposals.select(
        "name", F.array_join("inputs", ",").alias("inputs"), "rule_kind", "rule_body", "confidence", "band", "place")


@query("propose_accepted", f"""
WITH {PROPOSALS_SQL}
SELECT 'clinical' AS study_id, CASE name WHEN 'AGE_GROUP' THEN 'AGEGR1' ELSE name END AS name, inputs, rule_kind, rule_body
FROM p WHERE name IN ('AGE_GROUP', 'RISK_GROUP', 'STATUS_FLAG')""")
def propose_accepted(spark: SparkSession, folder: str) -> DataFrame:
    proposals = propose(profile(clinical(spark, folder), "clinical", exact=False))
    accepted = spark.createDataFrame(
        [("clinical", "AGE_GROUP", "AGEGR1"), ("clinical", "RISK_GROUP", None), ("clinical", "STATUS_FLAG", None)],
        "dataset string, name string, new_name string")
    return accepted_entries(proposals, accepted).select(
        "study_id", "name", F.array_join("inputs", ",").alias("inputs"), "rule_kind", "rule_body")


@query("propose_extras", f"""
WITH {PROPOSALS_SQL}
SELECT name, rule_kind, rule_body FROM p
UNION ALL SELECT 'COUNTRY_FLAG', 'flag', '{{"map":{{' || string_agg('"' || n_name || '":"' || n_regionkey || '"', ',' ORDER BY n_name) || '}}}}' FROM nation""")
def propose_extras(spark: SparkSession, folder: str) -> DataFrame:
    proposals = propose(profile(clinical(spark, folder), "clinical", exact=False))
    named = F.array_sort(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string"))))
    home = table(spark, folder, "nation").agg(F.map_from_entries(named).alias("map"))
    body = F.to_json(F.struct("map"))
    extras = home.select(
        F.lit("clinical").alias("dataset"), F.explode(F.array(F.lit("COUNTRY_FLAG"), F.lit("AGE_GROUP"))).alias("name"),
        F.lit("flag").alias("rule_kind"), body.alias("rule_body"))
    return add_extras(proposals, extras).select("name", "rule_kind", "rule_body")


SAMPLES_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type, value,
                  CASE WHEN value > 100 THEN user_id END AS user_id FROM events),
l AS (SELECT event_id, 'event_type' AS "column", event_type AS v FROM e
      UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR) FROM e
      UNION ALL SELECT event_id, 'event_id', CAST(event_id AS VARCHAR) FROM e
      UNION ALL SELECT event_id, 'pair', '{"pair":{"e":' || event_id || ',"v":[' || event_id % 7 || ',1]}}' FROM e
      UNION ALL SELECT event_id, 'user_id', CAST(user_id AS VARCHAR) FROM e),
s AS (SELECT "column", CAST(row_number() OVER w AS INTEGER) AS place, v AS value FROM l WHERE v IS NOT NULL
      WINDOW w AS (PARTITION BY "column" ORDER BY event_id) QUALIFY row_number() OVER w <= 5)
"""


def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), "value",
        F.when(F.col("value") > 100, F.col("user_id")).alias("user_id"),
        F.struct(F.col("event_id").alias("e"), F.array(F.col("event_id") % 7, F.lit(1)).alias("v")).alias("pair"))


@query("sample_values", SAMPLES_SQL + 'SELECT "column", place, value FROM s')
def samples(spark: SparkSession, folder: str) -> DataFrame:
    return sample_values(_sampled(spark, folder), "event_id")


@query("profile_samples", SAMPLES_SQL + """SELECT "column", kind, string_agg(value, '|' ORDER BY place) AS sample_values
FROM s JOIN (VALUES ('event_id', 'numeric'), ('event_type', 'low_cardinality'), ('value', 'numeric'), ('user_id', 'numeric'), ('pair', 'nested')) k("column", kind)
USING ("column") GROUP BY ALL""")
def profile_samples(spark: SparkSession, folder: str) -> DataFrame:
    return profile(_sampled(spark, folder), key="event_id", exact=False).select("column", "kind", F.array_join("sample_values", "|").alias("sample_values"))


@query("profile_merged", f"""
SELECT "column", position, kind, dtype, null_fraction, CASE WHEN kind = 'low_cardinality' THEN n_unique END AS n_unique, true AS estimate_close, min, max, "values"
FROM ({_profile_sql("orders", ORDERS)})""")
def profile_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of orders from stored states of three parts, one of them stored twice; estimates are held against exact counts."""
    orders = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    path = fresh_folder(spark, "profile-states")
    for part, rows in (("early", year < 1995), ("late", year >= 1996), ("middle", year == 1995), ("late", year >= 1996)):
        profile_states(orders.where(rows), part).write.mode("append").parquet(path)
    exact = profile(orders).select("column", F.col("n_unique").alias("exact"))
    return merged_profile(spark.read.parquet(path)).join(exact, "column").select(
        "column", "position", "kind", "dtype", "null_fraction", F.when(F.col("kind") == "low_cardinality", F.col("n_unique")).alias("n_unique"),
        (F.abs(F.col("n_unique") - F.col("exact")) <= 0.05 * F.col("exact")).alias("estimate_close"), "min", "max", _values())


@query("dataset_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 20""")
def dataset_preview(spark: SparkSession, folder: str) -> DataFrame:
    return preview(table(spark, folder, "orders"), "o_orderkey").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("column_overview", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price,
                  nullif(o_orderstatus, 'P') AS status FROM orders)
SELECT 'o_orderkey' AS "column", 'bigint' AS detected, count(o_orderkey) AS non_null,
       CAST(min(o_orderkey) AS VARCHAR) AS sample FROM o
UNION ALL SELECT 'price', 'double', count(price), CAST(arg_min(price, o_orderkey) FILTER (price IS NOT NULL) AS VARCHAR) FROM o
UNION ALL SELECT 'status', 'string', count(status), arg_min(status, o_orderkey) FILTER (status IS NOT NULL) FROM o""")
def overview(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
        F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return column_overview(df, "o_orderkey").drop("position")
