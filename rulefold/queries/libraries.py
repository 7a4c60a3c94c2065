"""Rule libraries derived from the parts table: linting, normalising, patching, probing, impact, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.operators import library as lib
from rulefold.operators.lineage import impact, lineage_edges, missing_sources
from rulefold.operators.triage import suggest_kinds, suggest_terms, top_per_group, with_keyword_kind
from rulefold.queries import query
from rulefold.session import table

# Each part becomes one entry; eight entries form a study and refer to each other. These expressions mean the
# same in both SQL dialects. Sizes that are multiples of small numbers carry a planted mistake.
K = "p_partkey % 8"
N = "CAST(p_size AS STRING)"
ENTRY = {
    "study_id": "'study-' || CAST(p_partkey - p_partkey % 8 AS STRING)",
    "name": f"CASE WHEN p_size = 13 THEN ' ' WHEN {K} = 7 AND p_size % 11 = 0 THEN 'D0' "
            f"ELSE 'D' || CAST({K} AS STRING) END",
    "inputs_csv": f"CASE {K} WHEN 0 THEN 'p_size' WHEN 1 THEN 'p_type' WHEN 2 THEN 'd1,d2' WHEN 3 THEN 'p_size' "
                  f"WHEN 4 THEN 'p_size' WHEN 5 THEN 'D2' WHEN 6 THEN 'D4' ELSE CASE WHEN p_size % 5 = 0 THEN 'gone' "
                  f"ELSE 'p_retailprice' END END",
    "rule_kind": f"CASE {K} WHEN 1 THEN 'flag' WHEN 2 THEN 'duration' WHEN 3 THEN 'compound' WHEN 4 THEN 'risk_score' "
                 f"WHEN 6 THEN CASE WHEN p_size % 7 = 0 THEN 'flagg' ELSE 'flag' END ELSE 'bin' END",
    "rule_body": f"CASE {K} "
        f"WHEN 1 THEN '{{\"map\":{{' || CASE WHEN p_size % 9 = 0 THEN '' ELSE '\"zz\":\"N\",\"' || p_type || '\":\"Y\"' END || '}}' "
        f"|| CASE WHEN p_size % 4 = 0 THEN ',\"unmapped_handling\":\"value\"' WHEN p_size % 4 = 1 "
        f"THEN ',\"unmapped_handling\":\"value\",\"unmapped_value\":\"U\"' ELSE '' END || '}}' "
        f"WHEN 2 THEN '{{\"start_column\":\"d1\",\"end_column\":\"' || CASE WHEN p_size % 8 = 0 THEN 'd1' ELSE 'd2' END || '\"' "
        f"|| CASE WHEN p_size % 7 = 0 THEN ',\"unit\":\"hours\"' WHEN p_size % 7 = 1 THEN ',\"unit\":\"weeks\"' ELSE '' END || '}}' "
        f"WHEN 3 THEN '{{\"conditions\":[{{\"column\":\"p_size\",\"op\":\">=\",\"value\":' || {N} || '}},{{\"column\":\"D0\",\"op\":\"' "
        f"|| CASE WHEN p_size % 6 = 0 THEN 'in' ELSE '==' END || '\",\"value\":\"lo\"}}]}}' "
        f"WHEN 4 THEN '{{\"tiers\":[{{\"label\":\"high\",\"conditions\":[{{\"column\":\"D3\",\"op\":\"==\",\"value\":\"Y\"}}]}},{{\"label\":\"' "
        f"|| CASE WHEN p_size % 5 = 0 THEN 'high' ELSE 'mid' END || '\",\"combinator\":\"or\",\"conditions\":[{{\"column\":\"D1\",\"op\":' "
        f"|| CASE WHEN p_size % 6 = 1 THEN '\"not_null\",\"value\":1' ELSE '\"not_null\"' END || '}}]}}],\"fallback_label\":\"' "
        f"|| CASE WHEN p_size % 10 = 3 THEN '' ELSE 'low' END || '\"}}' "
        f"WHEN 6 THEN '{{\"map\":{{\"high\":\"H\",\"low\":\"L\"}},\"null_handling\":\"error\"}}' "
        f"ELSE '{{\"edges\":[' || CASE WHEN p_size % 5 = 1 THEN '\"' || {N} || '\"' ELSE {N} END || ',' "
        f"|| CAST(p_size + p_size % 3 AS STRING) || '],\"labels\":[\"lo\",\"mid\"' "
        f"|| CASE WHEN p_size % 10 = 9 THEN '' WHEN p_size % 4 = 0 THEN ',\"mid\"' ELSE ',\"hi\"' END || ']' "
        f"|| CASE p_size % 6 WHEN 0 THEN ',\"null_handling\":\"label\"' WHEN 1 THEN ',\"null_handling\":\"label\",\"null_label\":\"none\"' "
        f"WHEN 2 THEN ',\"null_label\":\"none\"' ELSE '' END "
        f"|| CASE WHEN p_size % 17 = 0 THEN ',\"closed\":\"left\"' ELSE '' END || '}}' END",
    "rationale": "'rule for ' || p_name",
    "ambiguity_notes": "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'value unknown in ' || p_name "
                       "ELSE 'Missing or NULL for ' || p_name END",
}
ENTRY["rule_body"] = ENTRY["rule_body"].replace("{{", "{").replace("}}", "}")
# The same bodies with the keys of every object in order, for signatures.
SORTED_BODY = f"CASE {K} " \
    f"WHEN 1 THEN '{{\"map\":{{' || CASE WHEN p_size % 9 = 0 THEN '' ELSE '\"' || p_type || '\":\"Y\",\"zz\":\"N\"' END || '}}' " \
    f"|| CASE WHEN p_size % 4 = 0 THEN ',\"unmapped_handling\":\"value\"' WHEN p_size % 4 = 1 " \
    f"THEN ',\"unmapped_handling\":\"value\",\"unmapped_value\":\"U\"' ELSE '' END || '}}' " \
    f"WHEN 2 THEN '{{\"end_column\":\"' || CASE WHEN p_size % 8 = 0 THEN 'd1' ELSE 'd2' END || '\",\"start_column\":\"d1\"' " \
    f"|| CASE WHEN p_size % 7 = 0 THEN ',\"unit\":\"hours\"' WHEN p_size % 7 = 1 THEN ',\"unit\":\"weeks\"' ELSE '' END || '}}' " \
    f"WHEN 4 THEN '{{\"fallback_label\":\"' || CASE WHEN p_size % 10 = 3 THEN '' ELSE 'low' END || " \
    f"'\",\"tiers\":[{{\"conditions\":[{{\"column\":\"D3\",\"op\":\"==\",\"value\":\"Y\"}}],\"label\":\"high\"}}," \
    f"{{\"combinator\":\"or\",\"conditions\":[{{\"column\":\"D1\",\"op\":' || CASE WHEN p_size % 6 = 1 THEN '\"not_null\",\"value\":1' " \
    f"ELSE '\"not_null\"' END || '}}],\"label\":\"' || CASE WHEN p_size % 5 = 0 THEN 'high' ELSE 'mid' END || '\"}}]}}' " \
    f"WHEN 3 THEN rule_body WHEN 6 THEN rule_body ELSE CASE WHEN p_size % 17 = 0 THEN '{{\"closed\":\"left\",' || " \
    f"substr(replace(rule_body, ',\"closed\":\"left\"', ''), 2) ELSE rule_body END END"
SORTED_BODY = SORTED_BODY.replace("{{", "{").replace("}}", "}")
LIBRARY_SQL = "l AS (SELECT p_partkey, p_size, p_type, p_name, p_brand, p_partkey % 8 AS k, " + ", ".join(
    f"{e} AS {a}" for a, e in ENTRY.items()) + " FROM part)"


def library(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The derived `spec_entries` table."""
    rows = table(spark, folder, "part").selectExpr(*more, *[f"{e} AS {a}" for a, e in ENTRY.items()])
    return rows.select(
        *more, "study_id", "name", F.split("inputs_csv", ",").alias("inputs"), "rule_kind", "rule_body", "rationale",
        "ambiguity_notes")


# Planted mistakes by construction: (property, condition on the part).
MISTAKES = [
    ("entry.name_blank", "p_size = 13"),
    ("entry.kind_unknown", "k = 6 AND p_size % 7 = 0"),
    ("bin.edges_increasing", "k IN (0,5,7) AND p_size % 3 = 0"),
    ("bin.labels_unique", "k IN (0,5,7) AND p_size % 4 = 0"),
    ("bin.labels_match_edges", "k IN (0,5,7) AND p_size % 10 = 9"),
    ("bin.null_label", "k IN (0,5,7) AND p_size % 6 IN (0, 2)"),
    ("bin.unknown_fields", "k IN (0,5,7) AND p_size % 17 = 0"),
    ("flag.map_present", "k = 1 AND p_size % 9 = 0"),
    ("flag.unmapped_value", "k = 1 AND p_size % 4 = 0"),
    ("duration.columns_distinct", "k = 2 AND p_size % 8 = 0"),
    ("duration.unit", "k = 2 AND p_size % 7 = 0"),
    ("compound.condition_values", "k = 3 AND p_size % 6 = 0"),
    ("risk_score.labels_unique", "k = 4 AND p_size % 5 = 0"),
    ("risk_score.condition_values", "k = 4 AND p_size % 6 = 1"),
    ("risk_score.fallback_present", "k = 4 AND p_size % 10 = 3"),
]
MISTAKES_SQL = " UNION ALL ".join(
    f"SELECT study_id, name AS derivation, '{p}' AS property_id FROM l WHERE {c}" for p, c in MISTAKES)
BROKEN = " OR ".join(f"({c})" for p, c in MISTAKES if not p.startswith("entry.name"))


@query("library_lint", f"""
WITH {LIBRARY_SQL} {MISTAKES_SQL}
UNION ALL SELECT study_id, name, 'entry.name_unique' FROM l GROUP BY study_id, name HAVING count(*) > 1""")
def library_lint(spark: SparkSession, folder: str) -> DataFrame:
    return lib.lint(library(spark, folder))


_E = "CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(p_size + p_size % 3 AS DOUBLE) AS VARCHAR)"
CANONICAL = f"""CASE
  WHEN k = 1 THEN '{{"map":{{' || CASE WHEN p_type < 'zz' THEN '"' || p_type || '":"Y","zz":"N"' ELSE '"zz":"N","' || p_type || '":"Y"' END
    || '}},"null_handling":"null","null_value":null,' || CASE WHEN p_size % 4 = 1
       THEN '"unmapped_handling":"value","unmapped_value":"U"}}' ELSE '"unmapped_handling":"null","unmapped_value":null}}' END
  WHEN k = 2 THEN '{{"end_column":"d2","null_handling":"null","start_column":"d1","unit":"'
    || CASE WHEN p_size % 7 = 1 THEN 'weeks' ELSE 'days' END || '"}}'
  WHEN k = 3 THEN '{{"combinator":"and","conditions":[{{"column":"p_size","op":">=","value":' || p_size
    || '}},{{"column":"D0","op":"==","value":"lo"}}],"false_value":"N","null_handling":"false","true_value":"Y"}}'
  WHEN k = 4 THEN '{{"fallback_label":"low","null_handling":"fallback","tiers":[{{"combinator":"and","conditions":'
    || '[{{"column":"D3","op":"==","value":"Y"}}],"label":"high"}},{{"combinator":"or","conditions":[{{"column":"D1","op":"not_null",'
    || '"value":null}}],"label":"mid"}}]}}'
  WHEN k = 6 THEN '{{"map":{{"high":"H","low":"L"}},"null_handling":"error","null_value":null,"unmapped_handling":"null",'
    || '"unmapped_value":null}}'
  ELSE '{{"edges":[' || {_E} || '],"labels":["lo","mid","hi"],"null_handling":' || CASE WHEN p_size % 6 = 1 THEN
    '"label","null_label":"none"}}' ELSE '"null","null_label":null}}' END END"""
NORMAL_SQL = f"""{LIBRARY_SQL},
n AS (SELECT *, CASE WHEN {BROKEN} THEN 'no_match' ELSE 'match' END AS outcome,
             CASE WHEN NOT ({BROKEN}) THEN {CANONICAL} END AS body FROM l)"""


@query("library_normalise", f"""
WITH {NORMAL_SQL}
SELECT p_partkey, study_id, outcome, body, left(sha256(body), 16) AS body_signature FROM n""")
def library_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return lib.normalise(library(spark, folder, "p_partkey")).select(
        "p_partkey", "study_id", "outcome", "body", "body_signature")


@query("signature_body", """
SELECT s_suppkey, left(sha256('{"edges":[' || CAST(CAST(s_nationkey AS DOUBLE) AS VARCHAR) || ',65.0],"labels":["a","b","'
       || s_name || '"],"null_handling":"null","null_label":null}'), 16) AS body_signature FROM supplier""")
def signature_body(spark: SparkSession, folder: str) -> DataFrame:
    from rulefold.functions.signatures import signature

    return table(spark, folder, "supplier").select(
        "s_suppkey",
        signature(
            edges=F.array(F.col("s_nationkey").cast("double"), F.lit(65.0)),
            labels=F.array(F.lit("a"), F.lit("b"), F.col("s_name")), null_handling=F.lit("null"),
            null_label=F.lit(None).cast("string")).alias("body_signature"))


# Fixes and patches address an entry by name, so here every entry gets its own.
OWN_NAME = "'E' || CAST(p_partkey AS STRING)"


def named_library(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return library(spark, folder, "p_partkey", *more).withColumn("name", F.expr(OWN_NAME))


@query("spec_patch", f"""
WITH {LIBRARY_SQL}
SELECT p_partkey, CASE WHEN k = 2 AND p_size % 2 = 0 THEN '{{"end_column":"' || CASE WHEN p_size % 8 = 0 THEN 'd1' ELSE 'd2' END
              || '","start_column":"d1","unit":"years"}}'
       WHEN k = 6 AND p_size % 2 = 0 THEN '{{"map":{{"high":"H","low":"L"}},"null_handling":null,"unmapped_handling":"null"}}'
       WHEN k = 3 AND p_size % 2 = 0 THEN '{{"combinator":"or",' || substr(rule_body, 2) ELSE rule_body END AS rule_body
FROM l""")
def spec_patch(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions replace single body fields; an empty or absent patch leaves the entry as it is."""
    entries = named_library(spark, folder, "p_size")
    kind = F.col("p_partkey") % 8
    patches = entries.select(
        "study_id", "name",
        F.when(F.col("p_size") % 2 == 1, F.lit(None).cast("string"))
        .when(kind == 2, F.lit('{"unit":"years"}'))
        .when(kind == 6, F.lit('{"unmapped_handling":"null","null_handling":null}'))
        .when(kind == 3, F.lit('{"combinator":"or"}')).otherwise(F.lit("{}")).alias("body_patch"))
    return lib.patch_entries(entries, patches).select("p_partkey", "rule_body")


@query("suggest_fixes", f"""
WITH {LIBRARY_SQL},
r AS (SELECT *, CASE WHEN k IN (0, 5, 7) THEN '{{"null_handling":"null"}}' WHEN k = 1 OR (k = 6 AND p_size % 7 <> 0)
        THEN '{{"null_handling":"null","unmapped_handling":"null"}}' ELSE '{{}}' END AS patch,
        CASE WHEN k IN (0, 5, 7) THEN p_size % 3 = 0 OR p_size % 4 = 0 OR p_size % 10 = 9 OR p_size % 6 IN (1, 2) OR p_size % 17 = 0
             WHEN k = 1 THEN p_size % 9 = 0 OR p_size % 4 = 1 ELSE false END AS wrong FROM l)
SELECT p_partkey, patch, patch = '{{}}' OR wrong AS escalate,
       CASE WHEN patch = '{{}}' THEN 'no fix matches the findings' WHEN wrong THEN 'patched body did not validate'
            ELSE 'applied fixes' END AS reason,
       CASE WHEN patch = '{{}}' OR wrong THEN NULL
            WHEN k = 6 THEN '{{"map":{{"high":"H","low":"L"}},"null_handling":"null","unmapped_handling":"null"}}'
            WHEN k = 1 THEN '{{"map":{{"' || CASE WHEN p_type < 'zz' THEN p_type || '":"Y","zz":"N' ELSE 'zz":"N","'
            || p_type || '":"Y' END || '"}},"null_handling":"null","unmapped_handling":"null"}}'
            ELSE '{{"edges":[' || CASE WHEN p_size % 5 = 1 THEN '"' || p_size || '"' ELSE CAST(p_size AS VARCHAR)
            END || ',' || (p_size + p_size % 3) || '],"labels":["lo","mid","hi"],"null_handling":"null"}}' END AS revised_body
FROM r""")
def suggest_fixes(spark: SparkSession, folder: str) -> DataFrame:
    entries = named_library(spark, folder)
    kind = F.col("rule_kind")
    props = F.when(kind == "bin", F.array(F.lit("P-bin-2"), F.lit("P-bin-3"))).when(
        kind == "flag", F.array(F.lit("P-flag-3"), F.lit("P-flag-2"))).otherwise(F.array(F.lit("P-duration-2")))
    findings = entries.select("study_id", "name", F.explode(props).alias("property_id"))
    fixed = lib.suggest_fixes(entries.drop("p_partkey"), findings)
    return fixed.select(
        F.substr("name", F.lit(2)).cast("bigint").alias("p_partkey"), "patch", "escalate",
        F.split("reason", ":")[0].alias("reason"), "revised_body")


def _bins(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("rule_id"), F.array(size, size + F.col("p_size") % 3 + 1).alias("edges"),
        F.array(F.lit("lo"), F.lit("mid"), F.lit("hi")).alias("labels"))


@query("probe_numeric", """
SELECT p_partkey AS rule_id, 100::BIGINT AS n_probes, 0::BIGINT AS n_outside, 2::BIGINT AS n_on_edge, 0::BIGINT AS n_unlabelled,
       'mid,hi,lo,mid,mid,hi' AS near_edges FROM part""")
def probe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """A bucket rule per part against its own batch of a hundred values, checked inside the row."""
    rows = _bins(spark, folder).withColumn("batch", lib.numeric_batch(F.col("rule_id"), F.col("edges")))
    low, high = F.array_min("edges") - 5.0, F.array_max("edges") + 5.0
    rows = rows.withColumn("labels", F.transform("batch", lambda v: lib.bucket_of(v, F.col("edges"), F.col("labels"))))

    def n(found):
        return F.size(found).cast("bigint")

    return rows.select(
        "rule_id", n("batch").alias("n_probes"),
        n(F.filter("batch", lambda v: (v < low) | (v > high))).alias("n_outside"),
        n(F.filter("batch", lambda v: F.array_contains("edges", v))).alias("n_on_edge"),
        n(F.filter("labels", lambda v: v.isNull())).alias("n_unlabelled"),
        F.array_join(F.slice("labels", 1, 6), ",").alias("near_edges"))


@query("probe_categorical", """
SELECT p_partkey AS rule_id, 15::BIGINT AS n_probes, 2::BIGINT AS n_declared, 10::BIGINT AS n_unmapped, 3::BIGINT AS n_null
FROM part""")
def probe_categorical(spark: SparkSession, folder: str) -> DataFrame:
    rules = table(spark, folder, "part").select(
        F.col("p_partkey").alias("rule_id"), F.create_map(F.col("p_type"), F.lit("Y"), F.lit("zz"), F.lit("N")).alias("map"))
    value = F.col("value")
    declared = F.coalesce(F.map_contains_key("map", value), F.lit(False))
    return lib.categorical_probes(rules).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_if(declared).alias("n_declared"),
        F.count_if(value.isNotNull() & ~declared).alias("n_unmapped"), F.count_if(value.isNull()).alias("n_null"))


EDGES_SQL = """
per_entry AS (SELECT DISTINCT p_partkey, l.study_id, l.name, r.col FROM l JOIN (
  SELECT p_partkey, unnest(string_split(inputs_csv, ',')) AS col FROM l
  UNION ALL SELECT p_partkey, 'd1' FROM l WHERE k = 2 UNION ALL SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN 'd1' ELSE 'd2' END FROM l WHERE k = 2
  UNION ALL SELECT p_partkey, 'p_size' FROM l WHERE k = 3 UNION ALL SELECT p_partkey, 'D0' FROM l WHERE k = 3
  UNION ALL SELECT p_partkey, 'D3' FROM l WHERE k = 4 UNION ALL SELECT p_partkey, 'D1' FROM l WHERE k = 4) r USING (p_partkey)),
edges AS (SELECT study_id, name AS derivation, col AS "column",
  CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.study_id = p.study_id AND l.name = p.col) THEN 'derived' ELSE 'source' END AS origin
  FROM per_entry p)"""


@query("lineage_edges", f"WITH {LIBRARY_SQL}, {EDGES_SQL} SELECT study_id, derivation, \"column\", origin FROM edges")
def edges(spark: SparkSession, folder: str) -> DataFrame:
    return lineage_edges(library(spark, folder))


@query("missing_sources", f"""
WITH {LIBRARY_SQL}, {EDGES_SQL}
SELECT study_id, derivation, string_agg("column", ',' ORDER BY "column") AS missing FROM edges
WHERE origin = 'source' AND "column" NOT IN ('p_size', 'p_type', 'd1', 'd2', 'p_retailprice')
GROUP BY study_id, derivation""")
def missing(spark: SparkSession, folder: str) -> DataFrame:
    """Columns no dataset offers; a derivation names few, so the per-derivation list is small."""
    entries = library(spark, folder)
    offered = entries.select("study_id").distinct().select(
        "study_id", F.explode(F.array(*[F.lit(c) for c in ("p_size", "p_type", "d1", "d2", "p_retailprice")])).alias("column"))
    lacking = missing_sources(entries, offered).distinct()
    return lacking.groupBy("study_id", "derivation").agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("missing"))


@query("lineage_impact", f"""
WITH RECURSIVE {LIBRARY_SQL}, {EDGES_SQL},
reach AS (
  SELECT DISTINCT study_id, derivation, 1 AS depth FROM edges WHERE "column" IN ('p_size', 'd1')
  UNION SELECT e.study_id, e.derivation, r.depth + 1 FROM reach r JOIN edges e
    ON e.study_id = r.study_id AND e."column" = r.derivation WHERE r.depth < 9)
SELECT study_id, derivation, min(depth) AS depth FROM reach GROUP BY study_id, derivation""")
def lineage_impact(spark: SparkSession, folder: str) -> DataFrame:
    all_edges = lineage_edges(library(spark, folder))
    seeds = all_edges.where("column IN ('p_size', 'd1')").select("study_id", "column").distinct()
    return impact(all_edges, seeds)


KINDS = ("bin", "compound", "duration", "flag", "risk_score")
KINDS_SQL = "kinds AS (SELECT unnest(" + str(list(KINDS)) + ") AS term)"


@query("triage_terms", f"""
WITH {LIBRARY_SQL}, {KINDS_SQL},
codes AS (SELECT DISTINCT unnest([p_type, p_brand, p_name, rule_kind]) AS code FROM l),
scored AS (SELECT code, term, 1 - levenshtein(lower(code), term) / greatest(length(code), length(term)) AS score FROM codes, kinds),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY score DESC, term) AS INTEGER) AS place FROM scored WHERE score > 0)
SELECT code, term, score, score >= 0.6 AS strong, place FROM ranked WHERE place <= 3""")
def triage_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest rule kinds to every distinct text the parts table offers as a code."""
    part = table(spark, folder, "part").withColumn("kind", F.expr(ENTRY["rule_kind"]))
    codes = part.select(F.explode(F.array("p_type", "p_brand", "p_name", "kind")).alias("code"))
    return suggest_terms(codes, "code")


@query("triage_keywords", """
SELECT doc_id, CASE
  WHEN t LIKE '%days between%' OR t LIKE '%weeks between%' OR t LIKE '%duration%' OR t LIKE '%delta%' OR t LIKE '%elapsed%' OR t LIKE '%days from%' THEN 'duration'
  WHEN t LIKE '%tier%' OR t LIKE '%ladder%' OR t LIKE '%risk group%' OR contains(t, 'risk_group') OR t LIKE '%stratify by%' OR t LIKE '%first match%' THEN 'risk_score'
  WHEN t LIKE '%inclusion criter%' OR t LIKE '%all of%' OR t LIKE '%any of%' OR t LIKE '%and/or%' OR t LIKE '%population%' OR t LIKE '%analysis pop%' THEN 'compound'
  WHEN t LIKE '%bucket%' OR t LIKE '%stratif%' OR t LIKE '%categor%' OR t LIKE '%age group%' OR t LIKE '%binning%' OR t LIKE '%cut point%' THEN 'bin'
  WHEN t LIKE '%map %' OR t LIKE '%mapping%' OR t LIKE '%recode%' OR t LIKE '%label%' OR t LIKE '%respond%' THEN 'flag' END AS kind
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def triage_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return with_keyword_kind(table(spark, folder, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "kind")


FIELDS = {
    "bin": ["edges", "labels", "null_handling", "null_label"],
    "compound": ["conditions", "combinator", "true_value", "false_value", "null_handling"],
    "duration": ["start_column", "end_column", "unit", "null_handling"],
    "flag": ["map", "null_handling", "null_value", "unmapped_handling", "unmapped_value"],
    "risk_score": ["tiers", "fallback_label", "null_handling"],
}
FIELDS_SQL = "fields AS (SELECT unnest([" + ", ".join(f"{{kind: '{k}', own: {v}}}" for k, v in FIELDS.items()) + "], recursive := true))"


@query("triage_suggestions", f"""
WITH {LIBRARY_SQL}, {FIELDS_SQL},
scored AS (
  SELECT study_id, name, rule_kind, kind, greatest(
      1 - levenshtein(lower(rule_kind), kind) / greatest(length(rule_kind), length(kind)),
      len(list_intersect(json_keys(rule_body), own)) / len(list_distinct(json_keys(rule_body) || own))) AS score
  FROM l, fields WHERE rule_kind NOT IN {KINDS}),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY study_id, name ORDER BY score DESC, kind) AS INTEGER) AS place FROM scored WHERE score > 0)
SELECT study_id, name, rule_kind, kind AS suggestion, score AS confidence, place FROM ranked WHERE place <= 3""")
def triage_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked kinds for the library's entries with an unknown kind, by name, body shape and text."""
    return suggest_kinds(library(spark, folder))


@query("top_suggestions", """
SELECT p_brand, p_type, n, CAST(row_number() OVER w AS INTEGER) AS place
FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
WINDOW w AS (PARTITION BY p_brand ORDER BY n DESC, p_type) QUALIFY row_number() OVER w <= 3""")
def top_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, ["p_brand"], [F.desc("n"), F.col("p_type")], 3)
