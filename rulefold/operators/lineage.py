"""Row lineage, column lineage and impact analysis."""

from __future__ import annotations

import json
import uuid
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions.cells import INTEGRAL, col
from rulefold.functions.signatures import signature_of
from rulefold.plans.spec import Spec
from rulefold.session import Folder, fresh_folder

RECORD_FIELDS = {
    "value": "string", "rule_kind": "string", "body_signature": "string", "agent_chain": "array<string>",
    "hitl_event_ids": "array<string>", "ltm_pattern_ref": "string", "source_row_ids": "array<string>",
}


SAFE_TEXT = r"[ !#-\[\]-~]*"


def json_value(c: Column, dtype: T.DataType, outputs: list[str] | None = None) -> Column:
    """A cell as JSON. Plain text and whole numbers are written directly, which is much cheaper than `to_json`.

    outputs: the closed set of texts the cell can hold; when all of them are plain, no cell needs a look.
    """
    if isinstance(dtype, T.StringType) and outputs is not None and all(re.fullmatch(SAFE_TEXT, o) for o in outputs):
        return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    if isinstance(dtype, INTEGRAL):
        return F.coalesce(c.cast("string"), F.lit("null"))
    encoded = F.to_json(F.array(c))
    text = F.substr(encoded, F.lit(2), F.length(encoded) - 2)
    if isinstance(dtype, T.StringType):
        text = F.when(c.rlike(rf"\A{SAFE_TEXT}\z"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(text)
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def body_signatures(spark: SparkSession, derived) -> dict[str, str]:
    """Signature of each derivation's body, by the recipe of the rule library, so that lineage and memory agree."""
    from rulefold.operators.library import normalise

    rows = normalise(Spec(list(derived.entries.values())).entries_df(spark)).select("name", "body_signature").collect()  # one per derivation
    # own rule kinds are unknown to the library: their bodies are signed as given
    return {r["name"]: r["body_signature"] or signature_of(derived.bodies[r["name"]].as_dict()) for r in rows}


def lineage_column(derived, key: str | list[str], records: dict[str, dict] | None = None) -> Column:
    """JSON per row: for each derived column its value and how it came about. A projection, no UDF.

    key: the column or columns that identify a row; they are listed in `source_row_ids`. records may add per derivation:
    agent_chain, hitl_event_ids, ltm_pattern_ref, body_signature. Everything but the value and the row key is the same
    for all rows and is rendered once, here.
    """
    records, schema = records or {}, derived.df.schema
    keys = [key] if isinstance(key, str) else list(key)
    known = {n: r["body_signature"] for n, r in records.items() if r.get("body_signature")}
    if not set(derived.derived_names()) <= set(known):
        known = body_signatures(derived.df.sparkSession, derived) | known
    row_ids = F.concat(F.lit(',"source_row_ids":['), F.concat_ws(",", *[json_value(col(k), schema[k].dataType) for k in keys]), F.lit("]}"))
    parts = []
    for i, name in enumerate(derived.derived_names()):
        rec = records.get(name, {})
        fixed = json.dumps({
            "rule_kind": derived.entries[name].rule_kind,
            "body_signature": known[name],
            "agent_chain": rec.get("agent_chain", ["CG", "V"]),
            "hitl_event_ids": rec.get("hitl_event_ids", []),
            "ltm_pattern_ref": rec.get("ltm_pattern_ref"),
        }, separators=(",", ":"))[1:-1]
        opening = ("," if i else "{") + json.dumps(name) + ':{"value":'
        parts += [F.lit(opening), json_value(col(name), schema[name].dataType, derived.rules[name].outputs), F.lit("," + fixed), row_ids]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def with_lineage(derived, key: str | list[str], records: dict[str, dict] | None = None, column: str = "lineage_id") -> DataFrame:
    return derived.df.withColumn(column, lineage_column(derived, key, records))


def read_lineage(df: DataFrame, column: str = "lineage_id", fields: dict[str, str] | None = None) -> DataFrame:
    """One row per row and derived column, from the JSON. Filter on the row key first to read few rows.

    fields: those of the records that are wanted, with their types; `RECORD_FIELDS` by default. The others are passed by in the text, as
    values of a map are out of reach of Spark's own pruning. Where the row key has whole numbers only, `source_row_ids` are read faster as
    `array<bigint>`: the parser writes every number that is to be text anew.
    """
    record = ",".join(f"{n}:{t}" for n, t in (fields or RECORD_FIELDS).items())
    parsed = F.from_json(col(column), f"map<string,struct<{record}>>")
    others = [col(c) for c in df.columns if c != column]
    return df.select(*others, F.explode(parsed).alias("derivation", "_rec")).select(
        *[c for c in df.columns if c != column], "derivation", "_rec.*"
    )


def column_lineage(spark: SparkSession, spec: Spec, study_id: str = "spec") -> DataFrame:
    """Edges derived column <- referenced column of one spec."""
    names = set(spec.names())
    rows = [
        (study_id, d.name, c, "derived" if c in names else "source", d.rule_kind,
         json.dumps(d.rule_body, sort_keys=True))
        for d in spec.derivations for c in d.columns()
    ]
    return spark.createDataFrame(
        rows, "study_id string, derivation string, column string, origin string, rule_kind string, rule_body string"
    )


BODY_COLUMNS = (
    "start_column string, end_column string, conditions array<struct<column:string>>, "
    "tiers array<struct<conditions:array<struct<column:string>>>>"
)


def referenced_columns(inputs: Column, rule_kind: Column, rule_body: Column) -> Column:
    """Table form of 'which columns does this rule read', body JSON included, first-seen order."""
    b = F.from_json(rule_body, BODY_COLUMNS)
    empty = F.array().cast("array<string>")
    ends = F.when(rule_kind == "duration", F.array(b["start_column"], b["end_column"])).otherwise(empty)
    conds = F.when(
        rule_kind == "compound", F.transform(F.coalesce(b["conditions"], F.array()), lambda c: c["column"])
    ).otherwise(empty)
    tiers = F.when(
        rule_kind == "risk_score",
        F.flatten(F.transform(
            F.coalesce(b["tiers"], F.array()),
            lambda t: F.transform(F.coalesce(t["conditions"], F.array()), lambda c: c["column"]))),
    ).otherwise(empty)
    return F.filter(
        F.array_distinct(F.array_compact(F.concat(inputs, ends, conds, tiers))), lambda c: c != ""
    )


def lineage_edges(entries: DataFrame) -> DataFrame:
    """Edges of a whole `spec_entries` table: (study_id, derivation, column, origin).

    Names grow with the table, and its files are much smaller than its rows: merged, they never pass through the driver as a broadcast.
    """
    refs = referenced_columns(F.col("inputs"), F.col("rule_kind"), F.col("rule_body"))
    edges = entries.select("study_id", F.col("name").alias("derivation"), F.explode(refs).alias("column"))
    derived = entries.select("study_id", F.col("name").alias("column"), F.lit(True).alias("_d")).distinct()
    return edges.join(derived.hint("merge"), ["study_id", "column"], "left").select(
        "study_id", "derivation", "column",
        F.when(F.col("_d"), F.lit("derived")).otherwise(F.lit("source")).alias("origin"),
    )


def missing_sources(entries: DataFrame, dataset_columns: DataFrame) -> DataFrame:
    """Referenced columns found neither in `dataset_columns(study_id, column)` nor among derivations."""
    return (
        lineage_edges(entries).where("origin = 'source'").drop("origin")
        .join(dataset_columns.hint("merge"), ["study_id", "column"], "left_anti")
    )


SPREAD = 16  # tasks that the readers of one column are dealt to


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything downstream of changed or failed columns.

    edges(study_id, derivation, column), seeds(study_id, column) -> (study_id, derivation, depth) with the smallest depth. Rounds end
    when nothing new is reached, so cycles do no harm and no depth is left out.

    Edges are dealt to buckets once, by what they read and a salt, as one column may have a large share of all readers; what was reached is
    kept in buckets by name, a folder per depth. A round moves only the names reached last and the new ones, edges and earlier names stay
    where they are. Both are written to the shared folder; edges are removed at the end, the other is the result.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, "impact")
    reads, met = (f"impact_{kind}_{uuid.uuid4().hex}" for kind in ("reads", "met"))
    keys = ["study_id", "column", "salt"]
    done = False
    try:
        dealt = edges.select("study_id", "derivation", "column", F.pmod(F.hash("derivation"), F.lit(SPREAD)).alias("salt")).repartition(parts, *keys)
        dealt.write.bucketBy(parts, *keys).sortBy(*keys).option("path", f"{path}/reads").saveAsTable(reads)
        step, depth = impact_round(spark.table(reads), seeds, None), 1
        while True:
            found = step.withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("depth")
            found.bucketBy(parts, "study_id", "derivation").option("path", f"{path}/met").saveAsTable(met)
            reached = spark.table(met)
            last = reached.where(F.col("depth") == depth)
            if last.isEmpty():
                break
            step, depth = impact_round(spark.table(reads), last.select("study_id", F.col("derivation").alias("column")), reached), depth + 1
        done = True
        return spark.read.schema(reached.schema).parquet(f"{path}/met")
    finally:
        for name in (reads, met):  # the names only, files stay
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        Folder(spark, path).remove(f"{path}/reads" if done else path)


def impact_round(reads: DataFrame, frontier: DataFrame, reached: DataFrame | None) -> DataFrame:
    """Names that read a column of the frontier and are not reached yet. Both joins are merged where the buckets are, as either side may be large."""
    salted = frontier.select("study_id", "column").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    step = reads.join(salted.hint("merge"), ["study_id", "column", "salt"]).select("study_id", "derivation").distinct()
    return step if reached is None else step.join(reached.hint("merge"), ["study_id", "derivation"], "left_anti")
