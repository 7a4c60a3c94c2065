"""Plans that must hold when data and hot keys grow."""

import contextlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rulefold.operators import memory as mem
from rulefold.operators.lineage import impact, impact_round, lineage_edges, missing_sources, read_lineage
from rulefold.plans.apply import apply_spec
from rulefold.queries.derivations import FLAGSHIP, flagship
from rulefold.queries.verification import lineage_read_back


@contextlib.contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_in_lookups(spark):
    n = 200_000
    rows = spark.range(n).select(
        F.lit("bin").alias("rule_kind"), F.when(F.col("id") % 3 == 0, F.col("id") % 1000).otherwise(F.lit(0)).cast("string").alias("body_signature"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    memory = spark.range(0, 1000, 2).select(F.lit("bin").alias("rule_kind"), F.col("id").cast("string").alias("body_signature"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    with settings(spark, small):
        found = mem.lookup(rows, memory, ["rule_kind", "body_signature"], []).select("payload", "ltm_hit")
        got = found.collect()
        assert "skew=true" in plan(found)
    hits = sum(r["ltm_hit"] for r in got)
    assert len(got) == n and hits == rows.where("body_signature % 2 = 0").count()


def test_one_projection_per_level_and_no_extra_shuffle(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("o_orderdate", F.col("l_shipdate") - F.expr("interval 9 days"))
    text = plan(apply_spec(items, FLAGSHIP, integral="never").df)
    assert "Exchange" not in text and "Python" not in text


def test_scans_read_only_what_rules_need(spark, sf):
    text = plan(flagship(spark, sf).df.select("QTY_GROUP"))
    scan = next(line for line in text.splitlines() if "l_quantity" in line and "FileScan" in line)
    assert "l_discount" not in scan and "l_returnflag" not in scan


def test_first_per_key_combines_before_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.lit("x").alias("v"))
    df = mem.first_per_key(rows, ["k"], ["at"])
    text = plan(df)
    assert text.index("Exchange") < text.index("partial_min_by")
    assert {r["k"]: r["at"] for r in df.collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("length", [20])
def test_impact_follows_long_chains_and_cycles(spark, length):
    chain = [("s", f"D{i}", f"D{i - 1}" if i else "x") for i in range(length)] + [("s", "D0", f"D{length - 1}")]
    edges = spark.createDataFrame(chain, "study_id string, derivation string, column string")
    seeds = spark.createDataFrame([("s", "x")], "study_id string, column string")
    got = impact(edges, seeds).agg(F.count("*"), F.max("depth")).first()
    assert tuple(got) == (length, length)


def test_impact_leaves_edges_and_reached_names_where_they_are(spark, tmp_path):
    edges = spark.range(2000).select(F.lit("s").alias("study_id"), F.concat(F.lit("d"), "id").alias("derivation"), F.lit("x").alias("column"), F.pmod("id", F.lit(16)).cast("int").alias("salt"))
    keys = ["study_id", "column", "salt"]
    edges.repartition(4, *keys).write.bucketBy(4, *keys).sortBy(*keys).option("path", f"{tmp_path}/reads").saveAsTable("impact_plan_reads")
    met = spark.createDataFrame([("s", "d1", 1)], "study_id string, derivation string, depth int")
    met.write.partitionBy("depth").bucketBy(4, "study_id", "derivation").option("path", f"{tmp_path}/met").saveAsTable("impact_plan_met")
    try:
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            reached = spark.table("impact_plan_met")
            step = impact_round(spark.table("impact_plan_reads"), spark.createDataFrame([("s", "x")], "study_id string, column string"), reached)
            lines = plan(step).split("\n")
            assert step.count() == 1999
        for scan in [k for k, line in enumerate(lines) if "FileScan" in line]:
            assert "Bucketed: true" in lines[scan]
            # from a stored table up to its join: no exchange
            depth = lines[scan].index("FileScan")
            for line in reversed(lines[:scan]):
                at = len(line) - len(line.lstrip(" :+-*"))
                if at < depth:
                    depth = at
                    assert "Exchange" not in line
                    if "Join" in line:
                        break
        # one column with all readers is in many tasks
        assert spark.table("impact_plan_reads").groupBy(F.input_file_name()).count().count() == 4
    finally:
        for name in ("reads", "met"):
            spark.sql(f"DROP TABLE IF EXISTS impact_plan_{name}")


def test_impact_of_nothing(spark):
    edges = spark.createDataFrame([("s", "A", "x"), ("s", "A", "x"), ("s", "B", None), (None, "C", "x")], "study_id string, derivation string, column string")
    seeds = spark.createDataFrame([("s", "y"), ("t", "x")], "study_id string, column string")
    assert impact(edges, seeds).collect() == [] and impact(edges.limit(0), seeds).collect() == []
    got = impact(edges, seeds.unionAll(seeds).unionAll(edges.select("study_id", "column"))).collect()
    assert [tuple(r) for r in got] == [("s", "A", 1)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("impact_")]


def test_impact_broadcasts_no_names(spark, tmp_path):
    """Small files may hold many names, so sizes that Spark guesses from files decide nothing."""
    spark.createDataFrame(
        [("s", "A", "bin", ["x"], "{}"), ("s", "B", "bin", ["A", "gone"], "{}"), (None, "A", "bin", ["A"], "{}")],
        "study_id string, name string, rule_kind string, inputs array<string>, rule_body string").write.parquet(f"{tmp_path}/entries")
    entries = spark.read.parquet(f"{tmp_path}/entries")
    edges = lineage_edges(entries)
    seeds = edges.where("column = 'x'").select("study_id", "column")
    reached = seeds.select("study_id", F.lit("A").alias("derivation"))
    step = impact_round(edges.withColumn("salt", F.lit(0)), seeds, reached)
    for df in (edges, missing_sources(entries, seeds), step):
        assert "Broadcast" not in plan(df) and "Join" in plan(df)
    assert sorted(map(str, edges.collect())) == sorted(map(str, [
        Row(study_id="s", derivation="A", column="x", origin="source"), Row(study_id="s", derivation="B", column="A", origin="derived"),
        Row(study_id="s", derivation="B", column="gone", origin="source"), Row(study_id=None, derivation="A", column="A", origin="source")]))
    assert [tuple(r) for r in missing_sources(entries, seeds).where("study_id = 's'").select("derivation", "column").collect()] == [("B", "gone")]


def test_lineage_is_read_back_by_wanted_fields(spark, sf):
    """Fields that nobody reads are not parsed, and whole numbers in row keys are no text."""
    text = plan(lineage_read_back(spark, sf))
    parsed = text[text.index("from_json"):]
    assert "source_row_ids,ArrayType(LongType" in parsed and "hitl_event_ids,ArrayType" not in parsed and "ltm_pattern_ref,StringType" not in parsed
    rows = spark.createDataFrame([(1, '{"A":{"value":2,"source_row_ids":[7,null,-3]},"B":{"value":"x","rule_kind":"bin","source_row_ids":[]}}'), (2, "{}"), (3, None)], "k int, lineage_id string")
    got = read_lineage(rows, fields={"value": "string", "source_row_ids": "array<bigint>"}).collect()
    assert [tuple(r) for r in got] == [(1, "A", "2", [7, None, -3]), (1, "B", "x", [])]
    assert read_lineage(rows).columns == ["k", "derivation", "value", "rule_kind", "body_signature", "agent_chain", "hitl_event_ids", "ltm_pattern_ref", "source_row_ids"]
    assert [r["source_row_ids"] for r in read_lineage(rows).collect()] == [["7", None, "-3"], []]


def test_no_machine_local_checkpoints():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "rulefold"
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text
