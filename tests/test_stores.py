"""Keyed tables, memory that many writers share, and zone names of any year."""

import datetime

import pytest
from pyspark.sql import functions as F

from rulefold.functions import labels as lb
from rulefold.operators import lookup
from rulefold.operators import memory_store as store
from rulefold.queries.memory import PATTERNS


def _keyed(spark, path):
    rows = spark.range(40_000).select(
        (F.col("id") % 10_007).alias("k"), F.col("id").alias("n"), F.create_map(F.lit("m"), "id").alias("m"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("lineage_id"))
    rows = rows.withColumn("k", F.when(F.col("k") != 5, F.col("k")))
    lookup.write_keyed(rows, path, ["k", "n"], files=8, row_group_bytes=64 << 10)
    return rows


def test_find_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = _keyed(spark, path)
    assert spark.read.parquet(f"{path}/ranges").count() == 8
    found = lookup.find(spark, path, "k", [17, 9_000, 123_456])
    assert sorted(found.drop("m").collect()) == sorted(rows.where("k in (17, 9000)").drop("m").collect())
    assert len(found.inputFiles()) == 2  # of 8
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 8 <= read <= 8_000  # of 40,000


def test_find_keys(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = _keyed(spark, path)
    assert sorted(lookup.find(spark, path, ["k", "n"], [(17, 17), (17, 10_024), (18, 17)]).drop("m").collect()) == sorted(rows.where("n in (17, 10024)").drop("m").collect())
    nulls = rows.where("k is null")
    assert nulls.count() == 4
    assert sorted(lookup.find(spark, path, "k", [None]).select("n", "lineage_id").collect()) == sorted(nulls.select("n", "lineage_id").collect())
    table = spark.createDataFrame([(17, "a"), (9_000, "b"), (None, "c"), (17, "d")], "k bigint, lineage_id string")
    assert lookup.find(spark, path, "k", table).count() == 4 * 3
    assert lookup.find(spark, path, "k", table.where("false")).count() == 0
    assert lookup.find(spark, path, "k", []).count() == 0
    assert lookup.find(spark, path, "k", [50_000]).columns == rows.columns
    with pytest.raises(ValueError, match="sorted by"):
        lookup.find(spark, path, "n", [1])
    with pytest.raises(ValueError, match="parts"):
        lookup.find(spark, path, ["k", "n"], [(1,)])
    with pytest.raises(ValueError, match="as a table"):
        lookup.find(spark, path, "k", list(range(lookup.MAX_KEYS + 1)))


def test_one_key_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("odd.key"), "id")
    lookup.write_keyed(rows, path, "odd.key", files=6)
    most = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < 9_000
    assert lookup.find(spark, path, "odd.key", ["hot"]).count() == 10_000
    lookup.write_keyed(rows.where("false"), path + "-none", "odd.key")
    assert lookup.find(spark, path + "-none", "odd.key", ["hot"]).count() == 0


def _pattern(key, run, second):
    at = datetime.datetime(2024, 1, 1, 0, 0, second)
    return ("bin", key, "{}", run, at, None, "validated")


def _runs(spark, folder):
    return {r.body_signature: r.first_seen_run_id for r in store.read_store(spark, folder, "rule_patterns", PATTERNS).collect()}


def test_two_writers(spark, tmp_path):
    folder = str(tmp_path / "memory")
    assert _runs(spark, folder) == {}

    def add(writer, number, *rows):
        store.add_batch(spark.createDataFrame(list(rows), PATTERNS), folder, "rule_patterns", writer, number)

    add("a", 0, _pattern("x", "a0", 5), _pattern("y", "a0", 9), _pattern("y", "a0-early", 8))
    add("b", 0, _pattern("x", "b0", 4))
    assert _runs(spark, folder) == {"x": "b0", "y": "a0-early"}
    add("a", 0, _pattern("x", "a0", 5), _pattern("y", "a0-early", 8))  # repeated
    assert _runs(spark, folder) == {"x": "b0", "y": "a0-early"}
    assert store.compact(spark, folder, "rule_patterns", PATTERNS) == 1
    add("c", 0, _pattern("x", "c0", 1), _pattern("z", "c0", 1))  # heard of later, whatever its clock says
    add("b", 0, _pattern("x", "b0", 4))  # repeated behind the compaction
    assert _runs(spark, folder) == {"x": "b0", "y": "a0-early", "z": "c0"}
    assert store.compact(spark, folder, "rule_patterns", PATTERNS) == 2
    assert _runs(spark, folder) == {"x": "b0", "y": "a0-early", "z": "c0"}
    assert [p.name for p in (tmp_path / "memory" / "base").iterdir()] == ["2"] and not list((tmp_path / "memory" / "batches").iterdir())
    with pytest.raises(ValueError, match="name"):
        add("a/b", 0, _pattern("x", "a", 1))


def test_unfinished_and_simultaneous(spark, tmp_path):
    folder = str(tmp_path / "memory")
    rows = spark.createDataFrame([_pattern("x", "a0", 5)], PATTERNS)
    store.add_batch(rows, folder, "rule_patterns", "a", 0)
    (tmp_path / "memory" / "batches" / "dead-0").mkdir()  # a job that died
    assert store.compact(spark, folder, "rule_patterns", PATTERNS, remove=False) == 1
    store.add_batch(spark.createDataFrame([_pattern("y", "b0", 5)], PATTERNS), folder, "rule_patterns", "b", 0)
    # a second compaction that saw the same bases and a batch more: both bases are read
    assert store.compact(spark, folder, "rule_patterns", PATTERNS, remove=False) == 2
    assert _runs(spark, folder) == {"x": "a0", "y": "b0"}
    (tmp_path / "memory" / "claims" / "3").touch()  # claimed by a compaction that died
    assert store.compact(spark, folder, "rule_patterns", PATTERNS) == 4
    assert _runs(spark, folder) == {"x": "a0", "y": "b0"}


@pytest.mark.parametrize("tz", ["America/Toronto", "Europe/London", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca"])
def test_zone_names(spark, tz):
    zone = lb.ZoneInfo(tz)
    at = [datetime.datetime(y, m, d, 12, tzinfo=datetime.UTC) for y in (1925, 1943, 1945, 1952, 1968, 1999, 2024, 2036, 2090) for m in (1, 7, 9) for d in (3, 20)]
    rows = spark.createDataFrame([(a.isoformat(),) for a in at], "text string")
    got = {r.text: r.label for r in rows.select("text", lb.timestamp_label(F.col("text"), tz).alias("label")).collect()}
    for a in at:
        local = a.astimezone(zone)
        assert got[a.isoformat()] == f"{local:%B} {local.day}, {local.year}, {local.hour % 12 or 12}:{local:%M %p} {local.tzname()}"
