"""Streams: equality with the batch form, and tickets that time out."""

import pytest
from pyspark.sql import functions as F

from rulefold.plans.apply import apply_spec
from rulefold.plans.errors import SpecError
from rulefold.plans.spec import Spec
from rulefold.queries.streams import STREAM_SPEC
from rulefold.streaming.derive import derive_stream
from rulefold.streaming.runs import read_stream, run_available
from rulefold.streaming.tickets import first_answer, first_answers, match_with_timeout


def test_stream_equals_batch(spark, sf):
    spec = Spec([d.patched({"unmapped_handling": "null"}) if d.name == "KIND" else d for d in STREAM_SPEC.derivations])
    batch = apply_spec(spark.read.parquet(f"{sf}/events.parquet"), spec).df
    stream = run_available(derive_stream(read_stream(spark, f"{sf}/events.parquet"), STREAM_SPEC), "t")
    cols = ["event_id", *spec.names()]
    assert stream.select(cols).exceptAll(batch.select(cols)).isEmpty() and stream.count() == batch.count()
    assert stream.where("size(_violations) > 0").count() == batch.where("event_type = 'error'").count()


def test_stream_refuses_data_dependent_choices(spark, sf):
    stream = read_stream(spark, f"{sf}/events.parquet")
    with pytest.raises(SpecError, match="integral"):
        apply_spec(stream, STREAM_SPEC)
    with pytest.raises(SpecError, match="quarantine"):
        apply_spec(stream, STREAM_SPEC, integral="never")


def test_ticket_timeout(spark, tmp_path):
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))
    tickets = spark.createDataFrame([("e1", 0), ("e2", 5), ("late", 10), ("end", 100000)], "event_id string, s int")
    answers = spark.createDataFrame([("e1", 30), ("late", 90), ("end", 100001)], "event_id string, s int")
    tickets.select("event_id", base.alias("opened_at")).write.parquet(str(tmp_path / "t"))
    answers.select("event_id", base.alias("resolved_at")).write.parquet(str(tmp_path / "r"))
    joined = match_with_timeout(read_stream(spark, str(tmp_path / "t")), read_stream(spark, str(tmp_path / "r")))
    got = {r["event_id"]: r["timed_out"] for r in run_available(joined, "tickets").collect()}
    assert got == {"e1": False, "e2": True, "late": True, "end": False}


def test_ticket_with_several_answers(spark, tmp_path):
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))
    tickets = [("early", 100), ("late", 100), ("both", 100), ("two", 100), ("none", 100), ("twin", 100), ("twin", 100), ("end", 100000)]
    answers = [("early", 50), ("early", 130), ("late", 120), ("late", 300), ("both", 90), ("both", 140), ("both", 400), ("none", 99), ("none", 161)]
    # the second file is a batch of its own and has an earlier answer
    later = [("two", 110), ("two", 120), ("twin", 105), ("end", 100001)]
    spark.createDataFrame(tickets, "event_id string, s int").select("event_id", base.alias("opened_at")).write.parquet(str(tmp_path / "t"))
    for rows in (answers + [("two", 150), ("two", 150), ("twin", 150)], later):
        frame = spark.createDataFrame(rows, "event_id string, s int").select("event_id", base.alias("resolved_at")).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "r"))
    for files in (None, 1):
        joined = match_with_timeout(read_stream(spark, str(tmp_path / "t")), read_stream(spark, str(tmp_path / "r"), files))
        rows = first_answers(run_available(joined, "tickets")).select("event_id", (F.unix_seconds("resolved_at") - 1_700_000_000).alias("s"), "timed_out")
        assert sorted(map(tuple, rows.collect()), key=str) == sorted([
            ("early", 130, False), ("late", 120, False), ("both", 140, False), ("two", 110, False), ("none", None, True),
            ("twin", 105, False), ("twin", 105, False), ("end", 100001, False)], key=str)


def test_first_answer_leaves_once(spark, tmp_path):
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))
    tickets = [("early", 100, "a"), ("late", 100, None), ("both", 100, "c"), ("two", 100, "d"), ("none", 100, "e"), ("twin", 100, "f"), ("twin", 100, "f"), ("again", 100, "g"), ("again", 130, "h"),
               (None, 100, "i"), (None, 101, "i"), ("open", 99990, "z"), ("end", 100000, "y")]
    batches = [
        [("early", 50), ("early", 130), ("late", 161), ("both", 90), ("both", 140), ("both", 400), ("none", 99), ("two", 150), ("two", 150), ("twin", 150), ("again", 140), (None, 110), ("stray", 120)],
        [("two", 110), ("two", 120), ("twin", 105), ("again", 191), ("again", 120)],  # a batch of its own, with earlier answers
        [("end", 100001)], [("end", 100002)], [("two", 101), ("none", 120)]]  # the last is behind the watermark
    spark.createDataFrame(tickets, "event_id string, s int, note string").select("event_id", base.alias("opened_at"), "note").coalesce(1).write.parquet(str(tmp_path / "t"))
    for rows in batches:
        spark.createDataFrame(rows, "event_id string, s int").select("event_id", base.alias("resolved_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        __import__("time").sleep(0.05)
    want = [("early", 100, "a", 130, False), ("late", 100, None, None, True), ("both", 100, "c", 140, False), ("two", 100, "d", 110, False), ("none", 100, "e", None, True),
            ("twin", 100, "f", 105, False), ("twin", 100, "f", 105, False), ("again", 100, "g", 120, False), ("again", 130, "h", 140, False), (None, 100, "i", None, True), (None, 101, "i", None, True)]
    stream = first_answer(read_stream(spark, str(tmp_path / "t")), read_stream(spark, str(tmp_path / "r"), 1))
    assert stream.columns == ["event_id", "opened_at", "note", "resolved_at", "timed_out"]
    rows = run_available(stream, "first").select(
        "event_id", (F.unix_seconds("opened_at") - 1_700_000_000).cast("int"), "note", (F.unix_seconds("resolved_at") - 1_700_000_000).cast("int"), "timed_out")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
