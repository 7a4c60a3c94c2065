"""Tickets matched with their resolutions as both arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 4  # of ids, for each partition of the state


def match_with_timeout(
    tickets: DataFrame, resolutions: DataFrame, timeout: str = "60 seconds", lateness: str = "10 minutes"
) -> DataFrame:
    """Left outer stream join on event_id within the timeout.

    tickets(event_id, opened_at, ...), resolutions(event_id, resolved_at, ...). A ticket whose resolution does
    not come in time leaves with a NULL `resolved_at` and `timed_out` true once the watermark has passed its
    deadline; younger ones stay in state. A ticket leaves as soon as an answer in time is there, and once more with every
    later one, as a later batch may hold an earlier answer: `first_answers` reduces the stored rows.
    """
    left = tickets.withWatermark("opened_at", lateness)
    # equal answers count as one; answers out of time must not displace those in time, so nothing else is dropped before the join
    right = resolutions.withColumnRenamed("event_id", "_event_id").withWatermark("resolved_at", lateness).dropDuplicates(["_event_id", "resolved_at"])
    in_time = F.expr(
        f"event_id = _event_id AND resolved_at >= opened_at AND resolved_at <= opened_at + interval {timeout}")
    return left.join(right, in_time, "leftOuter").withColumn("timed_out", F.col("_event_id").isNull()).drop("_event_id")


def first_answers(matched: DataFrame) -> DataFrame:
    """Of the stored rows of `match_with_timeout`, those with the first `resolved_at` of each ticket; unanswered tickets stay."""
    ticket = Window.partitionBy("event_id", "opened_at").orderBy(F.col("resolved_at").asc_nulls_last())
    return matched.withColumn("_place", F.rank().over(ticket)).where("_place = 1").drop("_place")


def first_answer(tickets: DataFrame, resolutions: DataFrame, timeout: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Stream of tickets, each exactly once, with its first answer in time.

    tickets(event_id, opened_at, ...), resolutions(event_id, resolved_at, ...) -> the tickets' columns, resolved_at, timed_out. A ticket
    leaves when the watermark has passed its first answer within the timeout, as no earlier one can come then, or its deadline: with a NULL
    `resolved_at` and `timed_out` true. Answers outside the timeout, second ones and those without a ticket never leave; a ticket without an id times
    out, repeated tickets each get their row. Answers may come before their ticket. Rows later than the watermark are dropped.

    Ids are dealt to buckets, a few per partition, each with one state row and an event-time timer for its next decision: its open tickets, and the
    answers that they, or tickets yet to come, may still need. What is decided leaves the state, so it holds about `lateness` and `timeout` of
    the stream. A bucket is matched at once, by a sorted merge.
    """
    spark = tickets.sparkSession
    patience = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {timeout})").first()[0]
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in tickets.columns if c not in ("event_id", "opened_at")]
    kind = tickets.schema["event_id"].dataType
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    name = F.coalesce(F.concat(F.lit("="), F.col("event_id").cast("string")), F.lit("-"))  # "-" for a ticket without an id
    left = tickets.withWatermark("opened_at", lateness).select(
        name.alias("name"), F.col("opened_at").alias("at"), F.unix_micros("opened_at").alias("us"), rest.alias("rest"))
    right = resolutions.where("event_id IS NOT NULL").withWatermark("resolved_at", lateness).select(
        name.alias("name"), F.col("resolved_at").alias("at"), F.unix_micros("resolved_at").alias("us"), F.lit(None).cast("string").alias("rest"))
    # tickets without an id need not meet
    dealt = F.when(F.col("name") == "-", F.xxhash64("us", "rest")).otherwise(F.xxhash64("name"))
    both = left.unionByName(right).withColumn("bucket", F.pmod(dealt, F.lit(buckets)).cast("int"))

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, opened, texts, answered, answers = state.get if state.exists else ([], [], [], [], [])
        asked = [pd.DataFrame({"name": list(names), "us": pd.Series(list(opened), dtype="int64"), "rest": list(texts)}, dtype=None)]
        given = [pd.DataFrame({"name": list(answered), "us": pd.Series(list(answers), dtype="int64")})]
        for frame in frames if not state.hasTimedOut else ():
            is_ticket = frame["rest"].notna()
            asked.append(frame.loc[is_ticket, ["name", "us", "rest"]])
            given.append(frame.loc[~is_ticket, ["name", "us"]])
        tickets_, answers_ = (pd.concat([x for x in part if len(x)] or part[:1], ignore_index=True) for part in (asked, given))
        answers_ = answers_.drop_duplicates().sort_values("us")
        now = state.getCurrentWatermarkMs()
        answers_["first"] = answers_["us"].astype("Int64")
        found = tickets_.sort_values("us").astype({"name": "object"})
        if len(answers_):
            found = pd.merge_asof(found, answers_.astype({"name": "object"}), on="us", by="name", direction="forward", tolerance=patience)
        else:
            found["first"] = pd.Series(pd.NA, index=found.index, dtype="Int64")
        due = _after(found["first"].fillna(found["us"] + patience).astype("int64"))
        waiting = found[due >= now]
        # an answer is needed by a ticket that waits, or by one that may still come: those are not older than the watermark
        oldest = answers_["name"].map(waiting.groupby("name")["us"].min())
        kept = answers_[(_after(answers_["us"]) >= now) | (answers_["us"] >= oldest)]
        if len(waiting) or len(kept):
            state.update(tuple(x.tolist() for x in (waiting["name"], waiting["us"], waiting["rest"], kept["name"], kept["us"])))
            state.setTimeoutTimestamp(int(max(due[due >= now].min() if len(waiting) else _after(kept["us"].max()), now + 1)))
        elif state.exists:
            state.remove()
        out = found.loc[due < now, ["name", "us", "rest", "first"]]
        if len(out):
            yield out

    found = both.groupBy("bucket").applyInPandasWithState(
        decide, "name string, us bigint, rest string, first bigint",
        "names array<string>, opened array<bigint>, rest array<string>, answered array<string>, answers array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    shape = ", ".join(f"`{c}` {tickets.schema[c].dataType.simpleString()}" for c in others)
    columns = {
        "event_id": F.when(F.col("name") != "-", F.substr("name", F.lit(2))).cast(kind), "opened_at": F.timestamp_micros("us").cast(tickets.schema["opened_at"].dataType),
        **{c: F.from_json("rest", shape)[c] for c in others}}
    return found.select(
        *[columns[c].alias(c) for c in tickets.columns], F.timestamp_micros("first").cast(resolutions.schema["resolved_at"].dataType).alias("resolved_at"),
        F.col("first").isNull().alias("timed_out"))


def _after(micros):
    """The first millisecond after a time, or times; timers and watermarks are whole milliseconds."""
    return micros // 1000 + 1
