"""Roll-ups over the audit event table and its companions, across all runs at once.

Events carry ts, run_id, event_type and sparse columns. Runs may be very uneven; every roll-up therefore
combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefold.functions.labels import label_of
from rulefold.functions.signatures import digest
from rulefold.session import ensure_checkpoint_dir

EVENTS = (
    "ts string, run_id string, event_type string, target string, outcome string, rule_kind string, "
    "body_signature string, ltm_hit boolean, source_mode string, source_model string, iteration int, passed boolean, "
    "n_findings int, ticket_kind string, event_id string, table string, reason string, "
    "chosen_option string, resolved_by string, ambiguity_class string"
)

# Short code of each step in an agent chain.
STEP_CODES = {"cg_complete": "CG", "v_complete": "V", "r_complete": "R"}


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def event_filter(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of the chosen kinds; the filter reaches the scan."""
    return events.where(F.col("event_type").isin(kinds))


def shown_of(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Per run: events shown under a filter and events in total."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("event_type").isin(kinds)).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def run_counters(events: DataFrame) -> DataFrame:
    """The run counters, one row per run."""
    ends = _is("derivation_unresolved") | _is("derivation_skipped")
    return events.groupBy("run_id").agg(
        F.count_if(_is("hitl_open") | _is("hitl_auto_resolved")).alias("sr_findings"),
        F.count_if(_is("hitl_auto_resolved")).alias("sr_auto_resolved"),
        F.count_if(_is("hitl_open")).alias("hitl_tickets_opened"),
        F.count_if(_is("cg_complete") & F.col("ltm_hit")).alias("cg_ltm_hits"),
        F.count_if(_is("apply_complete")).alias("derivations_verified"),
        F.count_if(ends).alias("derivations_unresolved"),
        F.count_if(_is("derivation_skipped")).alias("derivations_skipped"),
        F.count_if(_is("r_complete")).alias("refinement_iterations"),
    )


def memory_writes(events: DataFrame, table: str = "table") -> DataFrame:
    """Rows written to each memory table, one row per run."""
    wrote = _is("ltm_write")
    return events.groupBy("run_id").agg(
        F.count_if(wrote & (F.col(table) == "rule_patterns")).alias("rule_patterns"),
        F.count_if(wrote & (F.col(table) == "ambiguity_resolutions")).alias("ambiguity_resolutions"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


def event_kinds(events: DataFrame) -> DataFrame:
    """Distinct event types of each run, from pre-aggregated pairs."""
    return event_counts(events).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_kinds"), F.array_sort(F.collect_list("event_type")).alias("kinds"))


def rule_sources(events: DataFrame) -> DataFrame:
    """Where normalised rules came from, per run."""
    return event_filter(events, ["cg_complete"]).groupBy("run_id", "source_mode").agg(
        F.count(F.lit(1)).alias("n_rules"), F.count_if("ltm_hit").alias("n_from_memory"))


def latest_status(transitions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current status per key: that of the last transition."""
    return transitions.groupBy(*keys).agg(
        F.max_by("status", F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n_transitions"))


def outcome_class(counters: DataFrame, total: str = "n_derivations") -> DataFrame:
    """Class and sentence of each run from its counters and its number of derivations."""
    n, verified = F.col(total), F.col("derivations_verified")
    opened, auto = F.col("hitl_tickets_opened"), F.col("sr_auto_resolved")
    klass = (
        F.when(n == 0, F.lit("nothing_produced"))
        .when((verified == n) & (opened == 0), F.lit("all_verified"))
        .when(verified == n, F.lit("verified_with_questions"))
        .otherwise(F.lit("partial"))
    )
    partial = F.concat_ws(
        " ",
        F.format_string("%d of %d variables verified.", verified, n),
        F.when(F.col("derivations_unresolved") > 0, F.format_string("%d unresolved.", F.col("derivations_unresolved"))),
        F.when(F.col("derivations_skipped") > 0, F.format_string("%d skipped.", F.col("derivations_skipped"))),
        F.when(opened > 0, F.format_string("%d questions raised.", opened)),
    )
    text = (
        F.when(klass == "nothing_produced", F.lit("No variables were produced."))
        .when((klass == "all_verified") & (auto > 0),
              F.format_string("All %d variables verified; %d questions answered from memory.", n, auto))
        .when(klass == "all_verified", F.format_string("All %d variables verified; no questions.", n))
        .when(klass == "verified_with_questions",
              F.format_string("All %d variables verified; %d questions raised.", n, opened))
        .otherwise(partial)
    )
    return counters.withColumn("outcome_class", klass).withColumn("outcome_text", text)


BUCKET_ROWS = 1_000_000
BUCKETS = [("DAY", 86_400), ("HOUR", 3_600), ("MINUTE", 60), ("SECOND", 1)]


def time_bucket(rows: DataFrame, ts: str) -> str:
    """Coarsest time unit that holds at most BUCKET_ROWS rows on average; one small aggregate decides."""
    seconds = F.unix_timestamp(F.max(ts).cast("timestamp")) - F.unix_timestamp(F.min(ts).cast("timestamp"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), seconds.alias("s")).first()
    spans = [unit for unit, width in BUCKETS if row["n"] * width <= BUCKET_ROWS * max(row["s"] or 1, 1)]
    return spans[0] if spans else "SECOND"


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `_range`: the number of the range of `order` they were dealt to, written to the shared folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    hashable = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small ranges apart
    dealt = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order], F.xxhash64(*hashable))
    return dealt.withColumn("_range", F.spark_partition_id()).checkpoint()


def step_numbers(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Add `step_no`: the rank of each row in (ts, tie) order within its key.

    A key, or a key in one second, may hold a large share of all rows. So rows are dealt by ranges of (key, ts, tie), equal ones by all their
    cells too, ranked within their range, and shifted by the rows of the key in earlier ranges; the shift is computed on counts only. Ranges are
    kept by a checkpoint, as they are sampled. Rows without a time come first, a NULL key is a key of its own.
    """
    ranged = in_ranges(rows, [*keys, ts, tie])
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range", *keys).orderBy(ts, tie)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside)).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_range", *keys)]
    return ranked.join(shifts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in rows.columns], (F.col("_rank") + F.col("_shift")).alias("step_no"))


def agent_steps(events: DataFrame, ts: str = "ts", tie: str = "event_seq") -> DataFrame:
    """Steps CG / V / R of every (run_id, target) in event order, one row per step."""
    steps = event_filter(events, list(STEP_CODES)).where("target IS NOT NULL")
    code = F
    for kind, short in STEP_CODES.items():
        code = code.when(_is(kind), F.lit(short))
    steps = steps.select("run_id", "target", ts, tie, code.otherwise(F.lit(None)).alias("code"))
    return step_numbers(steps, ["run_id", "target"], ts, tie).select("run_id", "target", "step_no", "code")


def agent_chains(steps: DataFrame) -> DataFrame:
    """Steps as ordered text: one row per run and derivation, however long its history. `agent_steps` is the form without long cells."""
    listed = F.array_sort(F.collect_list(F.struct("step_no", "code")))
    return steps.groupBy("run_id", "target").agg(
        F.array_join(F.transform(listed, lambda s: s["code"]), ">").alias("agent_chain"))


def no_progress(retries: DataFrame) -> DataFrame:
    """Iterations that repeat the previous body and findings; an equi-join on the iteration before.

    The iteration is part of the key, so a long history spreads out; repeated rows are merged before they are
    looked up.
    """
    now = retries.select("run_id", "derivation", "iteration", "body_hash", "findings_signature")
    before = now.withColumn("iteration", F.col("iteration") + 1).distinct()
    return now.join(before, now.columns, "left_semi")


def findings_signatures(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Signature of the distinct checks violated per key; check ids are few, so the sets stay small."""
    listed = F.array_sort(F.collect_set(F.struct("layer", "property_id", "derivation")))
    text = F.to_json(F.transform(listed, lambda s: F.array(s["layer"], s["property_id"], s["derivation"])))
    return findings.groupBy(*keys).agg(digest(text).alias("findings_signature"))


def run_summary(entries: DataFrame, report: DataFrame, findings: DataFrame) -> DataFrame:
    """Per run and derivation: labels, memory hit and the blocking findings as text.

    entries(name, rationale), report(run_id, derivation, status, rule_kind, ltm_hit, position),
    findings(run_id, derivation, layer, property_id, severity, message if there is one). Entries and report are matched by study_id and run_id too
    where both have them; of entries that share all these, one text is shown, so no row of the report is multiplied.
    """
    if "message" not in findings.columns:
        findings = findings.withColumn("message", F.lit(None).cast("string"))
    blocking = findings.where("severity = 'error'").groupBy("run_id", "derivation").agg(
        F.count(F.lit(1)).alias("n_blocking"),
        F.array_join(F.array_sort(F.collect_set("layer")), ", ").alias("layers"),
        F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("messages"),
        F.array_join(F.array_sort(F.collect_set(label_of("property", F.col("property_id")))), "; ").alias("blocking"))
    status = F.coalesce(F.col("status"), F.lit("missing"))
    keys = [c for c in ("study_id", "run_id") if c in entries.columns and c in report.columns]
    texts = entries.select(*keys, F.col("name").alias("derivation"), "rationale")
    texts = texts.groupBy(*keys, "derivation").agg(F.min("rationale").alias("rationale"))
    return (
        report.join(blocking, ["run_id", "derivation"], "left")
        .join(texts, [*keys, "derivation"], "left")
        .select(
            "run_id", "position", "derivation", label_of("status", status).alias("status"),
            label_of("rule_kind", F.col("rule_kind")).alias("rule_type"),
            F.trim(F.regexp_replace("rationale", r"\s+", " ")).alias("rationale"),
            F.coalesce("ltm_hit", F.lit(False)).alias("ltm_hit"),
            F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"), F.coalesce("blocking", F.lit("")).alias("blocking"),
            F.coalesce("layers", F.lit("")).alias("layers"), F.coalesce("messages", F.lit("")).alias("messages"))
    )


def decision_list(events: DataFrame) -> DataFrame:
    """Each question with its class and its decision, from resolved and auto-resolved events."""
    rows = event_filter(events, ["hitl_resolved", "hitl_auto_resolved"])
    auto = _is("hitl_auto_resolved")
    decision = (
        F.when(F.col("chosen_option").isNull(), F.lit("(no decision recorded)"))
        .when(F.col("chosen_option") == "ltm_replay", F.lit("Auto-resolved from memory"))
        .otherwise(label_of("option", F.col("chosen_option")))
    )
    return rows.select(
        "run_id", F.coalesce("target", F.lit("(unspecified variable)")).alias("variable"), "ambiguity_class", decision.alias("decision"),
        F.when(auto, F.lit("Auto-resolved from memory")).otherwise(F.lit("Resolved by the reviewer")).alias("origin"))


def runs_pending(tickets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Open tickets per run, latest run first for readers: (run_id, n_tickets, n_open, needs_review)."""
    from rulefold.operators.review import pending

    opened = tickets.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_tickets"))
    waiting = pending(tickets, resolutions).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_open"))
    joined = opened.join(waiting, "run_id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    return joined.withColumn("needs_review", F.col("n_open") > 0)


def runs_latest_first(runs: DataFrame) -> DataFrame:
    """Distinct runs in listing order; run ids begin with their time, so text order is time order."""
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.desc("run_id"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest id."""
    return runs.agg(F.max("run_id").alias("run_id"))


def flatten_reports(reports: DataFrame) -> DataFrame:
    """Verification reports (run_id, report JSON) as one row per derivation."""
    one = (
        "struct<status:string,rule_kind:string,body_signature:string,iterations:int,agent_chain:array<string>,"
        "findings:array<struct<layer:string,property_id:string,severity:string,message:string>>,ltm_hit:boolean,"
        "reason:string>"
    )
    parsed = F.from_json("report", f"derivations map<string,{one}>")["derivations"]
    return reports.select("run_id", F.explode(parsed).alias("derivation", "r")).select(
        "run_id", "derivation", "r.status", "r.rule_kind", "r.body_signature", "r.iterations",
        F.array_join("r.agent_chain", ">").alias("agent_chain"),
        F.greatest(F.coalesce(F.size("r.findings"), F.lit(0)), F.lit(0)).alias("n_findings"),
        F.coalesce("r.ltm_hit", F.lit(False)).alias("ltm_hit"), "r.reason")
