"""Derive, check and write in one pass; publish only what passed.

The checks of all derivations, the counts of what `error` policies forbid and the rows read ride along as observed metrics of the job that writes
the derived table to a staging folder. Only then is it known whether the table may be seen: it is moved to its place if no `error` check
fired and no policy was hit, and removed otherwise. Date formats and types of durations, if they are open, take one pass before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.operators.lineage import with_lineage
from rulefold.operators.policy import Blocked
from rulefold.operators.verify import Checked, check_aggregates
from rulefold.plans.apply import Derived, apply_spec
from rulefold.plans.spec import Spec
from rulefold.session import Folder


class NotPublished(RuntimeError):
    """Nothing was published; `result` has the checks and the counts of what policies forbid."""

    def __init__(self, result: Published):
        failed = sorted(n for n, b in result.blocked.items() if b.total_blocked) + sorted(result.failed)
        super().__init__(f"nothing was published: {', '.join(dict.fromkeys(failed))}")
        self.result = result


@dataclass
class Published:
    """What one pass found. `published` tells whether `path` holds the table."""

    path: str
    published: bool
    rows_read: int
    rows_written: int
    checks: Checked
    blocked: dict[str, Blocked]
    failed: set[str]
    derived: Derived


def publish(
    df: DataFrame, spec: Spec, path: str, *, key: str | list[str] | None = None, date_formats: Mapping[str, str] | None = None, integral: str = "auto",
    allow_overwrite: bool = False, partition_by: list[str] | None = None, sample: bool = False, raise_on_failure: bool = True,
) -> Published:
    """Apply a spec to `df` and publish the derived table as Parquet at `path`, which must not exist yet.

    The write job is the only one that reads the rows: checks, `error` policies and row counts before and after are its metrics. A failing spec
    leaves nothing at `path`, nor in the staging folder beside it; with `raise_on_failure` it raises NotPublished, otherwise the result says so. An empty table is
    published with its columns. `key` adds the lineage column; `sample` keeps a violating row per check. A job that dies midway leaves a
    staging folder, whose name starts with `_`, so no reader of the parent folder takes it for data.
    """
    spark = df.sparkSession
    read, wrote = Observation(), Observation()
    derived = apply_spec(df.observe(read, F.count(F.lit(1)).alias("n")), spec, date_formats=date_formats, integral=integral, on_error="defer", allow_overwrite=allow_overwrite)
    helpers = [c for c in derived.checked.columns if c not in derived.df.columns]
    aggregates, table = check_aggregates(derived.checked, derived.rules, derived.bodies, sample=sample)
    policies = [(n, p, c) for n, by in derived.blocked.items() for p, c in by.items()]
    aggregates += [F.count_if(c).alias(f"b{i}") for i, (_, _, c) in enumerate(policies)]
    whole = derived.checked.observe(wrote, *aggregates)
    if key is not None:
        whole = with_lineage(replace(derived, df=whole), key)
    folder = Folder(spark, path)
    if folder.exists(path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/').rpartition('/')[0]}/_staging-{uuid.uuid4().hex}"
    done = False
    try:
        writer = whole.drop(*helpers).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
        result = _result(spark, path, derived, table, policies, read.get["n"], wrote.get)
        if result.published:
            folder.move(staging, path)
        done = result.published
    finally:
        if not done:
            folder.remove(staging)
    if not done and raise_on_failure:
        raise NotPublished(result)
    return result


def _result(spark: SparkSession, path: str, derived: Derived, table: Column, policies: list[tuple[str, str, Column]], rows_read: int, metrics: dict) -> Published:
    blocked: dict[str, Blocked] = {}
    for i, (name, policy, _) in enumerate(policies):
        blocked.setdefault(name, Blocked(metrics["n"])).by_policy[policy] = metrics[f"b{i}"]
    shape = T.StructType([T.StructField(k, T.StringType() if k[0] == "s" else T.LongType()) for k in metrics])
    checks = Checked(_with_rows(spark.createDataFrame([tuple(metrics.values())], shape).select(F.inline(table)), derived, rows_read))
    failed = {r["derivation"] for r in checks.verdicts.where("NOT passed").collect()}  # a row per derivation
    fine = not failed and not any(b.total_blocked for b in blocked.values())
    return Published(path, fine, rows_read, metrics["n"], checks, blocked, failed, derived)


def _with_rows(checks: DataFrame, derived: Derived, rows_read: int) -> DataFrame:
    """With a row per derivation that compares the rows written with those read in the same job."""
    changed = F.abs(F.first("n_rows") - F.lit(rows_read))
    kept = checks.groupBy("derivation").agg(
        F.lit("L1").alias("layer"), F.lit("L1.row_count_preserved").alias("property_id"), F.lit("error").alias("severity"),
        F.lit(f"row count differs from the input's {rows_read}").alias("message"), F.first("n_rows").alias("n_rows"),
        changed.alias("n_violations"), F.lit(None).cast("string").alias("sample"))
    return checks.unionByName(kept)
