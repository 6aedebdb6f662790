"""Retention: age and length limits by name pattern, deletes, log and trace cleanup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.functions import labels as L
from obsframe.operators.ordered import top_n_per_key


@dataclass(frozen=True)
class Policy:
    name: str
    pattern: str
    max_age_s: int = 0
    max_points: int = 0
    builtin: bool = False


# Built-in policies and the log and trace limits.
BUILTIN_POLICIES = (
    Policy("raw", r"^[^:]+$", 3600, builtin=True),
    Policy("1m-ds", r".*:1m$", 86400, builtin=True),
    Policy("5m-ds", r".*:5m$", 7 * 86400, builtin=True),
)
LOGS_PER_SOURCE = 10_000
LOG_AGE_MS = 86_400_000
TRACE_AGE_MS = 3_600_000
MAX_TRACES = 1_000


def policy_of(name: Column, policies: Sequence[Policy]) -> Column:
    """The first matching custom policy, else the first matching built-in one, as a struct; NULL if none.

    One CASE over constant patterns, each compiled once; meant for distinct names, not for points.
    """
    ordered = [p for p in policies if not p.builtin] + [p for p in policies if p.builtin]
    out = F.when(F.lit(False), F.lit(None).cast("struct<policy:string,max_age_s:bigint,max_points:bigint>"))
    for p in ordered:
        this = F.struct(F.lit(p.name).alias("policy"), F.lit(p.max_age_s).cast("long").alias("max_age_s"),
                        F.lit(p.max_points).cast("long").alias("max_points"))
        out = out.when(name.rlike(p.pattern), this)
    return out


def matched_policies(metrics: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Each distinct metric name with the policy that governs it."""
    names = metrics.select("name").distinct().withColumn("_p", policy_of(F.col("name"), policies))
    return names.select("name", "_p.policy", "_p.max_age_s", "_p.max_points")


def enforce(metrics: DataFrame, policies: Sequence[Policy], as_of: int) -> DataFrame:
    """Points that survive: young enough, then the newest `max_points` per series."""
    columns = metrics.columns
    named = matched_policies(metrics, policies).select(F.col("name").alias("_name"), F.struct("max_age_s", "max_points").alias("_p"))
    rows = metrics.join(named, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")
    age = F.coalesce(F.col("_p.max_age_s"), F.lit(0))
    rows = rows.filter((age == 0) | (F.col("ts_ms") >= F.lit(as_of) - age * 1000))
    if not any(p.max_points for p in policies):
        return rows.select(*columns)
    limit = F.coalesce(F.col("_p.max_points"), F.lit(0))
    free = rows.filter(limit == 0)
    capped = rows.filter(limit > 0).withColumn("_key", L.labels_key("labels")).withColumn("_limit", limit)
    kept = top_n_per_key(capped.drop("_p"), ["name", "_key"], [F.desc("ts_ms"), F.desc("seq")], F.col("_limit"))
    return free.select(*columns).unionByName(kept.select(*columns))


def keep_last(rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """The newest n rows of each key."""
    return top_n_per_key(rows, keys, [F.desc(c) for c in order], n).drop("rank")


def keep_logs(logs: DataFrame, as_of: int, per_source: int = LOGS_PER_SOURCE, age_ms: int = LOG_AGE_MS) -> DataFrame:
    return keep_last(logs.filter(F.col("ts_ms") >= as_of - age_ms), ["source"], per_source)


def keep_traces(spans: DataFrame, as_of: int, age_ms: int = TRACE_AGE_MS, cap: int | None = None) -> DataFrame:
    """Spans of traces that started within the age limit; `cap` also keeps only the newest traces."""
    start = spans.groupBy("trace_id").agg(F.min("start_ms").alias("_start"), F.min("seq").alias("_first"))
    kept = start.filter(F.col("_start") >= as_of - age_ms)
    if cap is not None:
        kept = kept.orderBy(F.desc("_first"), F.desc("trace_id")).limit(cap)
    return spans.join(kept.select("trace_id"), "trace_id", "left_semi")


def delete_series(metrics: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The table without one metric, and a one-row frame with the number of series dropped."""
    gone = metrics.filter(F.col("name") == name).groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    return metrics.filter(F.col("name") != name), gone.agg(F.count(F.lit(1)).alias("deleted"))
