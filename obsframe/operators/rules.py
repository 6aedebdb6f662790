"""Recording rules and downsampling: metrics in, metrics out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.functions import labels as L, scalars as S
from obsframe.operators.ordered import exact_percentiles
from obsframe.operators.ranges import PERCENTILES, agg_column

PLAIN = ("avg", "sum", "max", "min", "count")
# Windows a recording rule may use.
RULE_WINDOWS = ("1m", "5m", "1h")


@dataclass(frozen=True)
class RecordingRule:
    input_metric: str
    output_metric: str
    aggregation: str
    window: str = "5m"
    group_by: tuple[str, ...] = ()


def validate(rule: RecordingRule, windows: Sequence[str] | None = RULE_WINDOWS) -> RecordingRule:
    if not rule.input_metric or not rule.output_metric:
        raise ValueError("input and output metric are required")
    if rule.aggregation not in PLAIN and rule.aggregation not in PERCENTILES:
        raise ValueError(f"unknown aggregation {rule.aggregation!r}")
    if windows is not None and rule.window not in windows or S.duration_ms(rule.window) <= 0:
        raise ValueError(f"unknown window {rule.window!r}")
    return rule


def _rule_structs(rules: Sequence[RecordingRule]) -> Column:
    """The rules as an array literal, so all of them are evaluated in one scan."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.input_metric).alias("input"), F.lit(r.output_metric).alias("output"),
            F.lit(r.aggregation).alias("agg"), F.lit(S.duration_ms(r.window)).cast("long").alias("window_ms"),
            F.array(*[F.lit(k) for k in r.group_by]).cast("array<string>").alias("group_by"))
        for i, r in enumerate(rules)])


def expand_rules(metrics: DataFrame, rules: Sequence[RecordingRule], as_of: int | Column | None) -> DataFrame:
    """One row per (point, rule that reads it) with the rule's group key."""
    name, ts = F.col("name"), F.col("ts_ms")

    def reads(r):
        ok = r["input"] == name
        if as_of is not None:
            ok = ok & (ts >= as_of - r["window_ms"]) & (ts <= as_of)
        return ok

    longest = max(S.duration_ms(r.window) for r in rules)
    points = metrics.filter(name.isin(*sorted({r.input_metric for r in rules})))
    if as_of is not None:
        points = points.filter(ts.between(as_of - longest, as_of))
    rows = points.select("labels", "value", "ts_ms", "seq",
                         F.explode(F.filter(_rule_structs(rules), reads)).alias("r"))
    return rows.select(
        "value", "ts_ms", F.col("r.rule").alias("rule"), F.col("r.output").alias("output"),
        F.col("r.agg").alias("agg"), F.col("r.group_by").alias("group_by"),
        F.transform("r.group_by", lambda k: F.coalesce(F.try_element_at("labels", k), F.lit(""))).alias("key"))


RULE_KEYS = ["rule", "output", "agg", "group_by", "key"]


def aggregate_rules(rows: DataFrame, extra_keys: Sequence[Column | str] = ()) -> DataFrame:
    """avg, sum, max, min and count rules in one partial aggregate."""
    out = rows.groupBy(*extra_keys, *RULE_KEYS).agg(
        F.sum("value").alias("_sum"), agg_column("max").alias("_max"), agg_column("min").alias("_min"),
        F.count(F.lit(1)).cast("double").alias("_count"))
    value = (F.when(F.col("agg") == "sum", F.col("_sum")).when(F.col("agg") == "avg", F.col("_sum") / F.col("_count"))
             .when(F.col("agg") == "max", F.col("_max")).when(F.col("agg") == "min", F.col("_min"))
             .otherwise(F.col("_count")))
    return out.withColumn("value", value).drop("_sum", "_max", "_min", "_count")


def rule_labels() -> Column:
    """Group labels of a rule row; a label the series lacks is left out."""
    return F.map_filter(F.map_from_arrays("group_by", "key"), lambda k, v: v != "")


def record(metrics: DataFrame, rules: Sequence[RecordingRule], as_of: int,
           windows: Sequence[str] | None = RULE_WINDOWS) -> DataFrame:
    """Evaluate recording rules at `as_of`: pooled raw points per group, written as new metric rows."""
    rules = [validate(r, windows) for r in rules]
    parts = []
    plain = [r for r in rules if r.aggregation in PLAIN]
    if plain:
        parts.append(aggregate_rules(expand_rules(metrics, plain, as_of)).select("output", "group_by", "key", "value"))
    ranked = [r for r in rules if r.aggregation in PERCENTILES]
    if ranked:
        rows = expand_rules(metrics, ranked, as_of)
        keys = ["rule", "output", "agg", "group_by", "key"]
        used = sorted({r.aggregation for r in ranked})
        pct = exact_percentiles(rows, keys, "value", {p: PERCENTILES[p] for p in used})
        value = F.lit(None).cast("double")
        for p in used:
            value = F.when(F.col("agg") == p, F.col(p)).otherwise(value)
        parts.append(pct.select("output", "group_by", "key", value.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("output").alias("name"), rule_labels().alias("labels"), "value",
                      F.lit(as_of).cast("long").alias("ts_ms"), F.lit(0).cast("long").alias("seq"))


# Downsampled tiers and how far back raw points are read.
TIERS = {":1m": 60_000, ":5m": 300_000}
RAW_WINDOW_MS = 3_600_000


def is_downsampled(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    cond = F.lit(False)
    for suffix in TIERS:
        cond = cond | name.endswith(suffix)
    return cond


def bucket_means(points: DataFrame, width_ms: int, suffix: str) -> DataFrame:
    """Mean per series and bucket; the bucket start becomes the timestamp."""
    return (points.groupBy("name", "labels", S.time_bucket(F.col("ts_ms"), width_ms).alias("ts_ms"))
            .agg(F.avg("value").alias("value"))
            .select(F.concat("name", F.lit(suffix)).alias("name"), "labels", "value", "ts_ms"))


def downsample(metrics: DataFrame, suffix: str, as_of: int, written: DataFrame | None = None,
               raw_window_ms: int = RAW_WINDOW_MS, width_ms: int | None = None) -> DataFrame:
    """Closed buckets of the raw series that are newer than what `written` holds for the same series."""
    width = width_ms or TIERS[suffix]
    open_bucket = as_of - as_of % width
    raw = metrics.filter(~is_downsampled("name") & F.col("ts_ms").between(as_of - raw_window_ms, as_of)
                         & (F.col("ts_ms") < open_bucket))
    out = bucket_means(raw, width, suffix)
    if written is not None:
        mark = (written.filter(F.col("name").endswith(suffix))
                .groupBy("name", "labels").agg(F.max("ts_ms").alias("_mark"))
                .select("name", L.labels_key("labels").alias("_key"), "_mark"))
        out = (out.withColumn("_key", L.labels_key("labels")).join(mark, ["name", "_key"], "left")
               .filter(F.col("_mark").isNull() | (F.col("ts_ms") > F.col("_mark"))).drop("_key", "_mark"))
    return out.withColumn("seq", F.lit(0).cast("long")).select("name", "labels", "value", "ts_ms", "seq")
