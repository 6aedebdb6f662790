"""Series selection and dashboard reads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from obsframe.functions import labels as L, scalars as S


@dataclass(frozen=True)
class Selector:
    name: str
    labels: Mapping[str, str] = field(default_factory=dict)


def metric(name: str, **labels: str) -> Selector:
    """`metric("cpu_usage_percent", host="A")`; a downsampled tier is the name suffix `:1m` / `:5m`."""
    return Selector(name, labels)


def as_selector(sel: Selector | str) -> Selector:
    return Selector(sel) if isinstance(sel, str) else sel


def scan(metrics: DataFrame, sel: Selector | str | None = None,
         start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Points of the selected series in `[start, end]`; name, time and day filters reach the file scan."""
    out = metrics
    if sel is not None:
        sel = as_selector(sel)
        out = out.filter(F.col("name") == sel.name)
        if sel.labels:
            out = out.filter(L.matches("labels", sel.labels))
    if start_ms is not None:
        out = out.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        out = out.filter(F.col("ts_ms") <= end_ms)
    if "day" in metrics.columns:
        if start_ms is not None:
            out = out.filter(F.col("day") >= F.lit(_day(start_ms)))
        if end_ms is not None:
            out = out.filter(F.col("day") <= F.lit(_day(end_ms)))
    return out


def _day(ms: int):
    import datetime
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)).date()


def series_points(metrics: DataFrame, name: str, labels: Mapping[str, str], start_ms: int, end_ms: int) -> DataFrame:
    """One exact series (same full label set) in a time range, found by its fingerprint."""
    wanted = L.series_id(F.lit(name), F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
                         if labels else F.create_map().cast("map<string,string>"))
    have = F.col("series_id") if "series_id" in metrics.columns else L.series_id("name", "labels")
    return scan(metrics, name, start_ms, end_ms).filter(have == wanted)


def compare(vector: DataFrame, op: str, threshold: float) -> DataFrame:
    """Threshold flag per row. An unknown operator is false."""
    return vector.withColumn("result", S.compare(op, F.col("value"), F.lit(float(threshold))))


def metric_names(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Sorted distinct names with a case-insensitive prefix."""
    names = metrics.select("name").distinct()
    if prefix:
        names = names.filter(F.startswith(F.lower("name"), F.lit(prefix.lower())))
    return names.orderBy("name")


def timeseries(metrics: DataFrame, targets: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """Raw points of each target for a dashboard: `(target, ts_ms, value)`, one row per point.

    Long form, so a series with very many points is never one array in one row.
    """
    rows = scan(metrics, None, start_ms, end_ms).filter(F.col("name").isin(*targets))
    return rows.select(L.display_name("name", "labels").alias("target"), "ts_ms", "value", "seq")


def current_values(vector: DataFrame, target: str, as_of_ms: int) -> DataFrame:
    """Dashboard form of an expression result: its value now, one row per label set."""
    return vector.select(L.display_name(F.lit(target), "labels").alias("target"),
                         F.lit(as_of_ms).cast("long").alias("ts_ms"), "value")


def catalog_counts(metrics: DataFrame, logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct names, series and points, and log and trace totals, in one row."""
    series = metrics.groupBy("name", "labels").agg(F.count(F.lit(1)).alias("n"))
    names = series.groupBy("name").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n"))
    m = names.agg(F.count(F.lit(1)).alias("metrics"), F.coalesce(F.sum("s"), F.lit(0)).alias("series"),
                  F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    log_total = logs.agg(F.count(F.lit(1))).scalar()
    trace_total = (spans.filter((F.col("trace_id") != "") & (F.col("span_id") != ""))
                   .select("trace_id").distinct().agg(F.count(F.lit(1))).scalar())
    return m.withColumn("logs", log_total).withColumn("traces", trace_total)
