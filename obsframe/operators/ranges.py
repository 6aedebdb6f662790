"""Range functions over a trailing window, grouped forms, and instant values.

All results are `(labels, labels_key, value)`: one row per series or group. Every
function is a partial aggregate, so a hot series is combined map-side before the
shuffle; the label key is derived after the aggregate, on the few result rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.functions import labels as L
from obsframe.functions.scalars import duration_ms
from obsframe.operators.ordered import exact_percentiles, top_n_per_key
from obsframe.operators.select import Selector, as_selector, scan

DEFAULT_RANGE_MS = 300_000
PERCENTILES = {"p50": 50.0, "p95": 95.0, "p99": 99.0}
FUNCTIONS = ("avg", "max", "min", "sum", "count", "rate", "last")


def arrival() -> Column:
    return F.struct("ts_ms", "seq")


def agg_column(func: str, value: str = "value") -> Column:
    """One aggregate over points. NaN never wins max or min."""
    v = F.col(value)
    if func == "avg":
        return F.avg(v)
    if func == "sum":
        return F.sum(v)
    if func == "count":
        return F.count(F.lit(1)).cast("double")
    if func == "max":
        return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(float("-inf")))
    if func == "min":
        return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(float("inf")))
    if func == "last":
        return F.max_by(v, arrival())
    raise ValueError(f"unknown function {func!r}")


def range_agg(metrics: DataFrame, sel: Selector | str, func: str, window: str | int = DEFAULT_RANGE_MS,
              as_of: int = 0) -> DataFrame:
    """avg, max, min, sum, count, rate, last, p50, p95 or p99 over `[as_of - window, as_of]` per series."""
    window_ms = duration_ms(window, DEFAULT_RANGE_MS)
    points = scan(metrics, sel, as_of - window_ms, as_of)
    return with_key(_per_series(points, func, window_ms))


def _per_series(points: DataFrame, func: str, window_ms: int) -> DataFrame:
    if func in PERCENTILES:
        keyed = points.withColumn("labels_key", L.labels_key("labels"))
        values = exact_percentiles(keyed, ["labels_key"], "value", {"value": PERCENTILES[func]})
        labels = keyed.groupBy("labels_key").agg(F.any_value("labels").alias("labels"))
        return values.join(labels, "labels_key").select("labels", "value")
    if func == "rate":
        out = points.groupBy("labels").agg(
            F.max_by("value", arrival()).alias("last"), F.min_by("value", arrival()).alias("first"),
            F.count(F.lit(1)).alias("n"))
        return out.filter(F.col("n") >= 2).select(
            "labels", ((F.col("last") - F.col("first")) / F.lit(window_ms / 1000.0)).alias("value"))
    return points.groupBy("labels").agg(agg_column(func).alias("value"))


def with_key(df: DataFrame) -> DataFrame:
    return df.select("labels", L.labels_key("labels").alias("labels_key"), "value")


def group_agg(metrics: DataFrame, sel: Selector | str, func: str, by: Sequence[str],
              window: str | int = DEFAULT_RANGE_MS, as_of: int = 0) -> DataFrame:
    """Function per series, then the same function across the series of a group.

    `count` counts series; `rate` and `last` take the series with the highest label
    key. A missing label groups as the empty string.
    """
    per_series = range_agg(metrics, sel, func, window, as_of)
    groups = per_series.select("labels_key", "value", *[L.label("labels", k).alias(f"_by_{k}") for k in by])
    if func in ("rate", "last"):
        value = F.max_by("value", "labels_key")
    else:
        value = agg_column(func)
    out = groups.groupBy(*[f"_by_{k}" for k in by]).agg(value.alias("value"))
    if by:
        labels = F.create_map(*[x for k in by for x in (F.lit(k), F.col(f"_by_{k}"))])
    else:
        labels = F.create_map().cast("map<string,string>")
        out = out.filter(F.col("value").isNotNull())
    return with_key(out.select(labels.alias("labels"), "value"))


def instant(metrics: DataFrame, sel: Selector | str, as_of: int | None = None) -> DataFrame:
    """Latest value per series, without a lower time bound."""
    points = scan(metrics, as_selector(sel), None, as_of)
    return with_key(points.groupBy("labels").agg(agg_column("last").alias("value")))


def latest(metrics: DataFrame, sel: Selector | str, n: int) -> DataFrame:
    """Last n points of each series in arrival order, ascending rank from the newest."""
    points = scan(metrics, as_selector(sel)).withColumn("labels_key", L.labels_key("labels"))
    return top_n_per_key(points, ["labels_key"], [F.desc("ts_ms"), F.desc("seq")], n)


def collapse(vector: DataFrame) -> DataFrame:
    """A vector as one number: the unweighted mean of its samples (no row for an empty vector)."""
    return vector.agg(F.avg("value").alias("value")).filter(F.col("value").isNotNull())


def scalar(vector: DataFrame) -> Column:
    """The single value of a one-row result, as a scalar subquery usable in any expression."""
    return vector.select("value").scalar()
