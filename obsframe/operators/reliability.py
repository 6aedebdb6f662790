"""Probes, health checks, service-level objectives, event lists, replay schedule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from obsframe.operators.ordered import previous_value, range_slices, slice_totals, top_n_per_key
from obsframe.operators.ranges import collapse

# Window sizes of the probe status, and objective windows in minutes.
PROBE_HISTORY = 100
PROBE_RECENT = 20
WINDOW_MINUTES = {"1d": 1440.0, "7d": 10080.0, "30d": 43200.0}
DEFAULT_WINDOW = "30d"


def probe_status(results: DataFrame, history: int = PROBE_HISTORY, recent: int = PROBE_RECENT) -> DataFrame:
    """Latest result, availability over the last `history` results and the last few in time order, per probe."""
    last = top_n_per_key(results, ["name"], [F.desc("ts_ms"), F.desc("seq")], history)
    entry = F.struct("ts_ms", "seq", "status", "status_code", "response_ms")
    out = last.groupBy("name").agg(
        F.max(entry).alias("_l"), (F.avg((F.col("status") == "up").cast("double")) * 100).alias("uptime_pct"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= recent, entry))).alias("recent"))
    return out.select("name", "_l.status", "_l.status_code", "_l.response_ms", F.col("_l.ts_ms").alias("last_check_ms"),
                      "uptime_pct", "recent")


def overall_probe_status(statuses: DataFrame) -> DataFrame:
    """operational when nothing is down (or nothing is probed), down when everything is, else degraded."""
    down, n = F.count_if(F.col("status") == "down"), F.count(F.lit(1))
    return statuses.agg(F.when(down == 0, "operational").when(down == n, "down").otherwise("degraded").alias("overall"))


def worst_check(checks: DataFrame) -> DataFrame:
    """Worst of healthy < degraded < unhealthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    names = F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy"))
    return checks.agg(F.element_at(names, F.coalesce(F.max(rank), F.lit(0)) + 1).alias("overall"))


@dataclass(frozen=True)
class Objective:
    name: str
    target_percent: float
    window: str = DEFAULT_WINDOW


def objectives_frame(spark: SparkSession, objectives: Sequence[Objective]) -> DataFrame:
    rows = []
    for o in objectives:
        if not o.name or not 0 < o.target_percent < 100:
            raise ValueError("an objective needs a name and a target between 0 and 100")
        window = o.window if o.window in WINDOW_MINUTES else DEFAULT_WINDOW
        rows.append((o.name, float(o.target_percent), window, WINDOW_MINUTES[window]))
    return spark.createDataFrame(rows, "name string, target_percent double, window string, minutes double")


def indicators(vectors: Mapping[str, DataFrame]) -> DataFrame:
    """Per-objective expression results as one frame (name, value): a vector counts as its mean."""
    parts = [collapse(v).select(F.lit(n).alias("name"), "value") for n, v in vectors.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bool_indicator(vector: DataFrame) -> DataFrame:
    """A threshold result as an indicator: 100 when true, 0 when false."""
    return vector.withColumn("value", F.when(F.col("result"), 100.0).otherwise(0.0))


def objective_status(objectives: DataFrame, values: DataFrame) -> DataFrame:
    """Indicator clipped to 0-100 and the error budget in minutes; no data counts as 0.

    The window sets the size of the budget only, not the range the indicator is read over.
    """
    out = objectives.join(values, "name", "left")
    sli = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("value", F.lit(0.0))))
    out = (out.withColumn("current_sli", sli)
           .withColumn("budget_total", (1 - F.col("target_percent") / 100) * F.col("minutes"))
           .withColumn("budget_consumed", F.greatest(F.lit(0.0), (1 - F.col("current_sli") / 100) * F.col("minutes"))))
    left = (F.col("budget_total") - F.col("budget_consumed")) / F.col("budget_total") * 100
    return out.select("name", "target_percent", "window", "current_sli", "budget_total", "budget_consumed",
                      F.greatest(F.lit(0.0), F.least(F.lit(100.0), left)).alias("budget_remaining_pct"),
                      (F.col("current_sli") >= F.col("target_percent")).alias("healthy"))


def newest(events: DataFrame, limit: int | None = None, where: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Newest-first view over an append-only event table; whole unless the caller sets a limit."""
    rows = (events if where is None else events.filter(where)).orderBy(F.desc("ts_ms"), *ties)
    return rows.limit(limit) if limit else rows


def newest_per_key(events: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Newest-first history of each key, for example the runs of each test."""
    return top_n_per_key(events, keys, [F.desc("ts_ms"), F.desc("seq")], limit)


def parse_speed(text: str) -> float:
    """`2x`, `0.5` or empty (1); anything not positive is invalid."""
    if text == "":
        return 1.0
    try:
        speed = float(text.strip().lower().removesuffix("x"))
    except ValueError:
        raise ValueError("invalid speed multiplier") from None
    if not speed > 0:
        raise ValueError("invalid speed multiplier")
    return speed


def replay_schedule(recording: DataFrame, speed: str = "1x", keys: Sequence[str] = ("recording",),
                    slices: int | None = None) -> DataFrame:
    """Pause before each point, and when it is due after the start, in milliseconds.

    A pause is the gap to the point before it in recorded order divided by the speed; a
    point that is not later causes none.
    """
    keys, order = list(keys), ["seq"]
    rows = previous_value(range_slices(recording, keys + order, slices), keys, order, "ts_ms", "_prev")
    gap = F.col("ts_ms") - F.col("_prev")
    delay = F.when((F.col("_prev") > 0) & (gap > 0), F.floor(gap / F.lit(parse_speed(speed)))).otherwise(0)
    rows = rows.withColumn("delay_ms", delay.cast("long"))
    return slice_totals(rows, keys, order, {"replay_at_ms": F.col("delay_ms")}).drop("_prev", "_slice")
