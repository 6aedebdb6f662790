"""Continuous forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from obsframe.functions import labels as L, scalars as S
from obsframe.operators import alerts as A, incidents as I, logs as LOG, rules as RULES, stats as ST
from obsframe.operators.ranges import PERCENTILES, agg_column
from obsframe.operators.select import scan
from obsframe.sources import sinks

# Cadences and the metrics of the live view.
RULE_STEP_MS = 60_000
LIVE_METRICS = ("cpu_usage_percent", "memory_usage_percent", "memory_used_bytes", "disk_usage_percent")
LIVE_WINDOW_MS = 300_000
LIVE_LOGS = 20
LIVE_EVERY = "5 seconds"

BatchSink = Callable[[DataFrame, int], None]


def fan_out(stream: DataFrame, targets: Sequence[BatchSink]) -> DataStreamWriter:
    """Hand every micro-batch to several sinks; the batch is computed once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for t in targets:
                t(batch, batch_id)
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(write)


def with_event_time(metrics: DataFrame, lateness: str) -> DataFrame:
    return metrics.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)


def downsample(metrics: DataFrame, suffix: str = ":1m", lateness: str = "1 minute", width_ms: int | None = None) -> DataFrame:
    """Means per series and bucket; in append mode a bucket appears once, when it is closed."""
    width = width_ms or RULES.TIERS[suffix]
    raw = with_event_time(metrics.filter(~RULES.is_downsampled("name")), lateness)
    out = raw.groupBy(F.window("ts", f"{width} milliseconds"), "name", "labels").agg(F.avg("value").alias("value"))
    return out.select(F.concat("name", F.lit(suffix)).alias("name"), "labels", "value",
                      F.unix_millis("window.start").alias("ts_ms"), F.lit(0).cast("long").alias("seq"))


def record(metrics: DataFrame, rules: Sequence[RULES.RecordingRule], lateness_ms: int = 60_000, step_ms: int = RULE_STEP_MS,
           windows: Sequence[str] | None = RULES.RULE_WINDOWS, exact: bool = True) -> DataFrame:
    """Recording rules at every step over their trailing windows, both ends included.

    Each point is copied to the ticks whose window holds it and partially aggregated before
    the shuffle. Percentiles are exact and keep the distinct values of open windows in state;
    `exact=False` bounds that state with an approximate percentile.
    """
    by_window: dict[int, list] = {}
    for r in rules:
        by_window.setdefault(S.duration_ms(RULES.validate(r, windows).window), []).append(r)
    parts = []
    for window_ms, same in by_window.items():
        rows = RULES.expand_rules(metrics, same, None)
        tick = F.explode(F.sequence(F.ceil(F.col("ts_ms") / step_ms).cast("long"),
                                    F.floor((F.col("ts_ms") + window_ms) / step_ms).cast("long")))
        rows = rows.withColumn("tick", tick).withColumn("at", F.timestamp_millis(F.col("tick") * step_ms))
        rows = rows.withWatermark("at", f"{window_ms + lateness_ms} milliseconds")
        pick = lambda p: F.percentile("value", p / 100) if exact else F.percentile_approx("value", p / 100)
        aggs = [agg_column(f).alias(f) for f in RULES.PLAIN] + [
            pick(p).alias(n) for n, p in PERCENTILES.items() if any(r.aggregation == n for r in same)]
        out = rows.groupBy("at", *RULES.RULE_KEYS).agg(*aggs)
        value = F.lit(None).cast("double")
        for f in {r.aggregation for r in same}:
            value = F.when(F.col("agg") == f, F.col(f)).otherwise(value)
        parts.append(out.select(F.col("output").alias("name"), RULES.rule_labels().alias("labels"), value.alias("value"),
                                F.unix_millis("at").alias("ts_ms"), F.lit(0).cast("long").alias("seq")))
    return reduce(DataFrame.unionByName, parts)


def anomaly_batches(table: str, out: str, window_ms: int = ST.BASELINE_MS, **kw) -> BatchSink:
    """Append the batch to the metrics table and test its points against the trailing window.

    Only the part of the table that the batch's baseline needs is read back.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        span = batch.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        if span[0] is None:
            return
        sinks.append_metrics(batch, table, batch_id=batch_id)
        rows = scan(sinks.read_metrics(spark, table), None, span[0] - window_ms, span[1])
        new = batch.select("name", L.labels_key("labels").alias("labels_key"), "ts_ms").distinct()
        found = ST.anomalies_backfill(rows, window_ms, **kw)
        found.join(new, ["name", "labels_key", "ts_ms"], "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def change_batches(table: str, out: str, lookback_ms: int = ST.CHANGE_LOOKBACK_MS, **kw) -> BatchSink:
    """Append the batch and look for a change point in the trailing window of each metric."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("ts_ms")).first()[0]
        if newest is None:
            return
        sinks.append_metrics(batch, table, batch_id=batch_id)
        rows = sinks.read_metrics(batch.sparkSession, table)
        ST.change_points(rows, newest, lookback_ms, **kw).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def distinct_events(events: DataFrame, keys: Sequence[str], lateness: str = "1 hour") -> DataFrame:
    """Stream of change points or anomalies without repeats."""
    return events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def incident_batches(events_table: str, out: str, slots: Sequence[I.Slot] = (), timezone: str = "UTC") -> BatchSink:
    """Append alert events and rewrite the incidents that have opened so far."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("ts_ms")).first()[0]
        if newest is None:
            return
        batch.write.mode("overwrite").parquet(f"{events_table}/batch={batch_id}")
        events = batch.sparkSession.read.parquet(events_table)
        I.auto_incidents(events, newest, slots, timezone).write.mode("overwrite").parquet(out)
    return write


def live_snapshot(metrics: DataFrame, alert_events: DataFrame, logs: DataFrame, as_of: int,
                  names: Sequence[str] = LIVE_METRICS, window_ms: int = LIVE_WINDOW_MS) -> dict[str, DataFrame]:
    """The live view: newest value of a few metrics, alerts that are not inactive, newest logs in time order."""
    recent = scan(metrics, None, as_of - window_ms, as_of).filter(F.col("name").isin(*names))
    return {
        "metrics": recent.groupBy("name", "labels").agg(agg_column("last").alias("value")),
        "alerts": A.active(alert_events, as_of, include_pending=True),
        "logs": LOG.recent(logs.filter(F.col("ts_ms") <= as_of), LIVE_LOGS).orderBy("ts_ms", "seq"),
    }


def live_batches(read: Callable[[SparkSession], Mapping[str, DataFrame]], out: str, clock: Callable[[], int]) -> BatchSink:
    """Write the three small tables of the live view on every trigger."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        view = live_snapshot(as_of=clock(), **read(spark))
        if view["metrics"].isEmpty():
            return
        for name, df in view.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
    return write


def split_late(points: DataFrame, written: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Points still in time for a downsampled tier, and late ones whose bucket is already written."""
    width = RULES.TIERS[suffix]
    marks = written.filter(F.col("name").endswith(suffix)).groupBy("name", "labels").agg(F.max("ts_ms").alias("_mark"))
    marks = marks.select(F.regexp_replace("name", f"{suffix}$", "").alias("name"), L.labels_key("labels").alias("_key"), "_mark")
    rows = points.withColumn("_key", L.labels_key("labels")).join(marks, ["name", "_key"], "left")
    late = F.col("_mark").isNotNull() & (S.time_bucket(F.col("ts_ms"), width) <= F.col("_mark"))
    return (rows.filter(~late).drop("_key", "_mark"), rows.filter(late).drop("_key", "_mark"))
