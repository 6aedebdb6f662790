"""Streaming forms run over the test tables as streams; the SQL is that of the batch form."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import alerts as A, rules as RULES
from obsframe.plans import alerting, governance, statistics, tables as T  # noqa: F401
from obsframe.plans.registry import ORACLES, query
from obsframe.sources import payloads, sinks
from obsframe.streaming import pipelines as PIPE, processors as PROC
from obsframe.streaming.runner import drain, run_batches, scratch


def event_stream(spark, sf):
    """The events table as a stream of files."""
    schema = T.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return ev.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _points(df):
    return df.select("name", L.labels_key("labels").alias("labels_key"), "value", "ts_ms")


@query("stream_downsample", f"""WITH {T.METRICS_SQL}
  SELECT name || ':1h' AS name, labels_key, avg(value) AS value, (ts_ms // {T.HOUR}) * {T.HOUR} AS ts_ms FROM m
  GROUP BY name, labels_key, (ts_ms // {T.HOUR}) * {T.HOUR}""")
def stream_downsample(spark, sf):
    """Complete mode, so that the newest buckets are there too."""
    return _points(drain(PIPE.downsample(T.metrics_of(event_stream(spark, sf)), ":1h", "1 hour", T.HOUR), "complete"))


STREAM_RULES = [RULES.RecordingRule("event_click", "click:sum", "sum", "12h", ("host",)),
                RULES.RecordingRule("event_click", "click:p95", "p95", "12h", ("region",)),
                RULES.RecordingRule("event_view", "view:max", "max", "12h")]


def _rule_sql(name: str, out: str, agg: str, label: str) -> str:
    key = f"'{label}=' || {label} || chr(10)" if label else "''"
    return f"""SELECT '{out}' AS name, {key} AS labels_key, round({agg}, 6) AS value, t AS ts_ms FROM m
      JOIN ticks ON ts_ms BETWEEN t - {12 * T.HOUR} AND t WHERE name = '{name}' GROUP BY {label + ',' if label else ''} t"""


@query("stream_rules", f"""WITH {T.METRICS_SQL},
  ticks AS (SELECT unnest(generate_series((SELECT min(ts_ms) FROM m) // {6 * T.HOUR} * {6 * T.HOUR}, {T.AS_OF + 12 * T.HOUR}, {6 * T.HOUR})) AS t)
  {_rule_sql("event_click", "click:sum", "sum(value)", "host")}
  UNION ALL {_rule_sql("event_click", "click:p95", "quantile_cont(value, 0.95)", "region")}
  UNION ALL {_rule_sql("event_view", "view:max", "max(value)", "")}""")
def stream_rules(spark, sf):
    out = PIPE.record(T.metrics_of(event_stream(spark, sf)), STREAM_RULES, step_ms=6 * T.HOUR, windows=None)
    return _points(drain(out, "complete")).withColumn("value", F.round("value", 6))


@query("stream_alert_events", ORACLES["alert_events"])
def stream_alert_events(spark, sf):
    """Rule ticks as a stream through the keyed state machine."""
    ticks = A.conditions(T.metrics(spark, sf), A.rules_frame(spark, alerting.RULES), alerting.FIRST, T.AS_OF, alerting.STEP)
    spot = scratch(spark, "ticks")
    ticks.write.parquet(spot)
    out = drain(PROC.alert_events(spark.readStream.schema(ticks.schema).parquet(spot), alerting.STEP))
    return out.select("rule", "ts_ms", "state", F.round("value", 6).alias("value"), "severity")


@query("stream_rate_limit", ORACLES["rate_limit"])
def stream_rate_limit(spark, sf):
    rows = event_stream(spark, sf).select(
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("key-"), F.col("user_id") % 10)).alias("key"),
        "ts_ms", F.col("event_id").alias("seq"))
    return drain(PROC.rate_limit(rows, 3, Fraction(1, 2400), tick_ms=1000)).select("key", "seq", "allowed", "remaining")


@query("stream_agents", f"""WITH a AS (SELECT 'agent-' || user_id AS agent, min(epoch_us(ts) // 1000) AS registered_ms,
    max(epoch_us(ts) // 1000) AS last_seen_ms, max(ts) AS last FROM events GROUP BY user_id),
  w AS (SELECT epoch_us(max(ts)) // 1000 - {T.HOUR} AS mark FROM events)
  SELECT agent, 'online' AS status, registered_ms, last_seen_ms, last_seen_ms AS ts_ms FROM a
  UNION ALL SELECT agent, 'offline', registered_ms, last_seen_ms, last_seen_ms + {6 * T.HOUR} + 1 FROM a, w
  WHERE last_seen_ms + {6 * T.HOUR} + 1 <= mark""")
def stream_agents(spark, sf):
    """Users as agents: online at first sight, offline once silent for six hours of event time."""
    rows = event_stream(spark, sf).select(F.concat(F.lit("agent-"), "user_id").alias("agent"), "ts_ms")
    return drain(PROC.agent_changes(rows, 6 * T.HOUR, "1 hour")).select("agent", "status", "registered_ms", "last_seen_ms", "ts_ms")


@query("stream_fan_out", f"""WITH {T.METRICS_SQL} SELECT 'all' AS target, name, count(*) AS points FROM m GROUP BY name
  UNION ALL SELECT 'large', name, count(*) FROM m WHERE value > 10000 GROUP BY name""")
def stream_fan_out(spark, sf):
    """One stream, two observers."""
    out = scratch(spark, "fan-out")
    all_ = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/target=all/batch={i}")
    large = lambda batch, i: batch.filter("value > 10000").write.mode("overwrite").parquet(f"{out}/target=large/batch={i}")
    writer = PIPE.fan_out(T.metrics_of(event_stream(spark, sf)), [all_, large])
    writer.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("target", "name").agg(F.count(F.lit(1)).alias("points"))


@query("stream_anomalies", ORACLES["anomaly_backfill"])
def stream_anomalies(spark, sf):
    out, table = scratch(spark, "anomalies"), scratch(spark, "metrics")
    run_batches(T.metrics_of(event_stream(spark, sf)), PIPE.anomaly_batches(table, out, 3 * T.DAY))
    return spark.read.parquet(out).select("name", "labels_key", "ts_ms", "value", F.round("expected", 6).alias("expected"),
                                          F.round("score", 6).alias("score"), "severity")


@query("stream_recording", f"""WITH {T.METRICS_SQL} SELECT name, labels_key, value, ts_ms FROM m""")
def stream_recording(spark, sf):
    """Record a metric stream as JSON lines and read the recording back."""
    path = scratch(spark, "recording")
    sinks.record_stream(T.metrics_of(event_stream(spark, sf)), path, path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _points(payloads.recording(spark, path))


LIVE = ["event_click", "event_view", "event_error", "event_signup"]


@query("live_snapshot", f"""WITH RECURSIVE {alerting.STATES_SQL},
  live AS (SELECT 'metrics' AS part, name || chr(10) || labels_key AS item, arg_max(value, (ts_ms, seq))::BIGINT::VARCHAR AS detail
    FROM m WHERE name IN ('{"', '".join(LIVE)}') AND ts_ms BETWEEN {T.AS_OF - T.DAY} AND {T.AS_OF} GROUP BY name, labels_key)
  SELECT * FROM live
  UNION ALL SELECT 'alerts', rule, arg_max(state, ts_ms) FROM ev GROUP BY rule HAVING arg_max(state, ts_ms) <> 'inactive'
  UNION ALL SELECT 'logs', doc_id::VARCHAR, md5(text) FROM (SELECT * FROM documents
    WHERE {T.LOG_START} + doc_id * 60000 <= {T.AS_OF} ORDER BY doc_id DESC LIMIT 20)""")
def live_snapshot(spark, sf):
    view = PIPE.live_snapshot(T.metrics(spark, sf), alerting._events(spark, sf), T.logs(spark, sf), T.AS_OF, LIVE, T.DAY)
    m = view["metrics"].select(F.lit("metrics").alias("part"), F.concat("name", F.lit("\n"), L.labels_key("labels")).alias("item"),
                               F.col("value").cast("bigint").cast("string").alias("detail"))
    a = view["alerts"].select(F.lit("alerts").alias("part"), F.col("rule").alias("item"), F.col("state").alias("detail"))
    g = view["logs"].select(F.lit("logs").alias("part"), F.col("seq").cast("string").alias("item"), F.md5("message").alias("detail"))
    return m.unionByName(a).unionByName(g)


@query("late_points", f"""WITH {T.METRICS_SQL}, mark AS (
    SELECT name, labels_key, max(ts_ms // 60000 * 60000) AS mark FROM m WHERE ts_ms < {T.AS_OF - 15 * T.DAY} GROUP BY ALL)
  SELECT name, labels_key, count(*) AS points, count(*) FILTER (WHERE ts_ms // 60000 * 60000 <= mark) AS late
  FROM m LEFT JOIN mark USING (name, labels_key) GROUP BY ALL""")
def late_points(spark, sf):
    """Points of a second delivery whose bucket was already written by the first."""
    m = T.metrics(spark, sf)
    half = T.AS_OF - 15 * T.DAY
    written = RULES.downsample(m.filter(F.col("ts_ms") < half), ":1m", half, raw_window_ms=30 * T.DAY)
    fresh, late = PIPE.split_late(m, written, ":1m")
    both = fresh.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    return both.groupBy("name", "labels").agg(F.count(F.lit(1)).alias("points"), F.sum("_late").alias("late")).select(
        "name", L.labels_key("labels").alias("labels_key"), "points", "late")
