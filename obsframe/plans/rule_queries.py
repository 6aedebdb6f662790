"""Recording rules, downsampling, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import retention as RET, rules as RULES
from obsframe.plans import tables as T
from obsframe.plans.registry import query

RULE_WINDOW = "14d"
WINDOW_MS = 14 * T.DAY
SPAN = f"ts_ms BETWEEN {T.AS_OF - WINDOW_MS} AND {T.AS_OF}"

SQL_AGG = {"avg": "sum(value) / count(*)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)",
           "count": "count(*)::DOUBLE", "p50": "quantile_cont(value, 0.5)", "p95": "quantile_cont(value, 0.95)",
           "p99": "quantile_cont(value, 0.99)"}


def _register_rule(agg: str, expr: str) -> None:
    @query(f"rule_{agg}", f"""WITH {T.METRICS_SQL}
      SELECT 'purchase:' || '{agg}' AS name, 'host=' || host || chr(10) AS labels_key, round({expr}, 6) AS value,
             {T.AS_OF} AS ts_ms
      FROM m WHERE name = 'event_purchase' AND {SPAN} GROUP BY host""")
    def run(spark, sf):
        rule = RULES.RecordingRule("event_purchase", f"purchase:{agg}", agg, RULE_WINDOW, ("host",))
        m = T.metrics(spark, sf, T.AS_OF - WINDOW_MS, T.AS_OF, ["event_purchase"])
        out = RULES.record(m, [rule], T.AS_OF, windows=None)
        return out.select("name", L.labels_key("labels").alias("labels_key"), F.round("value", 6).alias("value"), "ts_ms")


for _a, _e in SQL_AGG.items():
    _register_rule(_a, _e)


@query("rules_together", f"""WITH {T.METRICS_SQL}
  SELECT 'click:sum' AS name, 'region=' || region || chr(10) AS labels_key, sum(value) AS value
  FROM m WHERE name = 'event_click' AND {SPAN} GROUP BY region
  UNION ALL SELECT 'click:max', '', max(value) FROM m WHERE name = 'event_click'
    AND ts_ms BETWEEN {T.AS_OF - 7 * T.DAY} AND {T.AS_OF}
  UNION ALL SELECT 'error:p99', 'host=' || host || chr(10) || 'region=' || region || chr(10),
    round(quantile_cont(value, 0.99), 6) FROM m WHERE name = 'event_error' AND {SPAN} GROUP BY host, region""")
def rules_together(spark, sf):
    """Three rules with different inputs, windows and groupings in one run."""
    rules = [RULES.RecordingRule("event_click", "click:sum", "sum", RULE_WINDOW, ("region", "zone")),
             RULES.RecordingRule("event_click", "click:max", "max", "7d"),
             RULES.RecordingRule("event_error", "error:p99", "p99", RULE_WINDOW, ("host", "region"))]
    m = T.metrics(spark, sf, T.AS_OF - WINDOW_MS, T.AS_OF, ["event_click", "event_error"])
    out = RULES.record(m, rules, T.AS_OF, windows=None)
    return out.select("name", L.labels_key("labels").alias("labels_key"), F.round("value", 6).alias("value"))


def _register_downsample(suffix: str, width: int) -> None:
    @query(f"downsample_{suffix[1:]}", f"""WITH {T.METRICS_SQL}, d AS (
        SELECT name, labels_key, (ts_ms // {width}) * {width} AS bucket, value FROM m
        WHERE ts_ms BETWEEN {T.AS_OF - 30 * T.DAY} AND {T.AS_OF})
      SELECT name || '{suffix}' AS name, labels_key, avg(value) AS value, bucket AS ts_ms
      FROM d WHERE bucket < ({T.AS_OF} // {width}) * {width} GROUP BY name, labels_key, bucket""")
    def run(spark, sf):
        m = T.metrics(spark, sf, T.AS_OF - 30 * T.DAY, T.AS_OF)
        out = RULES.downsample(m, suffix, T.AS_OF, raw_window_ms=30 * T.DAY, width_ms=width)
        return out.select("name", L.labels_key("labels").alias("labels_key"), "value", "ts_ms")


_register_downsample(":1m", 60_000)
_register_downsample(":5m", 300_000)

HALF = T.AS_OF - 15 * T.DAY


@query("downsample_resume", f"""WITH {T.METRICS_SQL}, d AS (
    SELECT name, labels_key, (ts_ms // 3600000) * 3600000 AS b, avg(value) AS value FROM m
    WHERE ts_ms >= {T.AS_OF - 30 * T.DAY} GROUP BY ALL),
  mark AS (SELECT name, labels_key, max(b) AS mark FROM d WHERE b < {HALF} GROUP BY ALL)
  SELECT d.name || ':1h' AS name, d.labels_key, d.value, d.b AS ts_ms
  FROM d LEFT JOIN mark USING (name, labels_key) WHERE d.b < {T.AS_OF} AND (mark IS NULL OR d.b > mark)""")
def downsample_resume(spark, sf):
    """Second run: only buckets newer than each series' newest written one."""
    m = T.metrics(spark, sf, T.AS_OF - 30 * T.DAY, T.AS_OF)
    kw = dict(raw_window_ms=30 * T.DAY, width_ms=T.HOUR)
    first = RULES.downsample(m.filter(F.col("ts_ms") < HALF), ":1h", HALF, **kw)
    out = RULES.downsample(m, ":1h", T.AS_OF, written=first, **kw)
    return out.select("name", L.labels_key("labels").alias("labels_key"), "value", "ts_ms")


CUSTOM = [RET.Policy("clicks", "^event_c", max_age_s=3 * 86400, max_points=5),
          RET.Policy("sales", "purchase|signup", max_points=7),
          RET.Policy("raw", r"^[^:]+$", max_age_s=10 * 86400, builtin=True)]
POLICY_SQL = """CASE WHEN regexp_matches(name, '^event_c') THEN 'clicks'
  WHEN regexp_matches(name, 'purchase|signup') THEN 'sales'
  WHEN regexp_matches(name, '^[^:]+$') THEN 'raw' END"""


@query("retention_policies", f"""WITH {T.METRICS_SQL} SELECT DISTINCT name, {POLICY_SQL} AS policy FROM m""")
def retention_policies(spark, sf):
    return RET.matched_policies(T.metrics(spark, sf), CUSTOM).select("name", "policy")


@query("retention_enforce", f"""WITH {T.METRICS_SQL}, p AS (SELECT *, {POLICY_SQL} AS policy FROM m),
  young AS (SELECT * FROM p WHERE policy = 'sales' OR (policy = 'clicks' AND ts_ms >= {T.AS_OF - 3 * T.DAY})
            OR (policy = 'raw' AND ts_ms >= {T.AS_OF - 10 * T.DAY})),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name, labels_key ORDER BY ts_ms DESC, seq DESC) AS rn FROM young)
  SELECT name, labels_key, ts_ms, value, seq FROM ranked
  WHERE policy = 'raw' OR (policy = 'clicks' AND rn <= 5) OR (policy = 'sales' AND rn <= 7)""")
def retention_enforce(spark, sf):
    out = RET.enforce(T.metrics(spark, sf), CUSTOM, T.AS_OF)
    return out.select("name", L.labels_key("labels").alias("labels_key"), "ts_ms", "value", "seq")


@query("retention_age", f"""WITH {T.METRICS_SQL}
  SELECT name, count(*) AS points FROM m WHERE ts_ms >= {T.AS_OF - 10 * T.DAY} GROUP BY name""")
def retention_age(spark, sf):
    policies = [RET.Policy("raw", r"^[^:]+$", max_age_s=10 * 86400, builtin=True)]
    out = RET.enforce(T.metrics(spark, sf), policies, T.AS_OF)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("points"))


@query("retention_logs", f"""WITH {T.LOGS_SQL}, r AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, seq DESC) AS rn FROM l
    WHERE ts_ms >= {T.LOG_START + 600_000})
  SELECT source, seq FROM r WHERE rn <= 20""")
def retention_logs(spark, sf):
    logs = T.logs(spark, sf).select("ts_ms", "source", "seq")
    return RET.keep_logs(logs, T.LOG_START + 600_000, per_source=20, age_ms=0).select("source", "seq")


@query("delete_series", f"""WITH {T.METRICS_SQL}
  SELECT name, count(*) AS points, (SELECT count(DISTINCT labels_key) FROM m WHERE name = 'event_error') AS deleted
  FROM m WHERE name <> 'event_error' GROUP BY name""")
def delete_series(spark, sf):
    rest, gone = RET.delete_series(T.metrics(spark, sf), "event_error")
    return (rest.groupBy("name").agg(F.count(F.lit(1)).alias("points"))
            .withColumn("deleted", gone.scalar()))
