"""Comparison, forecast, correlation, anomaly and change-point queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import stats as ST
from obsframe.plans import tables as T
from obsframe.plans.registry import query

MONTH = 30 * T.DAY
WEEK = 7 * T.DAY


def _r4(x: str) -> str:
    return f"round(({x}) * 10000.0) / 10000.0"


@query("compare_report", f"""WITH {T.METRICS_SQL}, a AS (
    SELECT name, avg(value) FILTER (WHERE ts_ms >= {T.AS_OF - WEEK}) AS cur,
           avg(value) FILTER (WHERE ts_ms <= {T.AS_OF - WEEK}) AS prev
    FROM m WHERE ts_ms BETWEEN {T.AS_OF - 2 * WEEK} AND {T.AS_OF} GROUP BY name),
  b AS (SELECT *, CASE WHEN abs(prev) < 1e-9 AND abs(cur) < 1e-9 THEN 0 WHEN abs(prev) < 1e-9 THEN 100
                       ELSE (cur - prev) / abs(prev) * 100 END AS change FROM a WHERE cur IS NOT NULL AND prev IS NOT NULL)
  SELECT name AS metric, {_r4("cur")} AS current_avg, {_r4("prev")} AS previous_avg, {_r4("change")} AS change_percent,
         CASE WHEN change > 0.5 THEN 'up' WHEN change < -0.5 THEN 'down' ELSE 'stable' END AS direction FROM b""")
def compare_report(spark, sf):
    return ST.compare_report(T.metrics(spark, sf, T.AS_OF - 2 * WEEK, T.AS_OF), WEEK, WEEK, T.AS_OF)


REGRESSION_SQL = f"""{T.METRICS_SQL}, p AS (
    SELECT *, (ts_ms - min(ts_ms) OVER (PARTITION BY name, labels_key)) / 1000.0::DOUBLE AS x FROM m
    WHERE ts_ms BETWEEN {T.AS_OF - MONTH} AND {T.AS_OF}),
  g AS (SELECT name, labels_key, count(*) AS n, min(ts_ms) AS t0, max(ts_ms) AS last_ms, max(x) AS last_x,
               arg_max(value, (ts_ms, seq)) AS cur, avg(value) AS mean, max(value) AS peak,
               regr_slope(value, x) AS slope, regr_intercept(value, x) AS icpt, regr_r2(value, x) AS r2
        FROM p GROUP BY name, labels_key HAVING count(*) >= 5)"""
TREND_SQL = """CASE WHEN slope * 3600 / abs(cur) > 0.02 THEN 'increasing'
                    WHEN slope * 3600 / abs(cur) < -0.02 THEN 'decreasing' ELSE 'stable' END"""


@query("linear_regression", f"""WITH {REGRESSION_SQL}
  SELECT name, labels_key, n, t0, round(slope, 9) AS slope, round(icpt, 4) AS intercept, round(r2, 6) AS r2 FROM g""")
def linear_regression(spark, sf):
    r = ST.regressions(T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF), T.AS_OF, MONTH)
    return r.select("name", L.labels_key("labels").alias("labels_key"), "n", "t0", F.round("slope", 9).alias("slope"),
                    F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("forecast", f"""WITH {REGRESSION_SQL}
  SELECT name, labels_key, {_r4("cur")} AS current_value, {_r4("slope * (last_x + 3600) + icpt")} AS predicted_1h,
         {_r4("slope * (last_x + 86400) + icpt")} AS predicted_24h,
         {_r4("slope * (last_x + 604800) + icpt")} AS predicted_7d, {TREND_SQL} AS trend, {_r4("r2")} AS confidence
  FROM g""")
def forecast(spark, sf):
    f = ST.forecast(T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF), T.AS_OF, MONTH)
    return f.withColumn("labels_key", L.labels_key("labels")).drop("labels")


EXHAUSTION_SQL = """e AS (SELECT *, slope > 0 AS reachable,
    CASE WHEN slope > 0 THEN ({limit} - icpt) / slope END AS cross_x FROM g),
  f AS (SELECT *, cross_x - last_x AS wait FROM e)"""


@query("exhaustion", f"""WITH {REGRESSION_SQL}, {EXHAUSTION_SQL.format(limit=6000)}
  SELECT name, labels_key, reachable,
         CASE WHEN reachable AND wait > 0 THEN round(wait / 3600 * 100) / 100 ELSE 0 END AS hours_until_full,
         CASE WHEN reachable AND wait > 0 THEN round(wait / 86400 * 100) / 100 ELSE 0 END AS days_until_full,
         CASE WHEN reachable AND wait > 0 THEN (t0 + floor(cross_x * 1000)::BIGINT) // 1000 * 1000
              WHEN reachable THEN last_ms // 1000 * 1000 ELSE 0 END AS exhausted_s FROM f""")
def exhaustion(spark, sf):
    e = ST.exhaustion(T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF), 6000, T.AS_OF, MONTH)
    at = F.col("exhausted_at_ms")
    return e.select("name", L.labels_key("labels").alias("labels_key"), "reachable", "hours_until_full",
                    "days_until_full", (at - at % 1000).alias("exhausted_s"))


@query("capacity_report", f"""WITH {REGRESSION_SQL}, {EXHAUSTION_SQL.format(limit=6000)},
  w(name, resource) AS (VALUES ('event_click', 'cpu'), ('event_view', 'disk'), ('event_none', 'memory')),
  c AS (SELECT w.name, resource, labels_key, round(mean * 100) / 100 AS avg_, round(peak * 100) / 100 AS peak_,
          {TREND_SQL} AS trend_, {_r4("slope * (last_x + 86400) + icpt")} AS pred, {_r4("slope * 86400")} AS growth,
          CASE WHEN reachable AND wait > 0 THEN round(wait / 86400 * 100) / 100 ELSE 0 END AS days, reachable, n
        FROM w LEFT JOIN f USING (name))
  SELECT name, resource, coalesce(labels_key, '') AS labels_key, coalesce(avg_, 0) AS current_avg, coalesce(peak_, 0) AS peak,
    CASE WHEN n IS NULL THEN '' ELSE trend_ END AS trend, coalesce(pred, 0) AS predicted_24h, coalesce(growth, 0) AS growth_per_day,
    coalesce(days, 0) AS days_until_full,
    CASE WHEN n IS NULL THEN 'healthy'
      WHEN resource = 'disk' AND reachable THEN CASE WHEN days <= 7 THEN 'critical' WHEN days <= 30 THEN 'warning' ELSE 'healthy' END
      WHEN pred >= 90 THEN 'critical' WHEN pred >= 80 THEN 'warning' ELSE 'healthy' END AS health FROM c""")
def capacity_report(spark, sf):
    resources = {"event_click": "cpu", "event_view": "disk", "event_none": "memory"}
    m = T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF, list(resources))
    c = ST.capacity_report(m, T.AS_OF, MONTH, resources, threshold=6000)
    return c.withColumn("labels_key", L.labels_key("labels")).drop("labels")


PAIRS_SQL = f"""{T.METRICS_SQL}, bm AS (
    SELECT name, (ts_ms // {T.HOUR}) * {T.HOUR} AS bucket, avg(value) AS v FROM m
    WHERE ts_ms BETWEEN {T.AS_OF - MONTH} AND {T.AS_OF} GROUP BY ALL),
  pairs AS (SELECT b.name AS metric, a.bucket, a.v AS x, b.v AS y FROM bm a JOIN bm b USING (bucket)
            WHERE a.name = 'event_click' AND b.name <> 'event_click')"""
LABEL_SQL = """CASE WHEN abs(r) >= 0.7 AND r > 0 THEN 'strong_positive' WHEN abs(r) >= 0.3 AND r > 0 THEN 'weak_positive'
  WHEN abs(r) >= 0.7 THEN 'strong_negative' WHEN abs(r) >= 0.3 THEN 'weak_negative' ELSE 'none' END"""


@query("correlate", f"""WITH {PAIRS_SQL}, c AS (
    SELECT metric, corr(x, y) AS r, count(*) AS n FROM pairs WHERE metric = 'event_view' GROUP BY metric)
  SELECT 'event_click' AS metric_a, metric AS metric_b, round(r, 6) AS coefficient, {LABEL_SQL} AS interpretation,
         n AS sample_count FROM c""")
def correlate(spark, sf):
    m = T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF, ["event_click", "event_view"])
    out = ST.correlate(m, "event_click", "event_view", MONTH, T.AS_OF, T.HOUR)
    return out.withColumn("coefficient", F.round("coefficient", 6))


@query("correlation_points", f"""WITH {PAIRS_SQL}
  SELECT bucket, round(x, 4) AS x, round(y, 4) AS y FROM pairs WHERE metric = 'event_view'""")
def correlation_points(spark, sf):
    m = T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF, ["event_click", "event_view"])
    return ST.correlation_points(m, "event_click", "event_view", MONTH, T.AS_OF, T.HOUR)


@query("auto_correlate", f"""WITH {PAIRS_SQL}, c AS (
    SELECT metric, corr(x, y) AS r, count(*) AS n FROM pairs GROUP BY metric HAVING count(*) >= 3)
  SELECT metric, round(r, 6) AS coefficient, {LABEL_SQL} AS interpretation, n AS sample_count
  FROM c ORDER BY abs(r) DESC LIMIT 5""")
def auto_correlate(spark, sf):
    out = ST.auto_correlate(T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF), "event_click", MONTH, T.AS_OF, T.HOUR)
    return out.withColumn("coefficient", F.round("coefficient", 6))


@query("anomaly_latest", f"""WITH {T.METRICS_SQL}, p AS (
    SELECT *, row_number() OVER (PARTITION BY name, labels_key ORDER BY ts_ms DESC, seq DESC) AS rn,
           count(*) OVER (PARTITION BY name, labels_key) AS n FROM m WHERE ts_ms BETWEEN {T.AS_OF - MONTH} AND {T.AS_OF}),
  g AS (SELECT name, labels_key, max(ts_ms) FILTER (WHERE rn = 1) AS ts_ms, max(value) FILTER (WHERE rn = 1) AS value,
          avg(value) FILTER (WHERE rn > 1) AS mean, stddev_pop(value) FILTER (WHERE rn > 1) AS sd
        FROM p WHERE n >= 5 GROUP BY name, labels_key)
  SELECT name, labels_key, ts_ms, value, round(mean, 6) AS expected, round(abs(value - mean) / sd, 6) AS score
  FROM g WHERE sd >= 1e-10 AND abs(value - mean) / sd >= 1.5""")
def anomaly_latest(spark, sf):
    m = T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF)
    out = ST.anomalies_latest(m, T.AS_OF, MONTH, z_limit=1.5)
    return out.select("name", "labels_key", "ts_ms", "value", F.round("expected", 6).alias("expected"),
                      F.round("score", 6).alias("score"))


@query("anomaly_backfill", f"""WITH {T.METRICS_SQL}, w AS (
    SELECT *, count(*) OVER r AS n, avg(value) OVER r AS mean, stddev_pop(value) OVER r AS sd,
           row_number() OVER (PARTITION BY name, labels_key, ts_ms ORDER BY seq DESC) AS rn FROM m
    WINDOW r AS (PARTITION BY name, labels_key ORDER BY ts_ms RANGE BETWEEN {3 * T.DAY} PRECEDING AND 1 PRECEDING))
  SELECT name, labels_key, ts_ms, value, round(mean, 6) AS expected, round(abs(value - mean) / sd, 6) AS score,
    CASE WHEN abs(value - mean) / sd >= 5 THEN 'high' WHEN abs(value - mean) / sd >= 3.5 THEN 'medium' ELSE 'low' END AS severity
  FROM w WHERE rn = 1 AND n >= 4 AND sd >= 1e-10 AND abs(value - mean) / sd >= 3""")
def anomaly_backfill(spark, sf):
    out = ST.anomalies_backfill(T.metrics(spark, sf), 3 * T.DAY)
    return out.select("name", "labels_key", "ts_ms", "value", F.round("expected", 6).alias("expected"),
                      F.round("score", 6).alias("score"), "severity")


@query("change_points", f"""WITH {T.METRICS_SQL}, p AS (
    SELECT *, avg(value) OVER (PARTITION BY name) AS mean, stddev_pop(value) OVER (PARTITION BY name) AS sd,
           count(*) OVER (PARTITION BY name) AS n FROM m WHERE ts_ms BETWEEN {T.AS_OF - MONTH} AND {T.AS_OF}),
  c AS (SELECT *, row_number() OVER o AS k, sum(value - mean) OVER o AS cusum, sum(value) OVER o AS total,
               lead(ts_ms) OVER o AS next_ts FROM p WHERE n >= 12 AND sd >= 1e-9
        WINDOW o AS (PARTITION BY name ORDER BY ts_ms, labels_key, seq)),
  e AS (SELECT name, max(cusum) AS mx, min(cusum) AS mn, arg_max(k, (cusum, -k)) AS kx, arg_min(k, (cusum, k)) AS kn
        FROM c GROUP BY name),
  pick AS (SELECT c.*, total / k AS b, (mean * n - total) / (n - k) AS a FROM c JOIN e USING (name)
           WHERE k = CASE WHEN abs(mn) > abs(mx) THEN kn ELSE kx END AND k >= 3 AND k - 1 < n - 3)
  SELECT name AS metric, next_ts AS ts_ms, {_r4("b")} AS before_mean, {_r4("a")} AS after_mean,
         {_r4("abs(a - b) / sd")} AS significance FROM pick""")
def change_points(spark, sf):
    """Threshold 0, so that the stationary test data yields a point for every metric."""
    m = T.metrics(spark, sf, T.AS_OF - MONTH, T.AS_OF)
    return ST.distinct_changes(ST.change_points(m, T.AS_OF, MONTH, min_significance=0.0))
