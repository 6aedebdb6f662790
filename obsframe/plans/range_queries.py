"""Range functions, vectors, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import ranges as R, select as SEL, vectors as V
from obsframe.plans import tables as T
from obsframe.plans.registry import query

CLICK, BUY = "event_click", "event_purchase"
WEEK = 7 * T.DAY
START = T.AS_OF - WEEK
IN_RANGE = f"ts_ms BETWEEN {START} AND {T.AS_OF}"


def _m(spark, sf, names=(CLICK,), start=START):
    return T.metrics(spark, sf, start, T.AS_OF, names)


def _vec(df):
    return df.select("labels_key", "value")


SQL_AGG = {"avg": "avg(value)", "max": "max(value)", "min": "min(value)", "sum": "sum(value)",
           "count": "count(*)::DOUBLE", "last": "arg_max(value, (ts_ms, seq))"}


def _range_sql(agg: str, name: str = CLICK) -> str:
    return (f"WITH {T.METRICS_SQL} SELECT labels_key, {agg} AS value FROM m "
            f"WHERE name = '{name}' AND {IN_RANGE} GROUP BY labels_key")


def _register_range(func: str, sql: str) -> None:
    @query(f"range_{func}", sql)
    def run(spark, sf):
        return _vec(R.range_agg(_m(spark, sf), CLICK, func, WEEK, T.AS_OF))


for _f, _a in SQL_AGG.items():
    _register_range(_f, _range_sql(_a))
_register_range("rate", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, (arg_max(value, (ts_ms, seq)) - arg_min(value, (ts_ms, seq))) / {WEEK / 1000.0} AS value
  FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key HAVING count(*) >= 2""")


@query("range_p95", _range_sql("round(quantile_cont(value, 0.95), 6)"))
def range_p95(spark, sf):
    out = R.range_agg(_m(spark, sf), CLICK, "p95", WEEK, T.AS_OF)
    return out.select("labels_key", F.round("value", 6).alias("value"))


@query("instant_latest", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, arg_max(value, (ts_ms, seq)) AS value FROM m WHERE name = '{CLICK}' GROUP BY labels_key""")
def instant_latest(spark, sf):
    return _vec(R.instant(T.metrics(spark, sf, names=[CLICK]), CLICK))


@query("latest_three", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, ts_ms, value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC, seq DESC) AS rank
    FROM m WHERE name = '{CLICK}') WHERE rank <= 3""")
def latest_three(spark, sf):
    return R.latest(T.metrics(spark, sf, names=[CLICK]), CLICK, 3).select("labels_key", "ts_ms", "value", "rank")


def _group_sql(inner: str, outer: str) -> str:
    return f"""WITH {T.METRICS_SQL}, per AS (
      SELECT host, labels_key, {inner} AS value FROM m WHERE name = '{CLICK}' AND {IN_RANGE}
      GROUP BY host, labels_key)
    SELECT host, round({outer}, 6) AS value FROM per GROUP BY host"""


def _register_group(func: str, sql: str) -> None:
    @query(f"group_{func}_by_host", sql)
    def run(spark, sf):
        out = R.group_agg(_m(spark, sf), CLICK, func, ["host"], WEEK, T.AS_OF)
        return out.select(F.col("labels")["host"].alias("host"), F.round("value", 6).alias("value"))


for _f, _o in {"avg": "avg(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)",
               "count": "count(*)::DOUBLE", "last": "arg_max(value, labels_key)"}.items():
    _register_group(_f, _group_sql(SQL_AGG[_f], _o))


@query("vector_div", f"""WITH {T.METRICS_SQL},
  a AS (SELECT labels_key, sum(value) AS v FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key),
  b AS (SELECT labels_key, sum(value) AS v FROM m WHERE name = '{BUY}' AND {IN_RANGE} GROUP BY labels_key)
  SELECT a.labels_key, a.v / b.v AS value FROM a JOIN b USING (labels_key)""")
def vector_div(spark, sf):
    m = _m(spark, sf, (CLICK, BUY))
    a = R.range_agg(m, CLICK, "sum", WEEK, T.AS_OF)
    return _vec(V.arith("/", a, R.range_agg(m, BUY, "sum", WEEK, T.AS_OF)))


@query("vector_broadcast", f"""WITH {T.METRICS_SQL},
  a AS (SELECT labels_key, sum(value) AS v FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key),
  b AS (SELECT sum(value) AS v FROM m WHERE name = '{BUY}' AND host = 'h1' AND region = 'r1' AND {IN_RANGE}
        HAVING count(*) > 0)
  SELECT a.labels_key, a.v - b.v AS value FROM a JOIN b ON true""")
def vector_broadcast(spark, sf):
    m = _m(spark, sf, (CLICK, BUY))
    one = R.range_agg(m, SEL.metric(BUY, host="h1", region="r1"), "sum", WEEK, T.AS_OF)
    return _vec(V.arith("-", R.range_agg(m, CLICK, "sum", WEEK, T.AS_OF), one))


@query("scalar_mul", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, 0.01 * sum(value) AS value FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key""")
def scalar_mul(spark, sf):
    return _vec(V.arith("*", 0.01, R.range_agg(_m(spark, sf), CLICK, "sum", WEEK, T.AS_OF)))


@query("threshold_flag", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, avg(value) AS value, avg(value) > 5000 AS result FROM m
  WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key""")
def threshold_flag(spark, sf):
    out = SEL.compare(R.range_agg(_m(spark, sf), CLICK, "avg", WEEK, T.AS_OF), ">", 5000)
    return out.select("labels_key", "value", "result")


@query("label_matcher", f"""WITH {T.METRICS_SQL}
  SELECT labels_key, sum(value) AS value FROM m
  WHERE name = '{CLICK}' AND host = 'h3' AND {IN_RANGE} GROUP BY labels_key""")
def label_matcher(spark, sf):
    return _vec(R.range_agg(_m(spark, sf), SEL.metric(CLICK, host="h3", zone=""), "sum", WEEK, T.AS_OF))


@query("vector_collapse", f"""WITH {T.METRICS_SQL}, per AS (
    SELECT labels_key, avg(value) AS v FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY labels_key)
  SELECT round(avg(v), 6) AS value FROM per""")
def vector_collapse(spark, sf):
    out = R.collapse(R.range_agg(_m(spark, sf), CLICK, "avg", WEEK, T.AS_OF))
    return out.select(F.round("value", 6).alias("value"))


@query("hosts_over_threshold", f"""WITH {T.METRICS_SQL}, per AS (
    SELECT host, labels_key, avg(value) AS v FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY ALL)
  SELECT host, round(avg(v), 6) AS value, avg(v) > 5000 AS result FROM per GROUP BY host""")
def hosts_over_threshold(spark, sf):
    """Flagship: range scan, per-series mean, grouping by a label, threshold flag."""
    out = SEL.compare(R.group_agg(_m(spark, sf), CLICK, "avg", ["host"], WEEK, T.AS_OF), ">", 5000)
    return out.select(F.col("labels")["host"].alias("host"), F.round("value", 6).alias("value"), "result")


@query("series_scan", f"""WITH {T.METRICS_SQL}
  SELECT ts_ms, value, seq FROM m WHERE name = '{CLICK}' AND host = 'h1' AND region = 'r1' AND {IN_RANGE}""")
def series_scan(spark, sf):
    out = SEL.series_points(_m(spark, sf), CLICK, {"host": "h1", "region": "r1"}, START, T.AS_OF)
    return out.select("ts_ms", "value", "seq")


@query("metric_names", f"""WITH {T.METRICS_SQL} SELECT DISTINCT name FROM m WHERE lower(name) LIKE 'event\\_s%' ESCAPE '\\'""")
def metric_names(spark, sf):
    return SEL.metric_names(T.metrics(spark, sf), "EVENT_S")


@query("series_fingerprint", f"""WITH {T.METRICS_SQL}
  SELECT DISTINCT name, labels_key, md5(name || '{{host=' || host || ',region=' || region || '}}') AS series_id
  FROM m""")
def series_fingerprint(spark, sf):
    series = T.metrics(spark, sf).groupBy("name", "labels").agg(F.count(F.lit(1)).alias("n"))
    return series.select("name", L.labels_key("labels").alias("labels_key"),
                         L.series_id("name", "labels").alias("series_id"))


@query("dashboard_timeseries", f"""WITH {T.METRICS_SQL}
  SELECT name || '{{host=' || host || ',region=' || region || '}}' AS target, ts_ms, value, seq
  FROM m WHERE name IN ('{CLICK}', '{BUY}') AND {IN_RANGE}""")
def dashboard_timeseries(spark, sf):
    return SEL.timeseries(_m(spark, sf, (CLICK, BUY)), [CLICK, BUY], START, T.AS_OF)


@query("dashboard_current", f"""WITH {T.METRICS_SQL}
  SELECT 'max clicks{{host=' || host || ',region=' || region || '}}' AS target, {T.AS_OF} AS ts_ms, max(value) AS value
  FROM m WHERE name = '{CLICK}' AND {IN_RANGE} GROUP BY host, region""")
def dashboard_current(spark, sf):
    return SEL.current_values(R.range_agg(_m(spark, sf), CLICK, "max", WEEK, T.AS_OF), "max clicks", T.AS_OF)


@query("merged_metrics", f"""WITH {T.METRICS_SQL}
  SELECT ts_ms, value, seq FROM m WHERE name = '{CLICK}' AND {IN_RANGE}
  UNION ALL SELECT ts_ms, -value, seq FROM m WHERE name = '{BUY}' AND {IN_RANGE}""")
def merged_metrics(spark, sf):
    """Points of all series of two metrics as one sequence, the second negated."""
    m = _m(spark, sf, (CLICK, BUY))
    a = SEL.scan(m, CLICK, START, T.AS_OF).select("ts_ms", "value", "seq")
    b = SEL.scan(m, BUY, START, T.AS_OF).select("ts_ms", (-F.col("value")).alias("value"), "seq")
    return a.unionByName(b)


@query("catalog_counts", f"""WITH {T.METRICS_SQL}
  SELECT (SELECT count(DISTINCT name) FROM m) AS metrics,
         (SELECT count(*) FROM (SELECT DISTINCT name, labels_key FROM m)) AS series,
         (SELECT count(*) FROM m) AS points, (SELECT count(*) FROM documents) AS logs,
         (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS traces""")
def catalog_counts(spark, sf):
    return SEL.catalog_counts(T.metrics(spark, sf), T.logs(spark, sf), T.spans(spark, sf))
