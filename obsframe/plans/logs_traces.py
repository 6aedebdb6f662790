"""Logs, traces and service-map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import logs as LOG, retention as RET, traces as TR
from obsframe.plans import tables as T
from obsframe.plans.registry import query


def _log_sql(where: str, limit: int | None) -> str:
    tail = f"ORDER BY ts_ms DESC, seq DESC LIMIT {limit}" if limit else ""
    return f"WITH {T.LOGS_SQL} SELECT ts_ms, level, source, md5(message) AS message_md5 FROM l WHERE {where} {tail}"


def _shown(df):
    return df.select("ts_ms", "level", "source", F.md5("message").alias("message_md5"))


@query("log_search_text", _log_sql("contains(lower(message), 'the') AND level = 'warn'", 100))
def log_search_text(spark, sf):
    return _shown(LOG.search(T.logs(spark, sf), "THE", level="warn", limit=100))


@query("log_search_regex", _log_sql("regexp_matches(message, '[0-9]{3}-[0-9]{3,4}|\\w+@\\w+\\.\\w+')", 50))
def log_search_regex(spark, sf):
    return _shown(LOG.search(T.logs(spark, sf), r"/[0-9]{3}-[0-9]{3,4}|\w+@\w+\.\w+/", limit=50))


@query("log_search_bad_regex", _log_sql("false", None))
def log_search_bad_regex(spark, sf):
    return _shown(LOG.search(T.logs(spark, sf), "/(unclosed/"))


@query("log_match_counts", f"""WITH {T.LOGS_SQL}
  SELECT source, level, md5(source || ':' || level) AS log_group, count(*) AS lines FROM l
  WHERE contains(lower(message), 'er') AND ts_ms >= {T.LOG_START + 60_000} GROUP BY source, level""")
def log_match_counts(spark, sf):
    """All matches, without the list limit, per log group."""
    found = LOG.matching(T.logs(spark, sf), "er", start_ms=T.LOG_START + 60_000)
    return (found.groupBy("source", "level").agg(F.count(F.lit(1)).alias("lines"))
            .withColumn("log_group", L.log_group_id("source", "level")))


@query("log_recent", _log_sql("true", 20))
def log_recent(spark, sf):
    return _shown(LOG.recent(T.logs(spark, sf), 20))


ROLLUP_SQL = f"""{T.SPANS_SQL}, r AS (
  SELECT trace_id, min(start_ms) AS start_ms, max(start_ms + duration_ms) - min(start_ms) AS duration_ms,
         count(*) AS span_count, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services,
         bool_or(status = 'error') AS has_error,
         coalesce(arg_min(operation_name, (start_ms, seq)) FILTER (WHERE parent_span_id = ''), '') AS root_operation,
         coalesce(arg_min(service_name, (start_ms, seq)) FILTER (WHERE parent_span_id = ''), '') AS root_service,
         min(seq) AS first_seen
  FROM s GROUP BY trace_id)"""


def _trace(df):
    return df.withColumn("services", F.array_join("service_names", ",")).drop("service_names")


@query("trace_rollup", f"WITH {ROLLUP_SQL} SELECT * FROM r")
def trace_rollup(spark, sf):
    return _trace(TR.rollup(T.spans(spark, sf)))


@query("trace_list", f"""WITH {ROLLUP_SQL} SELECT * FROM r
  WHERE duration_ms >= 20 AND contains(',' || services || ',', ',orders-db,') ORDER BY first_seen DESC, trace_id LIMIT 50""")
def trace_list(spark, sf):
    return _trace(TR.list_traces(T.spans(spark, sf), "orders-db", 20, limit=50))


@query("trace_spans_ordered", f"""WITH {T.SPANS_SQL}
  SELECT trace_id, span_id, start_ms, seq, row_number() OVER (PARTITION BY trace_id
    ORDER BY (parent_span_id <> '')::INT, start_ms, seq, span_id) AS position FROM s""")
def trace_spans_ordered(spark, sf):
    return TR.ordered_spans(T.spans(spark, sf)).select("trace_id", "span_id", "start_ms", "seq", "position")


@query("trace_export_rows", f"""WITH {T.SPANS_SQL}, w AS (
    SELECT trace_id FROM s GROUP BY trace_id HAVING min(start_ms) BETWEEN 820454400000 AND 883612800000)
  SELECT trace_id, span_id, parent_span_id, service_name, operation_name, start_ms, duration_ms, status
  FROM s SEMI JOIN w USING (trace_id)""")
def trace_export_rows(spark, sf):
    return TR.in_range(T.spans(spark, sf), 820454400000, 883612800000).drop("seq")


@query("newest_traces", f"""WITH {T.SPANS_SQL}
  SELECT trace_id, min(seq) AS first_seen FROM s GROUP BY trace_id ORDER BY first_seen DESC, trace_id DESC LIMIT 1000""")
def newest_traces(spark, sf):
    return TR.newest_traces(T.spans(spark, sf), RET.MAX_TRACES)


@query("retention_traces", f"""WITH {T.SPANS_SQL}, w AS (
    SELECT trace_id FROM s GROUP BY trace_id HAVING min(start_ms) >= 946684800000)
  SELECT trace_id, count(*) AS spans FROM s SEMI JOIN w USING (trace_id) GROUP BY trace_id""")
def retention_traces(spark, sf):
    kept = RET.keep_traces(T.spans(spark, sf), 946_684_800_000, age_ms=0)
    return kept.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))


@query("service_nodes", f"""WITH {T.SPANS_SQL}
  SELECT service_name AS name,
    CASE service_name WHEN 'orders-db' THEN 'database' WHEN 'redis-cache' THEN 'cache' WHEN 'kafka-broker' THEN 'queue'
      WHEN 'partner-gateway' THEN 'external' ELSE 'api' END AS type,
    count(*) AS request_count, count(*) FILTER (WHERE status = 'error') AS error_count,
    sum(duration_ms)::DOUBLE / count(*) AS avg_latency_ms FROM s GROUP BY service_name""")
def service_nodes(spark, sf):
    return TR.service_nodes(T.spans(spark, sf))


@query("service_edges", f"""WITH {T.SPANS_SQL},
  p AS (SELECT trace_id, span_id, arg_max(service_name, seq) AS from_service FROM s GROUP BY trace_id, span_id)
  SELECT p.from_service, s.service_name AS to_service, count(*) AS request_count,
    (count(*) FILTER (WHERE status = 'error'))::DOUBLE / count(*) AS error_rate,
    sum(duration_ms)::DOUBLE / count(*) AS avg_latency_ms
  FROM s JOIN p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id
  WHERE s.parent_span_id <> '' AND p.from_service <> s.service_name GROUP BY ALL""")
def service_edges(spark, sf):
    return TR.service_edges(T.spans(spark, sf))
