"""Raw text and JSON, built from the test tables by Spark, through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import retention as RET
from obsframe.operators.select import scan
from obsframe.plans import tables as T
from obsframe.plans.governance import probe_results
from obsframe.plans.registry import query
from obsframe.sources import lines as LINES, payloads as P, sinks, snapshots as SNAP, webhooks as W
from obsframe.streaming.runner import scratch

INGEST = T.AS_OF
EV = "epoch_us(ts) // 1000"


def _columns():
    return F.col("event_id"), F.col("user_id"), F.col("value"), F.col("event_type")


def _bodies(df, body, *more):
    return df.select(body.alias("body"), F.lit(INGEST).cast("long").alias("ingest_ms"), F.col("event_id").alias("seq"), *more)


def _points(df, *more):
    return df.select("name", L.labels_key("labels").alias("labels_key"), "value", "ts_ms", "seq", *more)


def metric_bodies(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    first = F.format_string('{"name":"%s","labels":{"host":"h%d"},"value":%s,"timestamp":%d}', TYPE, U % 10,
                            V.cast("string"), F.when(I % 10 == 2, 0).otherwise(F.col("ts_ms")))
    second = (F.when(I % 10 == 0, '{"name":"extra","value":1,"unit":"ms"}').when(I % 10 == 1, '{"name":"","value":1}')
              .when(I % 10 == 3, '{"name":"extra","value":"x"}')
              .otherwise(F.format_string('{"name":"extra","value":%d}', U)))
    body = F.when(I % 10 == 4, "{not json").otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    return _bodies(ev, body)


@query("source_json_metrics", f"""WITH g AS (SELECT * FROM events WHERE event_id % 10 NOT IN (0, 1, 3, 4))
  SELECT event_type AS name, 'host=h' || (user_id % 10) || chr(10) AS labels_key, value,
    CASE WHEN event_id % 10 = 2 THEN {INGEST} ELSE {EV} END AS ts_ms, event_id AS seq, 0 AS item FROM g
  UNION ALL SELECT 'extra', '', user_id::DOUBLE, {INGEST}, event_id, 1 FROM g""")
def source_json_metrics(spark, sf):
    return _points(P.metrics(metric_bodies(spark, sf))[0], "item")


@query("source_json_rejected", """SELECT event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'unknown_field' WHEN 1 THEN 'empty_name'
    WHEN 3 THEN 'wrong_type' ELSE 'bad_json' END AS reason FROM events WHERE event_id % 10 IN (0, 1, 3, 4)""")
def source_json_rejected(spark, sf):
    return P.metrics(metric_bodies(spark, sf))[1].select("seq", "reason")


@query("source_json_logs", f"""SELECT CASE WHEN turn = 1 THEN {INGEST} ELSE {T.LOG_START} + conv_id END AS ts_ms,
    CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE role END AS source, 'info' AS level, md5(text) AS message_md5, conv_id AS seq, turn
  FROM conversations""")
def source_json_logs(spark, sf):
    c = T.table(spark, sf, "conversations")
    item = F.to_json(F.struct(
        F.when(F.col("turn") == 1, 0).otherwise(F.lit(T.LOG_START) + F.col("conv_id")).alias("timestamp"), F.lit("info").alias("level"),
        F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("role")).alias("source"), F.col("text").alias("message"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("labels")))
    body = F.when(F.col("turn") % 2 == 0, item).otherwise(F.concat(F.lit("[ "), item, F.lit("]")))
    rows = c.select(body.alias("body"), F.lit(INGEST).cast("long").alias("ingest_ms"), F.col("conv_id").alias("seq"))
    return P.logs(rows)[0].select("ts_ms", "source", "level", F.md5("message").alias("message_md5"), "seq",
                                  F.col("labels")["turn"].cast("long").alias("turn"))


@query("source_json_spans", f"""WITH {T.SPANS_SQL}
  SELECT trace_id, span_id, parent_span_id, operation_name, service_name, start_ms, duration_ms, status, seq FROM s WHERE span_id <> '7'""")
def source_json_spans(spark, sf):
    """Every span as a one-element body; those of line 7 lose their trace id and are dropped."""
    s = T.spans(spark, sf)
    item = F.to_json(F.struct(F.when(F.col("span_id") == "7", "").otherwise(F.col("trace_id")).alias("trace_id"), "span_id",
                              "parent_span_id", "operation_name", "service_name", F.col("start_ms").alias("start_time"),
                              "duration_ms", "status"))
    rows = s.select(F.concat(F.lit("["), item, F.lit("]")).alias("body"), F.lit(INGEST).cast("long").alias("ingest_ms"), "seq")
    return P.spans(rows)[0].select(*T_SPAN)


T_SPAN = ["trace_id", "span_id", "parent_span_id", "operation_name", "service_name", "start_ms", "duration_ms", "status", "seq"]


@query("source_exposition", f"""SELECT 'http_' || event_type AS name,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'host=h' || (user_id % 10) || chr(10) || 'note=a"b}}c\\d' || chr(10) || 'e' || chr(10) END AS labels_key,
    CASE WHEN event_id % 50 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS value,
    CASE WHEN event_id % 4 = 0 THEN {INGEST} ELSE {EV} END AS ts_ms, event_id AS seq
  FROM events WHERE event_id % 7 NOT IN (0, 1, 2, 3)""")
def source_exposition(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    labels = F.when(I % 3 == 0, F.when(I % 2 == 0, "{}").otherwise("")).otherwise(
        F.concat(F.lit('{host="h'), U % 10, F.lit('", note="a\\"b}c\\\\d\\ne"}')))
    value = F.when(I % 50 == 0, "+Inf").otherwise(V.cast("string"))
    line = F.concat(F.lit(" http_"), TYPE, labels, F.lit(" "), value, F.when(I % 4 == 0, "").otherwise(
        F.concat(F.lit("  "), F.col("ts_ms"))))
    line = (F.when(I % 7 == 0, "# TYPE http_x gauge").when(I % 7 == 1, "   ").when(I % 7 == 2, F.concat(F.lit("http_bad "), V.cast("string"), F.lit("d")))
            .when(I % 7 == 3, 'http_bad{host=unquoted} 1').otherwise(line))
    rows = ev.select(line.alias("line"), F.lit(INGEST).cast("long").alias("ingest_ms"), I.alias("seq"))
    return _points(LINES.exposition(rows))


@query("source_containers", f"""WITH c AS (SELECT 'c' || (user_id % 10) AS c, value, event_id AS seq, event_type FROM events WHERE event_id % 9 <> 0)
  SELECT 'container_cpu_percent' AS name, 'container=' || c || chr(10) AS labels_key, value, {INGEST} AS ts_ms, seq FROM c
  UNION ALL SELECT 'container_memory_mb', 'container=' || c || chr(10), CASE seq % 4 WHEN 0 THEN value * 1024 WHEN 1 THEN value
    WHEN 2 THEN value * 1000 ELSE value * 0.001 END, {INGEST}, seq FROM c WHERE seq % 5 <> 0
  UNION ALL SELECT 'container_status', 'container=' || c || chr(10), CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, {INGEST}, seq FROM c""")
def source_containers(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    unit = F.element_at(F.array(*[F.lit(x) for x in ("GiB", "MiB", "GB", "KB")]), (I % 4 + 1).cast("int"))
    memory = F.when(I % 5 == 0, "--").otherwise(F.concat(V.cast("string"), unit))
    line = F.concat(F.lit("/c"), U % 10, F.lit(","), V.cast("string"), F.lit("%,"), memory, F.lit(" / 16GiB,"),
                    F.when(TYPE == "error", "Exited (1)").otherwise("Up 3 hours, healthy"))
    line = F.when(I % 9 == 0, "broken,line").otherwise(line)
    rows = ev.select(line.alias("line"), F.lit(INGEST).cast("long").alias("ingest_ms"), I.alias("seq"))
    return _points(LINES.containers(rows))


@query("source_gpus", f"""SELECT 'gpu_usage_percent' AS name, 'gpu=' || (user_id % 8) || chr(10) AS labels_key, value, {INGEST} AS ts_ms, event_id AS seq FROM events
  UNION ALL SELECT 'gpu_memory_used_mb', 'gpu=' || (user_id % 8) || chr(10), user_id::DOUBLE, {INGEST}, event_id FROM events WHERE event_id % 6 <> 0
  UNION ALL SELECT 'gpu_temperature_celsius', 'gpu=' || (user_id % 8) || chr(10), event_id::DOUBLE, {INGEST}, event_id FROM events""")
def source_gpus(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    line = F.concat(U % 8, F.lit(", "), V.cast("string"), F.lit(", "), F.when(I % 6 == 0, "[N/A]").otherwise(U.cast("string")),
                    F.lit(", "), I.cast("string"))
    rows = ev.select(line.alias("line"), F.lit(INGEST).cast("long").alias("ingest_ms"), I.alias("seq"))
    return _points(LINES.gpus(rows))


@query("source_interfaces", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS seq, epoch_us(l_shipdate) // 1000 AS ts_ms,
      (['eth0', 'ETH1', 'lo'])[l_suppkey % 3 + 1] AS nic, * FROM lineitem)
  SELECT name, 'interface=' || nic || chr(10) AS labels_key, v::DOUBLE AS value, ts_ms, seq FROM (
    SELECT unnest(['network_bytes_sent', 'network_bytes_recv', 'network_packets_sent', 'network_packets_recv', 'network_errors']) AS name,
      unnest([l_partkey, l_suppkey, l_orderkey, l_linenumber, l_linenumber + l_quantity::BIGINT]) AS v, nic, ts_ms, seq FROM c WHERE nic <> 'lo')""")
def source_interfaces(spark, sf):
    """Line items as counters of three interfaces, two of them on the allow-list."""
    li = T.table(spark, sf, "lineitem")
    nic = F.element_at(F.array(F.lit("eth0"), F.lit("ETH1"), F.lit("lo")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = li.select(nic.alias("interface"), F.col("l_partkey").alias("bytes_sent"), F.col("l_suppkey").alias("bytes_recv"),
                     F.col("l_orderkey").alias("packets_sent"), F.col("l_linenumber").alias("packets_recv"),
                     F.col("l_linenumber").alias("errors_in"), F.col("l_quantity").cast("long").alias("errors_out"),
                     F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return _points(SNAP.interfaces(rows, ["ETH0", "eth1"]))


def processes(spark, sf):
    """Orders of a day as a snapshot of processes."""
    o = T.table(spark, sf, "orders")
    return o.select(F.unix_millis(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("ts_ms"),
                    F.col("o_orderkey").alias("pid"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"),
                    F.col("o_totalprice").alias("cpu_percent"), (F.col("o_custkey") * 1.0).cast("double").alias("memory_mb"))


PROC_SQL = """pr AS (SELECT epoch_us(date_trunc('month', o_orderdate)) // 1000 AS ts_ms, o_orderkey AS pid, o_orderpriority AS name,
    o_totalprice AS cpu_percent, o_custkey::DOUBLE AS memory_mb FROM orders),
  top AS (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY cpu_percent DESC, pid)::INTEGER AS rank FROM pr QUALIFY rank <= 20)"""


@query("source_processes", f"""WITH {PROC_SQL}
  SELECT 'process_cpu' AS name, 'name=' || name || chr(10) || 'pid=' || pid || chr(10) AS labels_key, cpu_percent AS value, ts_ms, pid AS seq FROM top
  UNION ALL SELECT 'process_memory_mb', 'name=' || name || chr(10) || 'pid=' || pid || chr(10), memory_mb, ts_ms, pid FROM top""")
def source_processes(spark, sf):
    return _points(SNAP.processes(processes(spark, sf)))


@query("top_processes", f"WITH {PROC_SQL} SELECT ts_ms, pid, cpu_percent, memory_mb, rank FROM top")
def top_processes(spark, sf):
    return SNAP.top_processes(processes(spark, sf), "memory").select("ts_ms", "pid", "cpu_percent", "memory_mb", "rank")


@query("source_probes", f"""WITH p AS (SELECT 'name=probe-' || (user_id % 7) || chr(10) || 'url=http://svc-' || (user_id % 7) || chr(10) AS labels_key,
    {EV} AS ts_ms, event_id AS seq, event_type, value FROM events)
  SELECT 'probe_status' AS name, labels_key, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS value, ts_ms, seq FROM p
  UNION ALL SELECT 'probe_response_ms', labels_key, round(value)::BIGINT::DOUBLE, ts_ms, seq FROM p""")
def source_probes(spark, sf):
    return _points(SNAP.probes(probe_results(spark, sf)))


def test_steps(spark, sf):
    """Conversations as synthetic-test runs: a turn is a step, long system or odd turns fail."""
    c = T.table(spark, sf, "conversations")
    n = F.length("text")
    return c.select(F.concat(F.lit("test-"), F.col("conv_id") % 5).alias("test"), F.col("conv_id").alias("run_id"),
                    F.col("turn").alias("step_no"), F.concat(F.lit("step "), "turn").alias("step"), (n % 7 != 0).alias("passed"),
                    F.concat(F.lit("length "), n).alias("error"), n.cast("long").alias("duration_ms"),
                    (T.LOG_START + F.col("conv_id") * 60_000).alias("ts_ms"))


STEP_SQL = f"""st AS (SELECT 'test-' || (conv_id % 5) AS test, conv_id, turn, length(text) AS n, length(text) % 7 <> 0 AS ok FROM conversations),
  stop AS (SELECT conv_id, min(turn) FILTER (WHERE NOT ok) AS stop FROM st GROUP BY conv_id),
  rn AS (SELECT test, conv_id AS seq, bool_and(ok) AS passed, sum(n)::BIGINT AS duration_ms, {T.LOG_START} + conv_id * 60000 AS ts_ms,
      coalesce('步骤 "step ' || min(turn) FILTER (WHERE NOT ok) || '" 失败: length ' || min(n) FILTER (WHERE NOT ok), '') AS error
    FROM st JOIN stop USING (conv_id) WHERE stop IS NULL OR turn <= stop GROUP BY test, conv_id)"""


@query("synthetic_runs", f"WITH {STEP_SQL} SELECT * FROM rn")
def synthetic_runs(spark, sf):
    return SNAP.runs(test_steps(spark, sf))


@query("source_runs", f"""WITH {STEP_SQL}
  SELECT 'synthetic_duration_ms' AS name, 'test=' || test || chr(10) AS labels_key, duration_ms::DOUBLE AS value, ts_ms, seq FROM rn
  UNION ALL SELECT 'synthetic_status', 'test=' || test || chr(10), passed::INT::DOUBLE, ts_ms, seq FROM rn""")
def source_runs(spark, sf):
    return _points(SNAP.run_metrics(test_steps(spark, sf)))


@query("json_generic", f"""SELECT 'hook' AS name, 'field=' || f || chr(10) AS labels_key, v AS value, {INGEST} AS ts_ms, event_id AS seq FROM (
    SELECT event_id, unnest(['k', 'value', 'user']) AS f, unnest([json_extract(props, '$.k')::DOUBLE, value, user_id::DOUBLE]) AS v
    FROM events WHERE event_id % 12 <> 0)""")
def json_generic(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    body = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.format_string(
        ', "value": %s, "user": %d, "type": "%s", "text": "7", "ok": true, "none": null, "inner": {"user": %d}}',
        V.cast("string"), U, TYPE, U))
    return _points(W.numeric_fields(_bodies(ev, F.when(I % 12 == 0, "[1, 2]").otherwise(body)), "hook"))


@query("json_rules", f"""WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'shop' ELSE 'ci' END AS hook FROM events)
  SELECT 'amount' AS name, 'type=' || event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user=' || user_id || chr(10) END
    || 'webhook=shop' || chr(10) AS labels_key, value, {INGEST} AS ts_ms, event_id AS seq FROM e WHERE hook = 'shop' AND event_type <> 'error'
  UNION ALL SELECT 'size', 'webhook=shop' || chr(10), user_id::DOUBLE, {INGEST}, event_id FROM e WHERE hook = 'shop' AND event_id % 3 <> 0
  UNION ALL SELECT 'builds', 'kind=' || event_type || chr(10) || 'webhook=ci' || chr(10), value, {INGEST}, event_id FROM e WHERE hook = 'ci' AND event_type <> 'error'""")
def json_rules(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    user = F.when(I % 3 == 0, "").otherwise(F.format_string(', "user": {"id": %d}', U))
    amount = F.when(TYPE == "error", '"high"').otherwise(V.cast("string"))
    body = F.concat(F.lit('{"data": {"amount": '), amount, user, F.lit('}, "type": "'), TYPE, F.lit('", "list": [1]}'))
    rules = {
        "shop": [W.ExtractRule("$.data.amount", "amount", {"type": "$.type", "user": "$.data.user.id"}),
                 W.ExtractRule("$.data.user.id", "size", {"gone": "$.data.gone"}), W.ExtractRule("$.list[0]", "never"),
                 W.ExtractRule("$.type", "never")],
        "ci": [W.ExtractRule("data.amount", "builds", {"kind": "type"})]}
    rows = _bodies(ev, body, F.when(I % 2 == 0, "shop").otherwise("ci").alias("endpoint"))
    return _points(W.extract(rows, rules))


@query("repository_events", f"""SELECT {INGEST} AS ts_ms, 'info' AS level, 'github-webhook' AS source, event_id AS seq,
  CASE event_id % 4
    WHEN 0 THEN '[github:push] u' || user_id || ' pushed to org/r' || (user_id % 9) || ' (2 commits)'
    WHEN 1 THEN '[github:pr] ' || event_type || ' PR#' || event_id || ' ''Fix ' || user_id || ''' by '
    WHEN 2 THEN '[github:issue] ' || event_type || ' issue#' || event_id || ' ''Bug ' || user_id || ''' by u' || user_id
    ELSE '[github:' || CASE WHEN event_id % 8 = 3 THEN 'unknown' ELSE 'release' END || '] webhook received' END AS message,
  CASE event_id % 4
    WHEN 0 THEN 'event=push' || chr(10) || 'ref=refs/' || event_type || chr(10) || 'repo=org/r' || (user_id % 9) || chr(10)
    WHEN 1 THEN 'action=' || event_type || chr(10) || 'event=pull_request' || chr(10) || 'repo=org/r' || (user_id % 9) || chr(10)
    WHEN 2 THEN 'action=' || event_type || chr(10) || 'event=issues' || chr(10) || 'repo=org/r' || (user_id % 9) || chr(10)
    ELSE 'event=' || CASE WHEN event_id % 8 = 3 THEN 'unknown' ELSE 'release' END || chr(10) END AS labels_key FROM events""")
def repository_events(spark, sf):
    ev = T.events_in(spark, sf)
    I, U, V, TYPE = _columns()
    repo = F.format_string('"repository":{"full_name":"org/r%d"}', U % 9)
    body = (F.when(I % 4 == 0, F.format_string('{"ref":"refs/%s","pusher":{"name":"u%d"},"commits":[{"id":1},{"id":2}],%s}', TYPE, U, repo))
            .when(I % 4 == 1, F.format_string('{"action":"%s","number":%d,"pull_request":{"title":"Fix %d"},%s}', TYPE, I, U, repo))
            .when(I % 4 == 2, F.format_string('{"action":"%s","issue":{"number":%d,"title":"Bug %d","user":{"login":"u%d"}},%s}', TYPE, I, U, U, repo))
            .otherwise("{}"))
    event = (F.when(I % 4 == 0, "push").when(I % 4 == 1, "pull_request").when(I % 4 == 2, "issues")
             .when(I % 8 == 3, "").otherwise("release"))
    out = W.repository_events(_bodies(ev, body, event.alias("event")))
    return out.withColumn("labels_key", L.labels_key("labels")).drop("labels")


@query("export_metrics", f"""WITH {T.METRICS_SQL}
  SELECT name AS metric, 'host=' || host || ',region=' || region AS labels, ts_ms AS timestamp, value::BIGINT::VARCHAR AS value FROM m
  WHERE ts_ms BETWEEN {T.AS_OF - 10 * T.DAY} AND {T.AS_OF}""")
def export_metrics(spark, sf):
    return sinks.metrics_export(T.metrics(spark, sf, T.AS_OF - 10 * T.DAY, T.AS_OF), T.AS_OF, start_ms=T.AS_OF - 10 * T.DAY)


@query("export_logs", f"""WITH {T.LOGS_SQL} SELECT ts_ms AS timestamp, level, source, md5(message) AS message_md5, 'lang=' || lang AS labels
  FROM l WHERE level = 'error' AND ts_ms BETWEEN {T.LOG_START} AND {T.AS_OF}""")
def export_logs(spark, sf):
    out = sinks.logs_export(T.logs(spark, sf), T.AS_OF, level="error", start_ms=T.LOG_START)
    return out.withColumn("message_md5", F.md5("message")).drop("message")


@query("export_traces", f"""WITH {T.SPANS_SQL}, t AS (SELECT trace_id, min(start_ms) AS start_ms, max(start_ms + duration_ms) - min(start_ms) AS duration_ms,
    string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services, bool_or(status = 'error') AS has_error,
    string_agg(span_id || ':' || start_ms, ',' ORDER BY (parent_span_id <> '')::INT, start_ms, seq, span_id) AS spans FROM s GROUP BY trace_id)
  SELECT *, 0 AS part FROM t WHERE start_ms >= 883612800000""")
def export_traces(spark, sf):
    out = sinks.traces_export(T.spans(spark, sf), 883612800000, T.AS_OF, part_size=1000)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["span_id"], F.lit(":"), s["start_ms"])), ",")
    return out.select("trace_id", "start_ms", "duration_ms", F.array_join("service_names", ",").alias("services"), "has_error",
                      spans.alias("spans"), "part")


@query("export_exposition", f"""WITH {T.METRICS_SQL}, r AS (SELECT name, host, region, arg_max(value, (ts_ms, seq)) AS v, max(ts_ms) AS t FROM m
    WHERE ts_ms BETWEEN {T.AS_OF - 2 * T.DAY} AND {T.AS_OF} GROUP BY ALL)
  SELECT DISTINCT '# TYPE ' || name || ' gauge' AS line FROM m
  UNION ALL SELECT name || '{{host="' || host || '",region="' || region || '"}} ' || v::BIGINT || ' ' || t FROM r""")
def export_exposition(spark, sf):
    return sinks.exposition(T.metrics(spark, sf), T.AS_OF, 2 * T.DAY).select("line")


@query("export_recording", f"""WITH {T.METRICS_SQL} SELECT '{{"name":"' || name || '","labels":{{"host":"' || host || '","region":"' || region
  || '"}},"value":' || value::BIGINT || '.0,"timestamp":' || ts_ms || '}}' AS line FROM m""")
def export_recording(spark, sf):
    return sinks.recording_lines(T.metrics(spark, sf)).select(F.to_json(F.struct("*")).alias("line"))


@query("metrics_table", f"""WITH {T.METRICS_SQL} SELECT labels_key, count(*) AS points, sum(value) AS total FROM m
  WHERE name = 'event_click' AND ts_ms BETWEEN {T.AS_OF - 9 * T.DAY} AND {T.AS_OF - 3 * T.DAY} GROUP BY labels_key""")
def metrics_table(spark, sf):
    """Append to a day-partitioned table, then read one metric and a week back."""
    path = scratch(spark, "metrics-table")
    sinks.append_metrics(T.metrics(spark, sf), path)
    rows = scan(sinks.read_metrics(spark, path), "event_click", T.AS_OF - 9 * T.DAY, T.AS_OF - 3 * T.DAY)
    return rows.groupBy("labels_key").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"))


@query("retention_table", f"""WITH {T.METRICS_SQL} SELECT name, count(*) AS points, min(ts_ms) AS oldest FROM m
  WHERE name <> 'event_error' AND ts_ms >= {T.AS_OF - 10 * T.DAY} GROUP BY name""")
def retention_table(spark, sf):
    """Enforce an age limit and a delete on a stored table by writing the survivors to a new one."""
    old, new = scratch(spark, "metrics-table"), scratch(spark, "metrics-table")
    sinks.append_metrics(T.metrics(spark, sf), old)
    policies = [RET.Policy("raw", r"^[^:]+$", max_age_s=10 * 86_400, builtin=True)]
    kept, _ = RET.delete_series(RET.enforce(sinks.read_metrics(spark, old), policies, T.AS_OF), "event_error")
    sinks.replace_days(kept, new)
    return sinks.read_metrics(spark, new).groupBy("name").agg(F.count(F.lit(1)).alias("points"), F.min("ts_ms").alias("oldest"))
