"""Audit, tenant, quota, rate-limit, tag, agent, probe, objective and replay queries."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import alerts as A, governance as G, reliability as R, select as SEL
from obsframe.plans import tables as T
from obsframe.plans.registry import query

METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
PATHS = ["/api/v1/alerts/", "/api/v1/auth/keys/k", "/api/v1/probes/p", "/api/v1/incidents/i", "/api/v1/admin/reload",
         "/api/v1/tenants/", "/api/v1/audit", "/api/v1/panels/"]
TAILS = ["", "", "/start", "/resolve", "", "", "", "/comment"]


def access_log(spark, sf):
    """Events as HTTP requests."""
    ev = T.events_in(spark, sf)
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    uid = F.when((i % 8).isin(4, 6), "").otherwise(u.cast("string"))
    return ev.select(
        "ts_ms", i.alias("seq"), F.when(u % 20 == 0, "").otherwise(F.concat(F.lit("key-"), u)).alias("user"),
        pick(["admin", "operator", "viewer"], u).alias("role"), pick(METHODS, i).alias("method"),
        F.concat(pick(PATHS, i), uid, pick(TAILS, i)).alias("path"),
        F.when(i % 11 == 0, 403).when(i % 11 == 1, 401).otherwise(200).alias("status_code"),
        F.when(i % 2 == 0, F.concat(F.lit(" 10.0.0."), u % 9, F.lit(" , 172.16.0.1"))).otherwise("").alias("forwarded_for"),
        F.when(i % 13 == 0, "[::1]:8080").when(i % 17 == 0, "pipe")
        .otherwise(F.concat(F.lit("192.168.1."), u % 9, F.lit(":5000"))).alias("remote"))


ACCESS_SQL = f"""ac AS (
  SELECT epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, CASE WHEN user_id % 20 = 0 THEN '' ELSE 'key-' || user_id END AS user,
    (['admin', 'operator', 'viewer'])[user_id % 3 + 1] AS role, ({METHODS})[event_id % 7 + 1] AS method,
    ({PATHS})[event_id % 8 + 1] || CASE WHEN event_id % 8 IN (4, 6) THEN '' ELSE user_id::VARCHAR END || ({TAILS})[event_id % 8 + 1] AS path,
    CASE event_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 401 ELSE 200 END AS status_code,
    user_id, event_id FROM events),
  au AS (SELECT ts_ms, seq, CASE WHEN user = '' THEN 'anonymous' ELSE user END AS user,
    CASE WHEN method = 'POST' THEN 'create' WHEN method IN ('PUT', 'PATCH') THEN 'update' WHEN method = 'DELETE' THEN 'delete' END AS action,
    (['alert_rule', 'api_key', 'probe', 'incident', 'config', 'tenant', 'generic', 'generic'])[event_id % 8 + 1] AS resource_type,
    CASE event_id % 8 WHEN 4 THEN 'reload' WHEN 6 THEN 'audit' WHEN 1 THEN 'k' || user_id WHEN 2 THEN 'p' || user_id
      WHEN 3 THEN 'i' || user_id ELSE user_id::VARCHAR END AS resource_id,
    method || ' ' || path AS details,
    CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (user_id % 9) WHEN event_id % 13 = 0 THEN '::1' WHEN event_id % 17 = 0 THEN 'pipe'
      ELSE '192.168.1.' || (user_id % 9) END AS ip_address,
    CASE WHEN status_code IN (401, 403) THEN 'denied' ELSE 'success' END AS status
    FROM ac WHERE method IN ('POST', 'PUT', 'PATCH', 'DELETE'))"""


@query("audit_entries", f"WITH {ACCESS_SQL} SELECT * FROM au")
def audit_entries(spark, sf):
    return G.audit(access_log(spark, sf))


@query("audit_list", f"""WITH {ACCESS_SQL} SELECT * FROM au WHERE action = 'update' AND resource_type = 'incident'
  AND ts_ms >= {T.AS_OF - 20 * T.DAY}""")
def audit_list(spark, sf):
    return G.audit_list(G.audit(access_log(spark, sf)), action="update", kind="incident", start_ms=T.AS_OF - 20 * T.DAY)


@query("access_decisions", f"""WITH {ACCESS_SQL}, d AS (SELECT role, method, path,
    CASE WHEN role = 'admin' THEN true WHEN event_id % 8 IN (1, 4, 5, 6) THEN false
      WHEN role = 'viewer' THEN method IN ('GET', 'HEAD', 'OPTIONS') ELSE true END AS allowed FROM ac)
  SELECT role, method, allowed, count(*) AS requests, count(DISTINCT path) AS paths FROM d GROUP BY ALL""")
def access_decisions(spark, sf):
    rows = access_log(spark, sf).withColumn("allowed", G.allowed(F.col("role"), F.col("method"), F.col("path")))
    return rows.groupBy("role", "method", "allowed").agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("path").alias("paths"))


TENANTS = [G.Tenant("default"), G.Tenant("acme", "acme_", "key-1"), G.Tenant("blue", "event_s", "key-14"),
           G.Tenant("coral", "", "key-2")]


@query("tenant_by_key", """WITH k AS (SELECT 'key-' || user_id AS key_name FROM events)
  SELECT key_name, CASE WHEN key_name LIKE 'key-14%' THEN 'blue' WHEN key_name LIKE 'key-1%' THEN 'acme'
    WHEN key_name LIKE 'key-2%' THEN 'coral' ELSE 'default' END AS tenant, count(*) AS n FROM k GROUP BY ALL""")
def tenant_by_key(spark, sf):
    rows = T.table(spark, sf, "events").select(F.concat(F.lit("key-"), "user_id").alias("key_name"))
    return (rows.withColumn("tenant", G.tenant_by_key(F.col("key_name"), TENANTS))
            .groupBy("key_name", "tenant").agg(F.count(F.lit(1)).alias("n")))


@query("tenant_prefix", """WITH t(id, p) AS (VALUES ('default', ''), ('acme', 'acme_'), ('blue', 'event_s'), ('coral', '')),
  e AS (SELECT 'event_' || event_type AS name, (['acme', 'blue', '', 'nobody'])[user_id % 4 + 1] AS tid FROM events)
  SELECT coalesce(t.id, 'default') AS tenant, CASE WHEN coalesce(p, '') = '' OR starts_with(name, p) THEN name ELSE p || name END AS name,
    count(*) AS n FROM e LEFT JOIN t ON t.id = tid GROUP BY ALL""")
def tenant_prefix(spark, sf):
    tenants = spark.createDataFrame([(t.id, t.metric_prefix) for t in TENANTS], "id string, metric_prefix string")
    tid = F.element_at(F.array(F.lit("acme"), F.lit("blue"), F.lit(""), F.lit("nobody")), (F.col("user_id") % 4 + 1).cast("int"))
    rows = T.table(spark, sf, "events").select(F.concat(F.lit("event_"), "event_type").alias("name"), tid.alias("tenant_id"))
    out = G.tenant_by_id(rows, tenants)
    return (out.select("tenant", G.prefixed(F.col("name"), F.col("metric_prefix")).alias("name"))
            .groupBy("tenant", "name").agg(F.count(F.lit(1)).alias("n")))


LIMITS = {"click": 40, "view": 90, "error": 0, "purchase": 25}


def batches(spark, sf):
    """Each event is a batch of 1 to 12 units of the resource named by its type."""
    return T.events_in(spark, sf).select(F.col("event_type").alias("resource"), "ts_ms", F.col("event_id").alias("seq"),
                                         (F.col("user_id") % 13).alias("delta"))


BATCH_SQL = """bt AS (SELECT event_type AS resource, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, user_id % 13 AS delta,
  CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 90 WHEN 'purchase' THEN 25 ELSE 0 END AS lim FROM events)"""


@query("quota_usage", f"""WITH {BATCH_SQL} SELECT resource, ts_ms // 60000 * 60000 AS minute_ms, sum(delta)::BIGINT AS demand,
  any_value(lim)::BIGINT AS "limit", ts_ms // 60000 * 60000 + 60000 AS reset_at_ms FROM bt GROUP BY resource, ts_ms // 60000""")
def quota_usage(spark, sf):
    return G.quota_usage(batches(spark, sf), LIMITS)


@query("quota_admit", f"""WITH RECURSIVE {BATCH_SQL}, o AS (
    SELECT *, ts_ms // {6 * T.HOUR} AS w, row_number() OVER (PARTITION BY resource, ts_ms // {6 * T.HOUR} ORDER BY ts_ms, seq) AS i FROM bt),
  r AS (SELECT resource, w, i, seq, (lim = 0 OR delta <= lim) AS ok, CASE WHEN lim = 0 OR delta <= lim THEN delta ELSE 0 END AS used FROM o WHERE i = 1
    UNION ALL SELECT o.resource, o.w, o.i, o.seq, (lim = 0 OR r.used + delta <= lim),
      r.used + CASE WHEN lim = 0 OR r.used + delta <= lim THEN delta ELSE 0 END
    FROM r JOIN o ON o.resource = r.resource AND o.w = r.w AND o.i = r.i + 1)
  SELECT resource, seq, ok AS admitted FROM r""")
def quota_admit(spark, sf):
    """Six-hour windows instead of minutes, so the sparse test events compete."""
    return G.quota_admit(batches(spark, sf), LIMITS, width_ms=6 * T.HOUR).select("resource", "seq", "admitted")


@query("rate_limit", f"""WITH RECURSIVE q AS (
    SELECT CASE WHEN user_id % 10 = 0 THEN 'anonymous' ELSE 'key-' || (user_id % 10) END AS key, event_id AS seq,
           epoch_us(ts) // 1000000 AS t FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM q),
  r AS (SELECT key, i, seq, t, true AS allowed, 2 * 2400 AS units FROM o WHERE i = 1
    UNION ALL SELECT o.key, o.i, o.seq, o.t, least(7200, r.units + (o.t - r.t)) >= 2400,
      least(7200, r.units + (o.t - r.t)) - CASE WHEN least(7200, r.units + (o.t - r.t)) >= 2400 THEN 2400 ELSE 0 END
    FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
  SELECT key, seq, allowed, units // 2400 AS remaining FROM r""")
def rate_limit(spark, sf):
    """Three tokens, one back every 40 minutes, so the sparse test events hit the limit."""
    rows = T.events_in(spark, sf).select(
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("key-"), F.col("user_id") % 10)).alias("key"),
        "ts_ms", F.col("event_id").alias("seq"))
    out = G.rate_limit(rows, 3, Fraction(1, 2400), tick_ms=1000, chunk_ticks=604_800)
    return out.select("key", "seq", "allowed", "remaining")


def tag_tables(spark, sf):
    """Brands and types as tags, attached to parts and, by nation, to suppliers."""
    p = T.table(spark, sf, "part")
    brand = p.select(F.concat(F.lit("b:"), "p_brand").alias("id"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    kind = p.select(F.concat(F.lit("t:"), "p_type").alias("id"), F.lit("type").alias("key"), F.col("p_type").alias("value"))
    tags = brand.unionByName(kind).distinct()
    pid = F.col("p_partkey").cast("string").alias("resource_id")
    att = (p.select(F.lit("part").alias("resource_type"), pid, F.concat(F.lit("b:"), "p_brand").alias("tag_id"))
           .unionByName(p.select(F.lit("part").alias("resource_type"), pid, F.concat(F.lit("t:"), "p_type").alias("tag_id")))
           .unionByName(p.select(F.lit("shelf").alias("resource_type"), F.col("p_size").cast("string").alias("resource_id"),
                                 F.concat(F.lit("t:"), "p_type").alias("tag_id"))))
    return att, tags


TAG_SQL = """att AS (SELECT DISTINCT * FROM (
    SELECT 'part' AS resource_type, p_partkey::VARCHAR AS resource_id, 'brand' AS key, p_brand AS value, 'b:' || p_brand AS tag_id FROM part
    UNION ALL SELECT 'part', p_partkey::VARCHAR, 'type', p_type, 't:' || p_type FROM part
    UNION ALL SELECT 'shelf', p_size::VARCHAR, 'type', p_type, 't:' || p_type FROM part))"""


@query("tag_search", f"""WITH {TAG_SQL} SELECT * FROM att WHERE (resource_type, resource_id) IN (
  SELECT (resource_type, resource_id) FROM att WHERE key || ':' || value = 'type:ECONOMY' OR value = 'type:ECONOMY')""")
def tag_search(spark, sf):
    return G.search_by_tag(*tag_tables(spark, sf), " type:ECONOMY ")


@query("tags_for_resource", f"WITH {TAG_SQL} SELECT * FROM att WHERE resource_type = 'shelf' AND resource_id = '11'")
def tags_for_resource(spark, sf):
    return G.tags_for_resource(*tag_tables(spark, sf), "shelf", "11")


@query("agents", f"""SELECT o_custkey::VARCHAR AS agent, arg_max(o_orderpriority, (epoch_us(o_orderdate) // 1000, o_orderkey)) AS host,
    min(epoch_us(o_orderdate) // 1000) AS registered_ms, max(epoch_us(o_orderdate) // 1000) AS last_seen_ms,
    CASE WHEN 959817600000 - max(epoch_us(o_orderdate) // 1000) > {30 * T.DAY} THEN 'offline' ELSE 'online' END AS status
  FROM orders WHERE epoch_us(o_orderdate) // 1000 <= 959817600000 GROUP BY o_custkey""")
def agents(spark, sf):
    """Orders as heartbeats of their customers."""
    hb = T.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("agent"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("host"))
    return G.agents(hb, 959_817_600_000, stale_after_ms=30 * T.DAY)


def probe_results(spark, sf):
    ev = T.events_in(spark, sf)
    up = F.col("event_type") != "error"
    return ev.select(F.concat(F.lit("probe-"), F.col("user_id") % 7).alias("name"),
                     F.concat(F.lit("http://svc-"), F.col("user_id") % 7).alias("url"), "ts_ms", F.col("event_id").alias("seq"),
                     F.when(up, "up").otherwise("down").alias("status"), F.when(up, 200).otherwise(503).alias("status_code"),
                     F.round("value", 0).cast("long").alias("response_ms"))


PROBE_SQL = """pr AS (SELECT 'probe-' || (user_id % 7) AS name, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS status, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status_code,
    round(value)::BIGINT AS response_ms FROM events),
  rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_ms DESC, seq DESC) AS rn FROM pr),
  ps AS (SELECT name, max(status) FILTER (WHERE rn = 1) AS status, max(status_code) FILTER (WHERE rn = 1) AS status_code,
    max(response_ms) FILTER (WHERE rn = 1) AS response_ms, max(ts_ms) AS last_check_ms,
    avg((status = 'up')::INT::DOUBLE) * 100 AS uptime_pct,
    string_agg(seq::VARCHAR, ',' ORDER BY ts_ms, seq) FILTER (WHERE rn <= 20) AS recent FROM rk WHERE rn <= 100 GROUP BY name)"""


@query("probe_status", f"""WITH {PROBE_SQL} SELECT name, status, status_code, response_ms, last_check_ms, round(uptime_pct, 6) AS uptime_pct, recent FROM ps""")
def probe_status(spark, sf):
    out = R.probe_status(probe_results(spark, sf))
    return out.withColumn("recent", F.array_join(F.transform("recent", lambda x: x["seq"].cast("string")), ",")).withColumn(
        "uptime_pct", F.round("uptime_pct", 6))


@query("overall_status", f"""WITH {PROBE_SQL} SELECT CASE WHEN count(*) FILTER (WHERE status = 'down') = 0 THEN 'operational'
  WHEN count(*) FILTER (WHERE status = 'down') = count(*) THEN 'down' ELSE 'degraded' END AS overall FROM ps""")
def overall_status(spark, sf):
    return R.overall_probe_status(R.probe_status(probe_results(spark, sf)))


@query("health_checks", """WITH c AS (SELECT CASE WHEN min(n) >= 1000 THEN 'healthy' WHEN min(n) >= 10 THEN 'degraded' ELSE 'unhealthy' END AS s
    FROM (SELECT count(*) AS n FROM events GROUP BY event_type)
  UNION ALL SELECT CASE WHEN avg(value) < 30 THEN 'healthy' ELSE 'degraded' END FROM events)
  SELECT CASE WHEN bool_or(s = 'unhealthy') THEN 'unhealthy' WHEN bool_or(s = 'degraded') THEN 'degraded' ELSE 'healthy' END AS overall FROM c""")
def health_checks(spark, sf):
    from obsframe import ext
    ev = T.table(spark, sf, "events")
    per_type = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.min("n")
    checks = [ext.HealthCheck("volume", per_type, F.when(n >= 1000, "healthy").when(n >= 10, "degraded").otherwise("unhealthy")),
              ext.HealthCheck("latency", ev, F.when(F.avg("value") < 30, "healthy").otherwise("degraded"))]
    return R.worst_check(ext.run_checks(checks))


SLO_RANGE = 7 * T.DAY


@query("slo_status", f"""WITH {T.METRICS_SQL}, per AS (
    SELECT name, labels_key, avg(value) AS v FROM m WHERE ts_ms BETWEEN {T.AS_OF - SLO_RANGE} AND {T.AS_OF} GROUP BY ALL),
  q AS (SELECT 'clicks' AS name, avg(v) / 50 AS value FROM per WHERE name = 'event_click'
    UNION ALL SELECT 'views', CASE WHEN avg(v) > 1000 THEN 100 ELSE 0 END FROM per WHERE name = 'event_view'),
  o(name, target_percent, "window", minutes) AS (VALUES ('clicks', 90.0::DOUBLE, '7d', 10080.0::DOUBLE),
    ('views', 99.9, '30d', 43200), ('nothing', 95, '1d', 1440)),
  s AS (SELECT o.*, greatest(0, least(100, coalesce(value, 0))) AS sli FROM o LEFT JOIN q USING (name)),
  b AS (SELECT *, (1 - target_percent / 100) * minutes AS tot, greatest(0, (1 - sli / 100) * minutes) AS used FROM s)
  SELECT name, "window", round(sli, 6) AS current_sli, round(tot, 6) AS budget_total, round(used, 6) AS budget_consumed,
    round(greatest(0, least(100, (tot - used) / tot * 100)), 6) AS budget_remaining_pct, sli >= target_percent AS healthy FROM b""")
def slo_status(spark, sf):
    m = T.metrics(spark, sf, T.AS_OF - SLO_RANGE, T.AS_OF, ["event_click", "event_view"])
    rules = A.rules_frame(spark, [A.AlertRule("clicks", "event_click", "avg", SLO_RANGE),
                                  A.AlertRule("views", "event_view", "avg", SLO_RANGE)])
    v = A.tick_values(m, rules, T.AS_OF, T.AS_OF, T.AS_OF)
    is_bool = F.col("name") == "views"
    v = v.select(F.col("rule").alias("name"), "value").withColumn("result", F.col("value") > 1000)
    v = v.withColumn("value", F.when(is_bool, F.when(F.col("result"), 100.0).otherwise(0.0)).otherwise(F.col("value") / 50))
    o = R.objectives_frame(spark, [R.Objective("clicks", 90, "7d"), R.Objective("views", 99.9, "x"), R.Objective("nothing", 95, "1d")])
    out = R.objective_status(o, v.select("name", "value"))
    return out.select("name", "window", *[F.round(c, 6).alias(c) for c in (
        "current_sli", "budget_total", "budget_consumed", "budget_remaining_pct")], "healthy")


@query("event_history", f"""WITH {ACCESS_SQL} SELECT * FROM au WHERE resource_type = 'probe'""")
def event_history(spark, sf):
    return R.newest(G.audit(access_log(spark, sf)), where=F.col("resource_type") == "probe", ties=[F.desc("seq")])


@query("run_history", f"""WITH {PROBE_SQL} SELECT name, seq, ts_ms, status, rn::INTEGER AS rank FROM rk WHERE rn <= 20""")
def run_history(spark, sf):
    return R.newest_per_key(probe_results(spark, sf), ["name"], 20).select("name", "seq", "ts_ms", "status", "rank")


@query("replay_schedule", f"""WITH {T.METRICS_SQL}, d AS (
    SELECT name AS recording, seq, ts_ms, lag(ts_ms) OVER (PARTITION BY name ORDER BY seq) AS prev FROM m),
  e AS (SELECT *, CASE WHEN prev > 0 AND ts_ms > prev THEN floor((ts_ms - prev) / 2.5)::BIGINT ELSE 0 END AS delay_ms FROM d)
  SELECT recording, seq, delay_ms, (sum(delay_ms) OVER (PARTITION BY recording ORDER BY seq))::BIGINT AS replay_at_ms FROM e""")
def replay_schedule(spark, sf):
    rec = T.metrics(spark, sf).select(F.col("name").alias("recording"), "seq", "ts_ms")
    return R.replay_schedule(rec, "2.5x").select("recording", "seq", "delay_ms", "replay_at_ms")
