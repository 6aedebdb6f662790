"""Alert, notification, on-call and incident queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.operators import alerts as A, incidents as I
from obsframe.plans import tables as T
from obsframe.plans.registry import query

STEP = T.HOUR
FIRST = T.AS_OF - 30 * T.DAY

RULES = [
    A.AlertRule("click-mean", "event_click", "avg", "3h", ">", 5000, 0, "critical"),
    A.AlertRule("buy-mean", "event_purchase", "avg", "2h", ">", 5000, "1h", "warning"),
    A.AlertRule("error-peak", "event_error", "max", "2h", ">=", 6000, "2h", "info"),
    A.AlertRule("view-count", "event_view", "count", "6h", ">", 1.9, "1h", "warning", by=("host",)),
    A.AlertRule("signup-r1", "event_signup", "sum", "3h", "<", 9000, "1h", "critical", {"region": "r1"}),
    A.AlertRule("click-rate", "event_click", "rate", "1d", "!=", 0, "1d", "info"),
    A.AlertRule("view-now", "event_view", "instant", "1h", ">", 5000, "3h", "critical"),
    A.AlertRule("no-data", "event_nothing", "avg", "3h", ">", 0, 0, "critical"),
]


def _rules_sql() -> str:
    rows = ", ".join(
        f"('{r.name}', '{r.metric}', '{r.func}', {A.S.duration_ms(r.range)}, '{r.op}', {float(r.threshold)}::DOUBLE, "
        f"{A.S.duration_ms(r.hold)}, '{r.severity}', '{r.matchers.get('region', '')}', {str(bool(r.by)).lower()})"
        for r in RULES)
    return f"rules(rule, metric, func, rng, op, thr, hold, severity, region_is, by_host) AS (VALUES {rows})"


TICKS_SQL = f"""{T.METRICS_SQL}, {_rules_sql()},
  ticks AS (SELECT unnest(generate_series({FIRST}, {T.AS_OF}, {STEP})) AS tick_ms),
  per AS (SELECT rule, func, rng, by_host, tick_ms, host, labels_key, count(*) AS n, avg(value) AS a, sum(value) AS s,
            max(value) AS hi, min(value) AS lo, arg_max(value, (ts_ms, seq)) AS last, arg_min(value, (ts_ms, seq)) AS first
          FROM rules JOIN m ON m.name = rules.metric AND (region_is = '' OR region = region_is)
          JOIN ticks ON ts_ms <= tick_ms AND (func = 'instant' OR ts_ms >= tick_ms - rng)
          GROUP BY ALL),
  pv AS (SELECT *, CASE func WHEN 'avg' THEN a WHEN 'sum' THEN s WHEN 'count' THEN n WHEN 'max' THEN hi WHEN 'min' THEN lo
            WHEN 'rate' THEN CASE WHEN n >= 2 THEN (last - first) / (rng / 1000.0::DOUBLE) END ELSE last END AS v FROM per),
  g AS (SELECT rule, tick_ms, CASE WHEN NOT any_value(by_host) THEN any_value(v)
            WHEN any_value(func) = 'count' THEN count(v)::DOUBLE ELSE avg(v) END AS v
        FROM pv WHERE v IS NOT NULL GROUP BY rule, tick_ms, CASE WHEN by_host THEN host ELSE labels_key END),
  tv AS (SELECT rule, tick_ms, avg(v) AS value FROM g GROUP BY ALL),
  cond AS (SELECT r.*, t.tick_ms, coalesce(tv.value, 0) AS value, coalesce(CASE op WHEN '>' THEN tv.value > thr
             WHEN '>=' THEN tv.value >= thr WHEN '<' THEN tv.value < thr WHEN '!=' THEN tv.value <> thr END, false) AS c,
             row_number() OVER (PARTITION BY r.rule ORDER BY t.tick_ms) AS i
           FROM rules r CROSS JOIN ticks t LEFT JOIN tv ON tv.rule = r.rule AND tv.tick_ms = t.tick_ms)"""

STATES_SQL = f"""{TICKS_SQL},
  st AS (
    SELECT rule, i, CASE WHEN NOT c THEN 'inactive' WHEN hold = 0 THEN 'firing' ELSE 'pending' END AS state,
           tick_ms AS since, 'inactive' AS prev FROM cond WHERE i = 1
    UNION ALL
    SELECT n.rule, n.i,
      CASE st.state
        WHEN 'inactive' THEN CASE WHEN NOT n.c THEN 'inactive' WHEN n.hold = 0 THEN 'firing' ELSE 'pending' END
        WHEN 'pending' THEN CASE WHEN NOT n.c THEN 'inactive' WHEN n.tick_ms - st.since >= n.hold THEN 'firing' ELSE 'pending' END
        WHEN 'firing' THEN CASE WHEN n.c THEN 'firing' ELSE 'resolved' END
        ELSE 'inactive' END,
      CASE WHEN st.state = 'inactive' AND n.c THEN n.tick_ms ELSE st.since END, st.state
    FROM st JOIN cond n ON n.rule = st.rule AND n.i = st.i + 1),
  ev AS (SELECT cond.rule, cond.tick_ms AS ts_ms, st.state, cond.value, cond.severity, cond.op, cond.thr,
                cond.func || '(' || cond.metric || ')' AS expression
         FROM st JOIN cond ON cond.rule = st.rule AND cond.i = st.i WHERE st.state <> st.prev)"""


def _states(spark, sf):
    m = T.metrics(spark, sf)
    return A.states(A.conditions(m, A.rules_frame(spark, RULES), FIRST, T.AS_OF, STEP))


def _events(spark, sf):
    return A.events(_states(spark, sf))


@query("tick_values", f"WITH {TICKS_SQL} SELECT rule, tick_ms, round(value, 5) AS value FROM tv")
def tick_values(spark, sf):
    out = A.tick_values(T.metrics(spark, sf), A.rules_frame(spark, RULES), FIRST, T.AS_OF, STEP)
    return out.select("rule", "tick_ms", F.round("value", 5).alias("value"))


@query("alert_states", f"""WITH RECURSIVE {STATES_SQL}
  SELECT cond.rule, cond.tick_ms, cond.c AS condition, st.state FROM st JOIN cond ON cond.rule = st.rule AND cond.i = st.i""")
def alert_states(spark, sf):
    return _states(spark, sf).select("rule", "tick_ms", "condition", "state")


@query("alert_events", f"""WITH RECURSIVE {STATES_SQL}
  SELECT rule, ts_ms, state, round(value, 6) AS value, severity FROM ev""")
def alert_events(spark, sf):
    return _events(spark, sf).select("rule", "ts_ms", "state", F.round("value", 6).alias("value"), "severity")


@query("alert_annotations", f"""WITH RECURSIVE {STATES_SQL}
  SELECT rule AS title, ts_ms AS time, 'alert,' || state AS tags,
    expression || ' 当前值 ' || format('{{:.4f}}', value) || '（阈值：' || op || ' ' || format('{{:.4f}}', thr) || '）' AS text
  FROM ev WHERE ts_ms BETWEEN {T.AS_OF - 10 * T.DAY} AND {T.AS_OF}""")
def alert_annotations(spark, sf):
    out = A.annotations(_events(spark, sf), T.AS_OF - 10 * T.DAY, T.AS_OF)
    return out.withColumn("tags", F.array_join("tags", ","))


MID = T.AS_OF - 12 * T.DAY


@query("alerts_active", f"""WITH RECURSIVE {STATES_SQL}
  SELECT rule, max(ts_ms) AS ts_ms, arg_max(state, ts_ms) AS state FROM ev WHERE ts_ms <= {MID}
  GROUP BY rule HAVING arg_max(state, ts_ms) <> 'inactive'""")
def alerts_active(spark, sf):
    return A.active(_events(spark, sf), MID, include_pending=True).select("rule", "ts_ms", "state")


@query("alerts_firing", f"""WITH RECURSIVE {STATES_SQL}
  SELECT rule, max(ts_ms) AS ts_ms FROM ev WHERE ts_ms <= {MID} GROUP BY rule HAVING arg_max(state, ts_ms) = 'firing'""")
def alerts_firing(spark, sf):
    return A.active(_events(spark, sf), MID).select("rule", "ts_ms")


@query("alert_recent_outcomes", f"""WITH RECURSIVE {STATES_SQL}
  SELECT rule, ts_ms, state FROM ev WHERE state IN ('firing', 'resolved') ORDER BY ts_ms DESC, rule LIMIT 10""")
def alert_recent_outcomes(spark, sf):
    return A.recent_outcomes(_events(spark, sf)).select("rule", "ts_ms", "state")


CHANNELS = [A.Channel("ops-chat", "slack"), A.Channel("pager", "webhook", ("critical",)),
            A.Channel("mail", "email", ("warning", "critical"))]


@query("route_notifications", f"""WITH RECURSIVE {STATES_SQL},
  ch(channel, channel_type, sev) AS (VALUES ('ops-chat', 'slack', []::VARCHAR[]), ('pager', 'webhook', ['critical']),
    ('mail', 'email', ['warning', 'critical']))
  SELECT rule, ts_ms, state, channel, channel_type FROM ev JOIN ch ON len(sev) = 0 OR list_contains(sev, severity)
  WHERE state IN ('firing', 'resolved')""")
def route_notifications(spark, sf):
    out = A.route(A.notifications(_events(spark, sf)), CHANNELS)
    return out.select("rule", "ts_ms", "state", "channel", "channel_type")


SLOTS = [I.Slot("ana", 0, 8, ("mon", "tue", "wed")), I.Slot("bo", 8, 17, ("Mon", "Tue", "Wed", "Thu", "Fri")),
         I.Slot("cy", 6, 24, ("thu", "fri", "sat", "sun")), I.Slot("di", 17, 24, ("mon", "tue", "wed"))]


def _on_call_sql(ts: str, shift_h: int) -> str:
    local = f"(make_timestamp({ts} * 1000) + INTERVAL {shift_h} HOUR)"
    h, d = f"hour({local})", f"dayofweek({local})"
    cases = [(8, "ana", f"{h} < 8 AND {d} IN (1, 2, 3)"), (17, "bo", f"{h} >= 8 AND {h} < 17 AND {d} IN (1, 2, 3, 4, 5)"),
             (24, "cy", f"{h} >= 6 AND {d} IN (4, 5, 6, 0)"), (24, "di", f"{h} >= 17 AND {d} IN (1, 2, 3)")]
    day = f"(epoch_us(date_trunc('day', {local})) // 1000)"
    who = " ".join(f"WHEN {c} THEN '{u}'" for _, u, c in cases)
    until = " ".join(f"WHEN {c} THEN {day} + {(e - shift_h) * T.HOUR}" for e, _, c in cases)
    return f"CASE {who} ELSE '' END AS on_call, CASE {until} ELSE 0 END AS until_ms"


@query("oncall_assign", f"""WITH {T.METRICS_SQL}
  SELECT seq, ts_ms, {_on_call_sql("ts_ms", 8)} FROM m""")
def oncall_assign(spark, sf):
    rows = T.metrics(spark, sf).select("seq", "ts_ms")
    return I.assign_on_call(rows, "ts_ms", SLOTS, "Asia/Shanghai")


@query("incidents_opened", f"""WITH RECURSIVE {STATES_SQL},
  sp AS (SELECT *, lead(ts_ms) OVER (PARTITION BY rule ORDER BY ts_ms) AS ends FROM ev),
  inc AS (SELECT *, ts_ms + 5400000 AS created_ms FROM sp WHERE state = 'firing')
  SELECT rule, created_ms, '告警触发：' || rule AS title, 'investigating' AS status,
    CASE severity WHEN 'critical' THEN 'critical' WHEN 'info' THEN 'minor' ELSE 'major' END AS severity,
    on_call AS assigned_to
  FROM (SELECT *, {_on_call_sql("created_ms", 0)} FROM inc)
  WHERE created_ms <= {T.AS_OF} AND (ends IS NULL OR ends > created_ms)""")
def incidents_opened(spark, sf):
    out = I.auto_incidents(_events(spark, sf), T.AS_OF, SLOTS, open_after_ms=5_400_000)
    return out.select("rule", "created_ms", "title", "status", "severity", "assigned_to")


def incident_events(spark, sf):
    """Conversations as incident histories: the first turn creates, later turns update, comment or resolve."""
    c = T.table(spark, sf, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = (F.when(turn == 0, "create").when(turn % 4 == 2, "comment").when(turn % 4 == 3, "resolve").otherwise("update"))
    return c.select(
        conv.cast("string").alias("incident_id"), (T.LOG_START + conv * T.HOUR + turn * 60_000).alias("ts_ms"),
        turn.alias("seq"), kind.alias("type"), F.col("role").alias("author"),
        F.concat(F.lit("incident "), conv).alias("title"),
        F.when(turn % 4 == 1, F.when(conv % 2 == 0, "identified").otherwise("")).otherwise("monitoring").alias("status"),
        F.element_at(F.array(F.lit("minor"), F.lit(""), F.lit("critical")), (F.pmod(conv + turn, F.lit(3)) + 1).cast("int"))
        .alias("severity"),
        F.when(conv % 3 == 0, "").otherwise(F.col("role")).alias("assigned_to"), F.col("text").alias("message"))


INCIDENT_SQL = f"""ie AS (
  SELECT conv_id::VARCHAR AS incident_id, {T.LOG_START} + conv_id * {T.HOUR} + turn * 60000 AS ts_ms, turn AS seq,
    CASE WHEN turn = 0 THEN 'create' WHEN turn % 4 = 2 THEN 'comment' WHEN turn % 4 = 3 THEN 'resolve' ELSE 'update' END AS type,
    role AS author, 'incident ' || conv_id AS title,
    CASE WHEN turn % 4 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'identified' ELSE '' END ELSE 'monitoring' END AS status,
    (['minor', '', 'critical'])[(conv_id + turn) % 3 + 1] AS severity,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE role END AS assigned_to, text AS message
  FROM conversations),
  n AS (SELECT incident_id, ts_ms, seq, type, author, title, message,
          nullif(CASE type WHEN 'resolve' THEN 'resolved' WHEN 'create' THEN 'investigating' WHEN 'update' THEN status ELSE '' END, '') AS status,
          nullif(CASE WHEN type IN ('create', 'update') THEN severity ELSE '' END, '') AS severity,
          nullif(CASE WHEN type IN ('create', 'update') THEN assigned_to ELSE '' END, '') AS assigned_to FROM ie),
  b AS (SELECT *, coalesce(lag(status IGNORE NULLS) OVER w, '') AS p_status, coalesce(lag(severity IGNORE NULLS) OVER w, '') AS p_severity,
          coalesce(lag(assigned_to IGNORE NULLS) OVER w, '') AS p_assigned FROM n
        WINDOW w AS (PARTITION BY incident_id ORDER BY ts_ms, seq)),
  ch AS (SELECT *, coalesce(status <> p_status, false) AS c1, coalesce(severity <> p_severity, false) AS c2,
           coalesce(assigned_to <> p_assigned, false) AS c3 FROM b)"""


@query("incident_current", f"""WITH {INCIDENT_SQL}
  SELECT incident_id, max(title) FILTER (WHERE type = 'create') AS title,
    coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), '') AS status,
    coalesce(arg_max(severity, seq) FILTER (WHERE severity IS NOT NULL), '') AS severity,
    coalesce(arg_max(assigned_to, seq) FILTER (WHERE assigned_to IS NOT NULL), '') AS assigned_to,
    min(ts_ms) FILTER (WHERE type = 'create') AS created_ms, max(ts_ms) FILTER (WHERE type = 'resolve') AS resolved_ms,
    max(ts_ms) FILTER (WHERE type IN ('create', 'resolve') OR (type = 'comment' AND message <> '') OR c1 OR c2 OR c3) AS updated_ms
  FROM ch GROUP BY incident_id""")
def incident_current(spark, sf):
    return I.current_incidents(incident_events(spark, sf))


@query("incident_list", f"""WITH {INCIDENT_SQL}, cur AS (
    SELECT incident_id, coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), '') AS status,
      coalesce(arg_max(severity, seq) FILTER (WHERE severity IS NOT NULL), '') AS severity,
      min(ts_ms) FILTER (WHERE type = 'create') AS created_ms FROM ch GROUP BY incident_id)
  SELECT * FROM cur WHERE status = 'resolved' AND severity = 'critical'""")
def incident_list(spark, sf):
    out = I.list_incidents(I.current_incidents(incident_events(spark, sf)), "resolved", "critical")
    return out.select("incident_id", "status", "severity", "created_ms")


@query("incident_timeline", f"""WITH {INCIDENT_SQL}
  SELECT incident_id, ts_ms, seq, 0 AS part, author, 'created' AS type, '事故已创建：' || title AS message FROM ch WHERE type = 'create'
  UNION ALL SELECT incident_id, ts_ms, seq, 1, author, 'assigned', '已自动分配给值班人员：' || assigned_to FROM ch WHERE type = 'create' AND assigned_to IS NOT NULL
  UNION ALL SELECT incident_id, ts_ms, seq, 0, author, 'assigned', '已分配给：' || assigned_to FROM ch WHERE type = 'update' AND c3
  UNION ALL SELECT incident_id, ts_ms, seq, 1, author, 'updated', array_to_string(list_filter([
      CASE WHEN c1 THEN '状态：' || p_status || ' → ' || status END, CASE WHEN c2 THEN '级别：' || p_severity || ' → ' || severity END,
      CASE WHEN c3 THEN '负责人：' || p_assigned || ' → ' || assigned_to END], lambda x: x IS NOT NULL), '；')
    FROM ch WHERE type = 'update' AND (c1 OR c2 OR c3)
  UNION ALL SELECT incident_id, ts_ms, seq, 0, author, 'comment', message FROM ch WHERE type = 'comment' AND message <> ''
  UNION ALL SELECT incident_id, ts_ms, seq, 0, author, 'resolved', '事故已解决' FROM ch WHERE type = 'resolve'""")
def incident_timeline(spark, sf):
    return I.timeline(incident_events(spark, sf))
