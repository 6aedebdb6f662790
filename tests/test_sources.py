import json
import math

import pytest

from obsframe import ext
from obsframe.operators import logs as LOG, traces as TR
from obsframe.operators.select import scan
from obsframe.schemas import SPAN_COLUMNS
from obsframe.sources import lines as LINES, payloads as P, sinks, snapshots as SNAP, webhooks as W


def lines(spark, *texts):
    return spark.createDataFrame([(t, 7, i) for i, t in enumerate(texts)], "line string, ingest_ms bigint, seq bigint")


def bodies(spark, *items, cols="body string, ingest_ms bigint, seq bigint"):
    rows = [(*(x if isinstance(x, tuple) else (x,)), 7, i) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, cols)


def test_exposition_text(spark):
    df = LINES.exposition(lines(
        spark, "# HELP x y", "", 'http_total{method="GET",path="/a\\"b\\\\c\\n"} 12.5 1000', "up 1", "nan NaN", "p +Inf", "m -inf 5",
        "bad", "bad{a=1} 1", "bad{a=\"1\" 1", "bad 1d", "b{le=\"0.5\"} 3 x", 'e{} 1e3', 'dup{a="1",a="2"} 1', 'c{a="}",} 2'))
    got = {r["name"]: (r["labels"], r["value"], r["ts_ms"]) for r in df.collect()}
    assert got["http_total"] == ({"method": "GET", "path": '/a"b\\c\n'}, 12.5, 1000)
    assert got["up"] == ({}, 1.0, 7) and math.isnan(got["nan"][1]) and got["p"][1] == math.inf and got["m"] == ({}, -math.inf, 5)
    assert got["b"] == ({"le": "0.5"}, 3.0, 7) and got["e"][1] == 1000 and got["dup"][0] == {"a": "2"} and got["c"][0] == {"a": "}"}
    assert "bad" not in got


def test_metric_bodies(spark):
    good, bad = P.metrics(bodies(
        spark, '[{"name":"a","labels":{"x":"1"},"value":2,"timestamp":5},{"name":"b","value":1.5}]', '[{"name":"a","value":1},{"name":""}]',
        '[{"name":"a","value":1,"extra":1}]', "oops", '[{"name":"a","value":"high"}]', "[]"))
    got = [(r["name"], r["labels"], r["value"], r["ts_ms"]) for r in good.orderBy("seq", "item").collect()]
    assert got == [("a", {"x": "1"}, 2.0, 5), ("b", {}, 1.5, 7)]
    assert {r["seq"]: r["reason"] for r in bad.collect()} == {1: "empty_name", 2: "unknown_field", 3: "bad_json", 4: "wrong_type"}


def test_log_and_span_bodies(spark):
    good, bad = P.logs(bodies(spark, '{"level":"odd","message":"m"}', '[{"timestamp":3,"source":"s","message":"n"}]', "{"))
    assert [(r["ts_ms"], r["level"], r["source"]) for r in good.orderBy("seq").collect()] == [(7, "odd", "unknown"), (3, "", "s")]
    assert bad.count() == 1
    good, bad = P.spans(bodies(spark, '[{"trace_id":"t","span_id":"1","logs":[{"timestamp":1,"message":"x"}]},{"trace_id":"t"}]', "[]"))
    assert [(r["span_id"], r["logs"][0]["message"]) for r in good.collect()] == [("1", "x")]
    assert [r["reason"] for r in bad.collect()] == ["empty"]


def test_webhooks(spark):
    push = '{"ref":"r","pusher":{"name":"n"},"repository":{"full_name":"o/r"},"commits":[{},{}]}'
    logs = W.repository_events(bodies(spark, ("push", push), ("", "{}"), ("x", "[1]"), cols="event string, body string, ingest_ms bigint, seq bigint"))
    assert [r["message"] for r in logs.orderBy("seq").collect()] == ["[github:push] n pushed to o/r (2 commits)", "[github:unknown] webhook received"]
    nums = W.numeric_fields(bodies(spark, '{"a":1,"b":2.5,"c":"3","d":true,"e":{"a":1},"f":null,"g":1e3}'), "m")
    assert {r["labels"]["field"]: r["value"] for r in nums.collect()} == {"a": 1, "b": 2.5, "g": 1000}
    rules = {"h": [W.ExtractRule("$.a.b", "ab", {"l": "$.s", "n": "$.a.b", "gone": "$.x.y"}), W.ExtractRule("$.s", "no"), W.ExtractRule("$.z", "no")]}
    out = W.extract(bodies(spark, ("h", '{"a":{"b":4},"s":"v"}'), ("other", '{"a":{"b":4}}'),
                           cols="endpoint string, body string, ingest_ms bigint, seq bigint"), rules).collect()
    assert [(r["name"], r["labels"], r["value"]) for r in out] == [("ab", {"webhook": "h", "l": "v", "n": "4"}, 4.0)]


def test_containers_and_gpus(spark):
    got = {(r["name"], r["seq"]): r["value"] for r in LINES.containers(lines(
        spark, "/web,0.50%,128MiB / 2GiB,Up 3 hours", "db,x%,1.5GiB / 2GiB,Exited (1), yes", "q,1%,512KiB,up", "short,1%", "z,1%,--,Up")).collect()}
    assert got["container_cpu_percent", 0] == 0.5 and got["container_memory_mb", 0] == 128 and got["container_status", 0] == 1
    assert ("container_cpu_percent", 1) not in got and got["container_memory_mb", 1] == 1536 and got["container_status", 1] == 0
    assert got["container_memory_mb", 2] == 0.5 and ("container_memory_mb", 4) not in got and not any(k[1] == 3 for k in got)
    gpu = {(r["name"], r["labels"]["gpu"]): r["value"] for r in LINES.gpus(lines(spark, "0, 55, 1024, 60", "1, [N/A], 10, 20", "x")).collect()}
    assert gpu == {("gpu_usage_percent", "0"): 55, ("gpu_memory_used_mb", "0"): 1024, ("gpu_temperature_celsius", "0"): 60,
                   ("gpu_memory_used_mb", "1"): 10, ("gpu_temperature_celsius", "1"): 20}


def test_runs_stop_at_first_failure(spark):
    cols = "test string, run_id bigint, step_no int, step string, passed boolean, error string, duration_ms bigint, ts_ms bigint"
    steps = spark.createDataFrame([("t", 1, 0, "a", True, "", 5, 9), ("t", 1, 1, "b", False, "500", 6, 9), ("t", 1, 2, "c", True, "", 100, 9),
                                   ("t", 2, 0, "a", True, "", 1, 10)], cols)
    got = {r["seq"]: (r["passed"], r["duration_ms"], "500" in r["error"]) for r in SNAP.runs(steps).collect()}
    assert got == {1: (False, 11, True), 2: (True, 1, False)}


def test_metrics_table_round_trip(spark, points, tmp_path):
    day = 86_400_000
    m = points([("a", {"h": str(i % 3)}, d * day + i, i) for d in range(3) for i in range(50)] + [("b", {}, 5, 1)])
    path = str(tmp_path / "metrics")
    sinks.append_metrics(m, path, files=3)
    back = sinks.read_metrics(spark, path)
    assert back.count() == 151
    part = scan(back, "a", day, day + 9)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,a)" in plan and "GreaterThanOrEqual(ts_ms" in plan and "day" in plan.split("PartitionFilters")[1][:120]
    assert part.count() == 10
    keep = points([("a", {}, day + 1, 42)])
    sinks.replace_days(keep, path)
    assert sinks.read_metrics(spark, path).groupBy("day").count().count() == 3 and sinks.read_metrics(spark, path).count() == 102


def test_exports(spark, points, tmp_path):
    m = points([("9x.y", {"b": "2", "a": 'q"'}, 1000, 1e7), ("9x.y", {}, 900, 0.25), ("old", {}, -400_000, 1)])
    out = sinks.metrics_export(m, 1000)
    assert {(r["labels"], r["value"]) for r in out.collect()} == {('a=q",b=2', "10000000"), ("", "0.25"), ("", "1")}
    sinks.write_exposition(m, str(tmp_path / "prom"), 1000)
    text = [r[0] for r in spark.read.text(str(tmp_path / "prom")).collect()]
    assert sorted(text) == sorted(["# TYPE _x_y gauge", "_x_y 0.25 900", '_x_y{a="q\\"",b="2"} 10000000 1000', "# TYPE old gauge"])
    again = LINES.exposition(lines(spark, *text))
    assert again.count() == 2
    sinks.write_json(sinks.recording_lines(m), str(tmp_path / "rec"))
    rec = P.recording(spark, str(tmp_path / "rec"))
    assert {(r["name"], r["ts_ms"], r["value"]) for r in rec.collect()} == {("9x.y", 1000, 1e7), ("9x.y", 900, 0.25), ("old", -400_000, 1.0)}
    (tmp_path / "bad.rec").write_text('{"name":"a"}\nnope\n')
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        P.recording(spark, str(tmp_path / "bad.rec")).collect()


def spans(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, operation_name string, service_name string, "
                                       "start_ms bigint, duration_ms bigint, status string, seq bigint")


def test_traces(spark, tmp_path):
    s = spans(spark, [("t", "2", "1", "q", "orders-db", 20, 30, "error", 0), ("t", "1", "", "get", "web", 10, 20, "ok", 1), ("t", "3", "9", "x", "web", 5, 1, "ok", 2),
                      ("u", "1", "", "get", "web", 0, 5, "ok", 3), ("u", "2", "1", "a", "api", 0, 4, "ok", 4), ("u", "2", "1", "b", "cache1", 0, 2, "ok", 5),
                      ("u", "3", "2", "c", "api", 1, 1, "error", 6), ("", "1", "", "n", "n", 0, 0, "ok", 7)])
    r = {x["trace_id"]: x for x in TR.rollup(s).collect()}
    assert (r["t"]["start_ms"], r["t"]["duration_ms"], r["t"]["service_names"], r["t"]["has_error"], r["t"]["root_service"]) == (5, 45, ["orders-db", "web"], True, "web")
    assert [x["span_id"] for x in TR.ordered_spans(s, 3).filter("trace_id = 't'").orderBy("position").collect()] == ["1", "3", "2"]
    parts = TR.trace_parts(s, 2, 3).orderBy("trace_id", "part").collect()
    assert [(p["trace_id"], p["part"], len(p["spans"])) for p in parts] == [("t", 0, 2), ("t", 1, 1), ("u", 0, 2), ("u", 1, 2)]
    e = {(x["from_service"], x["to_service"]): (x["request_count"], x["error_rate"], x["avg_latency_ms"]) for x in TR.service_edges(s).collect()}
    assert e == {("web", "orders-db"): (1, 1.0, 30.0), ("web", "api"): (1, 0.0, 4.0), ("web", "cache1"): (1, 0.0, 2.0), ("cache1", "api"): (1, 1.0, 1.0)}
    n = {x["name"]: (x["type"], x["request_count"]) for x in TR.service_nodes(s).collect()}
    assert n == {"web": ("api", 3), "orders-db": ("database", 1), "api": ("api", 2), "cache1": ("cache", 1)}
    assert [x["trace_id"] for x in TR.list_traces(s, min_duration_ms=1).collect()] == ["u", "t"]
    assert sinks.spans_export(s, 5, 5).count() == 3
    sinks.write_json(sinks.traces_export(s, 0, 100, part_size=1000), str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "traces")).filter("trace_id = 'u'").first()["spans"][0]["operation_name"] == "get"


def test_log_search(spark):
    rows = [(i * 10, lv, src, msg, {}, i) for i, (lv, src, msg) in enumerate([("info", "a", "User Logged in"), ("error", "a", "disk full 97%"), ("info", "b", "user out")])]
    logs = spark.createDataFrame(rows, "ts_ms bigint, level string, source string, message string, labels map<string,string>, seq bigint")
    ids = lambda **kw: [r["seq"] for r in LOG.search(logs, **kw).collect()]
    assert ids(query="USER") == [2, 0] and ids(query=r"/\d+%/") == [1] and ids(query="/(/") == [] and ids(query="/") == []
    assert ids(level="info", source="a") == [0] and ids(start_ms=10, end_ms=10) == [1] and ids(limit=1) == [2]


def test_extensions(spark):
    class Shards(ext.MetricSource):
        @classmethod
        def name(cls):
            return "shards"

        def parts(self):
            return [0, 1, 2]

        def collect(self, part):
            yield "shard_up", {"shard": str(part)}, 1.0, 1000 + part

    ext.register_source(spark, Shards)
    got = spark.read.format("shards").load()
    assert sorted((r["name"], r["labels"]["shard"], r["ts_ms"]) for r in got.collect()) == [("shard_up", str(i), 1000 + i) for i in range(3)]
    sent = {}
    sink = ext.notification_sink({k: (lambda df, i, k=k: sent.__setitem__(k, df.count())) for k in ("mail", "chat")})
    sink(spark.createDataFrame([("mail",), ("mail",), ("x",)], "channel_type string"), 0)
    assert sent == {"mail": 2, "chat": 0}
