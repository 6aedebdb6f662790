"""Streams fed in several files must equal the batch form on all of the rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.operators import rules as RULES, stats as ST
from obsframe.schemas import METRIC_COLUMNS
from obsframe.streaming import pipelines as PIPE, processors as PROC
from obsframe.streaming.runner import drain, run_batches
from test_alerts import fold

MIN = 60_000


def streamed(spark, df, path, cuts, column="ts_ms"):
    """Write the rows as one file per range of `column` and read them as a stream, one file at a time."""
    edges = [None, *cuts, None]
    seen = set()
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df
        if lo is not None:
            part = part.filter(F.col(column) >= lo)
        if hi is not None:
            part = part.filter(F.col(column) < hi)
        part.coalesce(1).write.mode("append").parquet(str(path))
        for file in set(path.glob("*.parquet")) - seen:
            os.utime(file, (1_000_000 + 10 * i,) * 2)
            seen.add(file)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture
def cpu(points):
    rng = np.random.default_rng(1)
    return points([("cpu", {"h": "ab"[i % 2]}, i * 7_000, float(rng.integers(0, 100))) for i in range(200)])


def rows(df):
    return sorted((r["name"], tuple(sorted(r["labels"].items())), r["ts_ms"], round(r["value"], 9)) for r in df.collect())


def test_downsample_closes_buckets_once(spark, cpu, tmp_path):
    stream = streamed(spark, cpu, tmp_path / "in", [400_000, 900_000])
    got = rows(drain(PIPE.downsample(stream, ":1m", "1 minute")))
    want = rows(RULES.bucket_means(cpu, MIN, ":1m"))
    newest = 199 * 7_000
    assert got == [r for r in want if r[2] + MIN <= newest - MIN]


def test_rules_equal_batch_at_every_tick(spark, cpu, tmp_path):
    rules = [RULES.RecordingRule("cpu", "cpu:sum", "sum", "5m", ("h",)), RULES.RecordingRule("cpu", "cpu:p95", "p95", "1m")]
    got = rows(drain(PIPE.record(streamed(spark, cpu, tmp_path / "in", [700_000]), rules), "complete"))
    for at in (5 * MIN, 11 * MIN, 20 * MIN):
        assert [r for r in got if r[2] == at] == rows(RULES.record(cpu, rules, at))


def test_alerts_over_batches_with_missing_ticks(spark, tmp_path):
    step, hold = 10, 20
    conds = [c == "x" for c in "xxxx..xxxxx.xxxx"]
    missing = {8, 9, 10, 13}
    data = [("r", i * step, 1.0, c, hold, "critical", "e", ">", 0.0) for i, c in enumerate(conds) if i not in missing]
    df = spark.createDataFrame(data, "rule string, tick_ms bigint, value double, condition boolean, hold_ms bigint, severity string, "
                                     "expression string, op string, threshold double")
    out = drain(PROC.alert_events(streamed(spark, df, tmp_path / "in", [30, 60, 120], "tick_ms"), step))
    got = [(r["ts_ms"], r["state"]) for r in out.orderBy("ts_ms").collect()]
    states = fold([c and i not in missing for i, c in enumerate(conds)], hold)
    want = [(i * step, s) for i, (s, b) in enumerate(zip(states, ["inactive"] + states)) if s != b]
    assert got == want


def test_rate_limit_state_survives_batches(spark, tmp_path):
    df = spark.createDataFrame([("", t, t) for t in (0, 0, 1, 600, 1200, 1201)], "key string, ts_ms bigint, seq bigint")
    df = df.withColumn("seq", F.monotonically_increasing_id())
    out = drain(PROC.rate_limit(streamed(spark, df, tmp_path / "in", [500, 1201]), 2, 1))
    got = [r["allowed"] for r in out.orderBy("ts_ms", "seq").collect()]
    assert got == [True, True, False, False, True, False]


def test_agents_go_offline_and_come_back(spark, tmp_path):
    S, T0 = 1000, 1_000_000
    beats = [("a", 0), ("b", 0), ("a", 20 * S), ("b", 100 * S), ("b", 130 * S), ("a", 160 * S), ("b", 165 * S)]
    df = spark.createDataFrame([(k, T0 + t) for k, t in beats], "agent string, ts_ms bigint")
    out = drain(PROC.agent_changes(streamed(spark, df, tmp_path / "in", [T0 + s * S for s in (10, 90, 120, 150)])))
    got = [(r["ts_ms"], r["status"]) for r in out.filter("agent = 'a'").orderBy("ts_ms").collect()]
    assert got == [(T0, "online"), (T0 + 50 * S + 1, "offline"), (T0 + 160 * S, "online")]


def test_anomaly_and_change_batches(spark, points, tmp_path):
    calm = [10.0, 11.0, 10.0, 9.0] * 6
    m = points([("m", {}, i * MIN, v) for i, v in enumerate(calm + [60.0] + calm)])
    stream = lambda n: streamed(spark, m, tmp_path / n, [20 * MIN, 24 * MIN])
    out, table = str(tmp_path / "anomalies"), str(tmp_path / "table")
    run_batches(stream("in1").select(*METRIC_COLUMNS), PIPE.anomaly_batches(table, out))
    got = spark.read.parquet(out)
    assert [r["ts_ms"] for r in got.select("ts_ms").collect()] == [24 * MIN]
    assert got.count() == ST.anomalies_backfill(m).count()
    step = points([("s", {}, i * MIN, 10.0 + i % 2 + (50 if i >= 20 else 0)) for i in range(30)])
    run_batches(streamed(spark, step, tmp_path / "in2", [25 * MIN]), PIPE.change_batches(str(tmp_path / "t2"), str(tmp_path / "changes")))
    found = spark.read.parquet(str(tmp_path / "changes"))
    assert {r["ts_ms"] for r in found.collect()} == {20 * MIN}
    changes = streamed(spark, found.select("metric", "ts_ms", "significance"), tmp_path / "in3", [])
    assert drain(PIPE.distinct_events(changes, ["metric", "ts_ms"])).count() == 1


def test_incident_batches(spark, tmp_path):
    ev = spark.createDataFrame([("r", 0, "firing", "critical"), ("r", 10 * MIN, "resolved", "critical"), ("q", 12 * MIN, "pending", "info")],
                               "rule string, ts_ms bigint, state string, severity string")
    out = str(tmp_path / "incidents")
    run_batches(streamed(spark, ev, tmp_path / "in", [5 * MIN, 11 * MIN]), PIPE.incident_batches(str(tmp_path / "events"), out))
    assert [(r["rule"], r["created_ms"]) for r in spark.read.parquet(out).collect()] == [("r", 5 * MIN)]


def test_live_batches(spark, points, cpu, tmp_path):
    m = points([("cpu_usage_percent", {}, 1000, 3.0), ("cpu_usage_percent", {}, 900, 2.0), ("other", {}, 1000, 9.0)])
    events = spark.createDataFrame([("r", 5, "firing", 1.0, "info", "x")], "rule string, ts_ms bigint, state string, value double, severity string, message string")
    logs = spark.createDataFrame([(i, "l", "s", "m", {}, i) for i in range(30)], "ts_ms bigint, level string, source string, message string, labels map<string,string>, seq bigint")
    sink = PIPE.live_batches(lambda s: {"metrics": m, "alert_events": events, "logs": logs}, str(tmp_path), lambda: 1000)
    sink(spark.range(1), 0)
    read = lambda n: spark.read.parquet(str(tmp_path / n)).collect()
    assert [r["value"] for r in read("metrics")] == [3.0] and [r["rule"] for r in read("alerts")] == ["r"]
    assert sorted(r["seq"] for r in read("logs")) == list(range(10, 30))


def test_late_points(spark, points):
    m = points([("a", {}, 30_000, 1), ("a", {}, 70_000, 2), ("b", {}, 1, 3)])
    fresh, late = PIPE.split_late(m, points([("a:1m", {}, 0, 1)]), ":1m")
    assert [r["ts_ms"] for r in late.collect()] == [30_000] and fresh.count() == 2
