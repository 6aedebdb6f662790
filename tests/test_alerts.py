import random

import pytest
from pyspark.sql import functions as F

from obsframe.operators import alerts as A, incidents as I
from obsframe.streaming.processors import next_state

STEP = 10


def fold(conditions, hold):
    state, since, out = "inactive", 0, []
    for i, c in enumerate(conditions):
        state, since = next_state(state, since, c, i * STEP, hold)
        out.append(state)
    return out


def ticks(spark, rules):
    rows = [(name, i * STEP, float(c), c, hold, "critical", "e", ">", 0.5)
            for name, (conds, hold) in rules.items() for i, c in enumerate(conds)]
    return spark.createDataFrame(rows, "rule string, tick_ms bigint, value double, condition boolean, hold_ms bigint, "
                                       "severity string, expression string, op string, threshold double")


def test_states_equal_the_fold(spark):
    rng = random.Random(5)
    rules = {}
    for i in range(120):
        p, hold = rng.choice([0.5, 0.7, 0.9]), rng.choice([0, 10, 20, 30, 45])
        rules[f"r{i}"] = ([rng.random() < p for _ in range(60)], hold)
    rules["alternating"] = ([True, True, True, False] * 12, 20)
    rules["single"] = ([True, False] * 20, 0)
    got = {}
    for r in A.states(ticks(spark, rules)).orderBy("rule", "tick_ms").collect():
        got.setdefault(r["rule"], []).append(r["state"])
    for name, (conds, hold) in rules.items():
        assert got[name] == fold(conds, hold), name


def test_named_transitions(spark):
    f = lambda s: [c == "x" for c in s]
    assert fold(f("xx.xx"), 0) == ["firing", "firing", "resolved", "inactive", "firing"]
    assert fold(f("xxx..."), 20) == ["pending", "pending", "firing", "resolved", "inactive", "inactive"]
    assert fold(f("xx.xx"), 20) == ["pending", "pending", "inactive", "pending", "pending"]


def test_rules_end_to_end(spark, points):
    rows = [("cpu", {"h": "a"}, t, 90 if t < 60 else 10) for t in range(0, 120, 5)] + [("cpu", {"h": "b"}, 3, 50)]
    rules = A.rules_frame(spark, [A.AlertRule("hot", "cpu", "max", 20, ">=", 90, 0, "critical", {"h": "a"}),
                                  A.AlertRule("silent", "nothing", "avg", 20, "<", 1), A.AlertRule("odd", "cpu", "avg", 20, "~", 1),
                                  A.AlertRule("latest", "cpu", "instant", 20, "==", 50, 0, "info", {"h": "b"})])
    ev = A.run_rules(points(rows), rules, 0, 120, STEP)
    got = [(r["rule"], r["ts_ms"], r["state"]) for r in ev.orderBy("rule", "ts_ms").collect()]
    assert got == [("hot", 0, "firing"), ("hot", 80, "resolved"), ("hot", 90, "inactive"), ("latest", 10, "firing")]
    assert [r["rule"] for r in A.active(ev).collect()] == ["latest"]
    assert {r["rule"] for r in A.active(ev, 80, include_pending=True).collect()} == {"hot", "latest"}
    ann = A.annotations(ev, 80, 80).first()
    assert (ann["title"], ann["tags"]) == ("hot", ["alert", "resolved"])
    assert [r["state"] for r in A.recent_outcomes(ev, 2).collect()] == ["resolved", "firing"]
    with pytest.raises(ValueError):
        A.rules_frame(spark, [A.AlertRule("x", "cpu", "median")])


@pytest.mark.parametrize("func", ["avg", "sum", "count", "max", "min", "last", "rate"])
def test_tick_values_against_brute_force(spark, points, func):
    rng = random.Random(1)
    rows = [("m", {"h": rng.choice("ab"), "i": rng.choice("xyz")}, rng.randrange(0, 300), rng.randrange(100)) for _ in range(200)]
    rules = A.rules_frame(spark, [A.AlertRule("plain", "m", func, 35), A.AlertRule("grouped", "m", func, 40, by=("h",))])
    got = {(r["rule"], r["tick_ms"]): r["value"] for r in A.tick_values(points(rows), rules, 0, 320, STEP).collect()}

    def one(vals):
        if func == "rate":
            return None
        return {"avg": sum(vals) / len(vals), "sum": sum(vals), "count": len(vals), "max": max(vals), "min": min(vals), "last": vals[-1]}[func]

    want = {}
    for rule, rng_ms in (("plain", 35), ("grouped", 40)):
        for t in range(0, 321, STEP):
            per = {}
            for i, (_, labels, ts, v) in enumerate(rows):
                if t - rng_ms <= ts <= t:
                    per.setdefault((labels["h"], labels["i"]), []).append((ts, i, v))
            vals = {}
            for k, ps in per.items():
                ps = [v for _, _, v in sorted(ps)]
                if func == "rate":
                    if len(ps) >= 2:
                        vals[k] = (ps[-1] - ps[0]) / (rng_ms / 1000)
                else:
                    vals[k] = one(ps)
            if rule == "grouped":
                groups = {}
                for k in sorted(vals):
                    groups.setdefault(k[0], []).append(vals[k])
                vals = {h: (vs[-1] if func == "rate" else one(vs)) for h, vs in groups.items()}
            if vals:
                want[rule, t] = sum(vals.values()) / len(vals)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_routing(spark):
    n = spark.createDataFrame([("a", "critical"), ("b", "info")], "rule string, severity string")
    out = A.route(n, [A.Channel("all", "log"), A.Channel("page", "webhook", ("critical",))])
    assert sorted((r["rule"], r["channel"]) for r in out.collect()) == [("a", "all"), ("a", "page"), ("b", "all")]


def test_on_call(spark):
    slots = [I.Slot("night", 20, 24, ("mon",)), I.Slot("day", 8, 20, ("Mon", "tue"))]
    monday = 1_704_067_200_000
    rows = spark.createDataFrame([(monday + h * 3_600_000,) for h in (0, 8, 21, 40)], "t bigint")
    got = [(r["on_call"], r["until_ms"]) for r in I.assign_on_call(rows, "t", slots).orderBy("t").collect()]
    assert got == [("", 0), ("day", monday + 20 * 3_600_000), ("night", monday + 24 * 3_600_000), ("day", monday + 44 * 3_600_000)]
    tokyo = I.assign_on_call(rows.filter(F.col("t") == monday), "t", slots, "Asia/Tokyo").first()
    assert tokyo["on_call"] == "day" and tokyo["until_ms"] == monday + 11 * 3_600_000
    with pytest.raises(ValueError):
        I.check_slot(I.Slot("x", 9, 9, ()))


def test_auto_incidents(spark):
    M = 60_000
    ev = spark.createDataFrame([("r", 0, "firing", "critical"), ("r", 5 * M, "resolved", "critical"), ("r", 6 * M, "inactive", "critical"),
                                ("r", 10 * M, "firing", "critical"), ("r", 20 * M, "resolved", "critical"), ("s", 0, "firing", "info"),
                                ("late", 58 * M, "firing", "x")], "rule string, ts_ms bigint, state string, severity string")
    got = {(r["rule"], r["created_ms"]): r["severity"] for r in I.auto_incidents(ev, 60 * M).collect()}
    assert got == {("r", 15 * M): "critical", ("s", 5 * M): "minor"}


def test_incident_history(spark):
    cols = "incident_id string, ts_ms bigint, seq bigint, type string, author string, title string, status string, severity string, assigned_to string, message string"
    ev = spark.createDataFrame([
        ("1", 1, 0, "create", "system", "T", "", "major", "ana", ""), ("1", 2, 1, "update", "bo", "", "identified", "major", "", ""),
        ("1", 3, 2, "update", "bo", "", "", "", "bo", ""), ("1", 4, 3, "update", "bo", "", "", "major", "bo", ""),
        ("1", 5, 4, "comment", "bo", "", "", "", "", "hi"), ("2", 1, 0, "create", "x", "U", "", "minor", "", ""),
        ("2", 9, 1, "resolve", "x", "", "", "", "", "")], cols)
    cur = {r["incident_id"]: r for r in I.current_incidents(ev, 2).collect()}
    assert (cur["1"]["status"], cur["1"]["assigned_to"], cur["1"]["updated_ms"]) == ("identified", "bo", 5)
    assert (cur["2"]["status"], cur["2"]["resolved_ms"]) == ("resolved", 9)
    line = [(r["ts_ms"], r["type"]) for r in I.timeline(ev, 2).filter("incident_id = '1'").orderBy("ts_ms", "part").collect()]
    assert line == [(1, "created"), (1, "assigned"), (2, "updated"), (3, "assigned"), (3, "updated"), (5, "comment")]
