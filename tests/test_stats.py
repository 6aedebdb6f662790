import numpy as np
import pytest

from obsframe.operators import rules as RULES, retention as RET, stats as ST

NOW = 10_000_000_000
MIN = 60_000


def series(name, values, labels=(), step=MIN, end=NOW):
    n = len(values)
    return [(name, dict(labels), end - (n - 1 - i) * step, v) for i, v in enumerate(values)]


def test_regression_and_forecast(points):
    m = points(series("up", [10 + 0.1 * i for i in range(20)]) + series("flat", [5.0] * 6) + series("few", [1, 2, 3, 4])
               + [("still", {}, NOW, v) for v in range(5)])
    r = {x["name"]: x for x in ST.regressions(m, NOW).collect()}
    assert set(r) == {"up", "flat", "still"}
    assert r["up"]["slope"] == pytest.approx(0.1 / 60) and r["up"]["r2"] == pytest.approx(1)
    assert r["flat"]["slope"] == pytest.approx(0) and r["flat"]["r2"] == 0
    assert r["still"]["slope"] == 0 and r["still"]["intercept"] == 2 and r["still"]["r2"] == 0
    f = {x["name"]: x for x in ST.forecast(m, NOW).collect()}
    assert f["up"]["predicted_1h"] == pytest.approx(17.9) and f["up"]["trend"] == "increasing"
    assert f["flat"]["trend"] == "stable"


def test_exhaustion_and_capacity(points):
    up = [50 + i for i in range(20)]
    m = points(series("cpu_usage_percent", up) + series("disk_usage_percent", [95 + i for i in range(6)]) + series("down", up[::-1]))
    e = {x["name"]: x for x in ST.exhaustion(m, 90, NOW).collect()}
    assert e["cpu_usage_percent"]["reachable"] and e["cpu_usage_percent"]["hours_until_full"] == pytest.approx(21 / 60, abs=0.01)
    assert e["disk_usage_percent"]["reachable"] and e["disk_usage_percent"]["hours_until_full"] == 0
    assert e["disk_usage_percent"]["exhausted_at_ms"] == NOW
    assert not e["down"]["reachable"] and e["down"]["exhausted_at_ms"] == 0
    c = {x["resource"]: x for x in ST.capacity_report(m, NOW).collect()}
    assert c["cpu"]["health"] == "critical" and c["disk"]["health"] == "critical"
    assert c["memory"]["health"] == "healthy" and c["memory"]["peak"] == 0 and c["memory"]["trend"] == ""
    assert c["cpu"]["peak"] == 69 and c["cpu"]["current_avg"] == 59.5


def test_compare_edges(points):
    m = points([("a", {}, NOW, 10), ("a", {}, NOW - 5 * MIN, 20), ("a", {}, NOW - 8 * MIN, 30), ("new", {}, NOW, 1),
                ("z", {}, NOW, 5), ("z", {}, NOW - 6 * MIN, 0)])
    r = {x["metric"]: x for x in ST.compare_report(m, 5 * MIN, 5 * MIN, NOW).collect()}
    assert set(r) == {"a", "z"}
    assert (r["a"]["current_avg"], r["a"]["previous_avg"], r["a"]["direction"]) == (15, 25, "down")
    assert r["a"]["change_percent"] == -40 and r["z"]["change_percent"] == 100
    left = ST.compare_windows(m, 5 * MIN, 5 * MIN, NOW, "a", edge="left").first()
    assert left["previous_avg"] == 30


@pytest.mark.parametrize("ys, r, label", [([1, 2, 3, 4], 1, "strong_positive"), ([4, 3, 2, 1], -1, "strong_negative"),
                                          ([5, 5, 5, 5], 0, "none")])
def test_correlation(points, ys, r, label):
    m = points(series("a", [1, 2, 3, 4]) + series("b", ys) + series("c", [1, 2], end=NOW - 60 * MIN))
    got = ST.correlate(m, "a", "b", 30 * MIN, NOW).first()
    assert got["coefficient"] == pytest.approx(r) and got["interpretation"] == label and got["sample_count"] == 4
    none = ST.correlate(m, "a", "c", 30 * MIN, NOW).first()
    assert none["sample_count"] == 0 and none["coefficient"] == 0
    auto = ST.auto_correlate(m, "a", 30 * MIN, NOW).collect()
    assert [x["metric"] for x in auto] == ["b"]


def test_latest_anomaly(points):
    noisy = [10, 11, 10, 9, 10, 11, 9, 10]
    m = points(series("spike", noisy + [50]) + series("calm", noisy + [10]) + series("flat", [7.0] * 9 + [80])
               + series("short", [1, 2, 3, 99]))
    got = ST.anomalies_latest(m, NOW).collect()
    assert [(x["name"], x["severity"], x["value"]) for x in got] == [("spike", "high", 50.0)]


def test_backfill_against_brute_force(points):
    rng = np.random.default_rng(3)
    ts = np.sort(rng.integers(NOW - 4 * 30 * MIN, NOW, 400))
    v = np.round(rng.normal(100, 5, 400), 2)
    v[::37] += 40
    v[100:160] = 12.5
    v[160] = 13.0
    rows = [("m", {"h": "a"}, int(t), float(x)) for t, x in zip(ts, v)] + [("m", {"h": "a"}, int(ts[200]), 500.0)]
    got = {x["ts_ms"]: x["score"] for x in ST.anomalies_backfill(points(rows)).collect()}
    t, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    want = {}
    for now in np.unique(t):
        base = x[(t >= now - 30 * MIN) & (t < now)]
        value = x[t == now][-1]
        if len(base) >= 4 and base.std() >= 1e-10 and abs(value - base.mean()) / base.std() >= 3:
            want[int(now)] = abs(value - base.mean()) / base.std()
    assert set(got) == set(want) and len(want) > 3
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_backfill_skips_flat_baselines(points):
    rows = series("m", [50.0, 90.0, 10.0], end=NOW - 70 * MIN) + series("m", [0.1] * 20 + [0.1000001])
    assert ST.anomalies_backfill(points(rows)).count() == 0


def test_backfill_holds_one_sort_in_a_stage(points):
    """Sorts of one stage hold its rows at the same time: there were two, with a copy of each row for the next bucket."""
    found = ST.anomalies_backfill(points(series("m", [10.0, 11.0] * 9)))
    stages = found._jdf.queryExecution().executedPlan().toString().split("Exchange ")
    assert max(s.count("Sort [") for s in stages) == 1


def test_backfill_across_a_bucket_edge(points):
    """The trailing range is a tail of one bucket and a head of the next; both alone are flat, together they are not."""
    edge = NOW // (30 * MIN) * 30 * MIN
    rows = [("m", {}, edge - 10 * MIN + i * MIN, v) for i, v in enumerate([10.0] * 10 + [12.0] * 10 + [40.0])]
    got = ST.anomalies_backfill(points(rows)).collect()
    assert [(r["ts_ms"] - edge, r["expected"], r["score"]) for r in got][-1] == (
        10 * MIN, pytest.approx(11.0), pytest.approx(29.0))


def test_change_point(points):
    m = points(series("step", [10.0, 11.0] * 6 + [50.0, 51.0] * 6) + series("noise", [1.0, 2.0] * 12) + series("few", [1.0] * 5 + [9.0] * 5))
    got = ST.change_points(m, NOW, slices=3).collect()
    assert [(x["metric"], x["before_mean"], x["after_mean"]) for x in got] == [("step", 10.5, 50.5)]
    assert got[0]["ts_ms"] == NOW - 11 * MIN
    assert ST.distinct_changes(ST.change_points(m, NOW).union(ST.change_points(m, NOW))).count() == 1


def test_recording_rules(points):
    m = points(series("in", [1, 2, 3, 4], {"h": "a", "x": "1"}, step=1000) + series("in", [10], {"h": "b"}) + series("in", [7], {"x": "2"}))
    rules = [RULES.RecordingRule("in", f"out:{a}", a, "5m", ("h",)) for a in ("avg", "sum", "max", "min", "count", "p50", "p99")]
    got = {(r["name"], tuple(r["labels"].items())): r["value"] for r in RULES.record(m, rules, NOW).collect()}
    a = (("h", "a"),)
    assert got["out:avg", a] == 2.5 and got["out:sum", a] == 10 and got["out:max", a] == 4 and got["out:min", a] == 1
    assert got["out:count", a] == 4 and got["out:p50", a] == 2.5 and got["out:p99", a] == pytest.approx(3.97)
    assert got["out:sum", ()] == 7 and got["out:sum", (("h", "b"),)] == 10
    with pytest.raises(ValueError):
        RULES.record(m, [RULES.RecordingRule("in", "o", "p90")], NOW)
    with pytest.raises(ValueError):
        RULES.record(m, [RULES.RecordingRule("in", "o", "avg", "2m")], NOW)


def test_downsample(points):
    end = NOW - NOW % MIN + 30_000
    m = points([("a", {}, end - 90_000, 1), ("a", {}, end - 80_000, 3), ("a", {}, end - 1000, 100), ("a:1m", {}, end - 90_000, 5),
                ("a", {}, end - 3_700_000, 9)])
    got = RULES.downsample(m, ":1m", end).collect()
    assert [(r["name"], r["value"], r["ts_ms"] % MIN) for r in got] == [("a:1m", 2.0, 0)]
    again = RULES.downsample(m, ":1m", end, written=RULES.downsample(m, ":1m", end))
    assert again.count() == 0


def test_retention(points):
    m = points([("raw", {}, NOW - 3_600_000, 1), ("raw", {}, NOW - 3_600_001, 2), ("x:1m", {}, NOW - 86_400_001, 3),
                ("x:1m", {}, NOW - 7_200_000, 4), ("odd:name", {}, 0, 5)])
    kept = RET.enforce(m, RET.BUILTIN_POLICIES, NOW)
    assert sorted(r["value"] for r in kept.collect()) == [1, 4, 5]
    custom = (RET.Policy("keep", "^raw$", max_points=1),) + RET.BUILTIN_POLICIES
    assert sorted(r["value"] for r in RET.enforce(m, custom, NOW).collect()) == [1, 4, 5]
    rest, gone = RET.delete_series(m, "raw")
    assert rest.count() == 3 and gone.first()["deleted"] == 1
