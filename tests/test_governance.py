import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.operators import governance as G, reliability as R


def test_quota_against_fold_with_a_hot_minute(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"resource": rng.choice(["a", "b", "free"], n, p=[0.7, 0.2, 0.1]), "ts_ms": rng.integers(0, 180_000, n),
                        "seq": np.arange(n), "delta": rng.integers(0, 60, n)})
    pdf.loc[pdf.index % 2 == 0, "ts_ms"] = 5
    limits = {"a": 50, "b": 997}
    got = G.quota_admit(spark.createDataFrame(pdf), limits).toPandas().set_index("seq")["admitted"].sort_index()
    used, want = {}, {}
    for r in pdf.sort_values(["ts_ms", "seq"]).itertuples():
        key, limit = (r.resource, r.ts_ms // 60_000), limits.get(r.resource, 0)
        ok = limit == 0 or used.get(key, 0) + r.delta <= limit
        used[key] = used.get(key, 0) + (r.delta if ok else 0)
        want[r.seq] = ok
    assert got.to_dict() == want


@pytest.mark.parametrize("capacity, rate, tick, spread", [(200, 100, 1, 20_000), (5, 3, 1, 4_000), (3, 0.5, 100, 60_000), (1000, 333, 1, 3_000), (50, 0.1, 1, 9_000)])
def test_rate_limit_against_fold_with_a_hot_key(spark, capacity, rate, tick, spread):
    rng = np.random.default_rng(4)
    n = 4000
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.8, "", rng.choice(["x", "y"], n)),
                        "ts_ms": np.sort(rng.integers(0, spread, n)), "seq": np.arange(n)})
    out = G.rate_limit(spark.createDataFrame(pdf), capacity, rate, tick_ms=tick, chunk_ticks=max(1, spread // tick // 7))
    got = out.toPandas().set_index("seq").sort_index()
    b, state = G.Bucket.of(capacity, rate, tick), {}
    for r in pdf.itertuples():
        units, last = state.get(r.key, (b.full, r.ts_ms // tick))
        units = min(b.full, units + b.refill * (r.ts_ms // tick - last))
        ok = units >= b.token
        units -= b.token if ok else 0
        state[r.key] = (units, r.ts_ms // tick)
        assert bool(got.loc[r.seq, "allowed"]) == ok and got.loc[r.seq, "remaining"] == units // b.token
    assert set(got["key"]) == {"anonymous", "x", "y"}


def test_audit_rows(spark):
    rows = [("POST", "/api/v1/incidents/7/resolve", 200, "1.1.1.1, 2.2.2.2", "x:1"), ("GET", "/a", 200, "", "x:1"),
            ("DELETE", "/api/v1/auth/keys/k/", 403, "", "[::1]:80"), ("PATCH", "/start", 401, "", "10.0.0.1:99"), ("PUT", "/x/y", 200, "", "raw")]
    df = spark.createDataFrame([(i, i, "", *r) for i, r in enumerate(rows)],
                               "ts_ms bigint, seq bigint, user string, method string, path string, status_code int, forwarded_for string, remote string")
    got = [tuple(r)[3:6] + (r["ip_address"], r["status"]) for r in G.audit(df).orderBy("seq").collect()]
    assert got == [("create", "incident", "7", "1.1.1.1", "success"), ("delete", "api_key", "k", "::1", "denied"),
                   ("update", "generic", "start", "10.0.0.1", "denied"), ("update", "generic", "y", "raw", "success")]
    assert G.audit_list(G.audit(df), action="update", limit=1).first()["seq"] == 4


def test_roles(spark):
    cases = [("admin", "DELETE", "/api/v1/tenants", True), ("operator", "GET", "/api/v1/audit", False), ("operator", "POST", "/api/v1/alerts", True),
             ("viewer", "POST", "/api/v1/alerts", False), ("viewer", "HEAD", "/api/v1/alerts", True), ("operator", "GET", "/api/v1/admin", True)]
    df = spark.createDataFrame(cases, "role string, method string, path string, want boolean")
    assert df.filter(G.allowed(F.col("role"), F.col("method"), F.col("path")) != F.col("want")).count() == 0


def test_tenants(spark):
    t = [G.Tenant("default"), G.Tenant("a", "a_", "ab"), G.Tenant("b", "b_", "abc")]
    got = spark.createDataFrame([("abcd",), ("abx",), ("z",)], "k string").select(G.tenant_by_key(F.col("k"), t).alias("t"))
    assert [r["t"] for r in got.collect()] == ["b", "a", "default"]
    names = spark.createDataFrame([("x", "a_"), ("a_x", "a_"), ("x", "")], "n string, p string")
    assert [r[0] for r in names.select(G.prefixed(F.col("n"), F.col("p"))).collect()] == ["a_x", "a_x", "x"]
    tf = spark.createDataFrame([("default", "d_"), ("a", "a_")], "id string, metric_prefix string")
    rows = spark.createDataFrame([("a",), ("",), ("gone",)], "tenant_id string")
    assert {(r["tenant_id"], r["tenant"], r["metric_prefix"]) for r in G.tenant_by_id(rows, tf).collect()} == {
        ("a", "a", "a_"), ("", "default", "d_"), ("gone", "default", "d_")}


def test_tags(spark):
    tags = spark.createDataFrame([("1", "env", "prod"), ("2", "team", "core"), ("3", "env", "dev")], "id string, key string, value string")
    att = spark.createDataFrame([("rule", "r", "2"), ("rule", "r", "1"), ("rule", "r", "1"), ("probe", "p", "3")],
                                "resource_type string, resource_id string, tag_id string")
    for q, n in (("env:prod", 2), ("core", 2), ("env", 3), ("", 0), ("nope", 0)):
        assert G.search_by_tag(att, tags, q).count() == n
    assert [r["value"] for r in G.tags_for_resource(att, tags, "rule", "r").collect()] == ["prod", "core"]


def test_agents_and_status(spark):
    hb = spark.createDataFrame([("a", 1000, 0, "h1"), ("a", 5000, 1, "h2"), ("b", 40_000, 2, "h3")], "agent string, ts_ms bigint, seq bigint, host string")
    got = {r["agent"]: r for r in G.agents(hb, 40_000).collect()}
    assert (got["a"]["host"], got["a"]["registered_ms"], got["a"]["status"], got["b"]["status"]) == ("h2", 1000, "offline", "online")
    probe = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [R.overall_probe_status(probe(*s)).first()[0] for s in (("up", "up"), ("up", "down"), ("down",))] == ["operational", "degraded", "down"]
    assert R.overall_probe_status(probe("up").limit(0)).first()[0] == "operational"
    assert R.worst_check(probe("healthy", "degraded")).first()[0] == "degraded"


def test_objectives(spark):
    o = R.objectives_frame(spark, [R.Objective("x", 99, "1d"), R.Objective("none", 99, "?")])
    v = spark.createDataFrame([("x", 150.0)], "name string, value double")
    got = {r["name"]: r for r in R.objective_status(o, v).collect()}
    assert got["x"]["current_sli"] == 100 and got["x"]["healthy"] and got["x"]["budget_remaining_pct"] == 100
    assert got["none"]["current_sli"] == 0 and got["none"]["window"] == "30d" and got["none"]["budget_remaining_pct"] == 0
    with pytest.raises(ValueError):
        R.objectives_frame(spark, [R.Objective("x", 100)])


def test_replay(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate([1000, 3001, 3001, 2000, 4000])], "recording string, seq bigint, ts_ms bigint")
    got = [(r["delay_ms"], r["replay_at_ms"]) for r in R.replay_schedule(df, "2x", slices=3).orderBy("seq").collect()]
    assert got == [(0, 0), (1000, 1000), (0, 1000), (0, 1000), (1000, 2000)]
    assert R.parse_speed("") == 1 and R.parse_speed(" 0.5X ") == 0.5
    for bad in ("0x", "-1", "fast", "nan"):
        with pytest.raises(ValueError):
            R.parse_speed(bad)
