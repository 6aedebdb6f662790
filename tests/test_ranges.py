import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from obsframe.functions import labels as L, scalars as S
from obsframe.operators import ranges as R, select as SEL, vectors as V

NOW = 1_000_000


def values(df):
    return {r["labels_key"]: r["value"] for r in df.collect()}


@pytest.fixture
def cpu(points):
    rows = [("cpu", {"host": "a"}, NOW - 1000 * i, v) for i, v in enumerate([10, 20, 30, 40])]
    rows += [("cpu", {"host": "b", "zone": "x"}, NOW - 1000 * i, v) for i, v in enumerate([1, 2, 3])]
    rows += [("cpu", {"host": "a"}, NOW - 300_000, 100), ("cpu", {"host": "a"}, NOW - 300_001, 999)]
    rows += [("mem", {"host": "a"}, NOW, 5), ("mem", {"host": "b", "zone": "x"}, NOW, 4), ("one", {"z": "z"}, NOW, 2)]
    return points(rows)


def test_functions_and_inclusive_range(cpu):
    a, b = "host=a\n", "host=b\nzone=x\n"
    run = lambda f: values(R.range_agg(cpu, "cpu", f, "5m", NOW))
    assert run("avg") == {a: 40.0, b: 2.0}
    assert run("max") == {a: 100.0, b: 3.0} and run("min") == {a: 10.0, b: 1.0}
    assert run("sum") == {a: 200.0, b: 6.0} and run("count") == {a: 5.0, b: 3.0}
    assert run("last") == {a: 10.0, b: 1.0}
    assert run("rate") == {a: (10 - 100) / 300, b: (1 - 3) / 300}
    assert run("p50") == {a: 30.0, b: 2.0}
    assert run("p95")[a] == pytest.approx(88.0)
    with pytest.raises(ValueError):
        run("median")


def test_rate_needs_two_points_and_ties_use_arrival(points):
    m = points([("x", {}, NOW, 1), ("y", {}, NOW, 1), ("y", {}, NOW, 4)])
    assert values(R.range_agg(m, "x", "rate", "1m", NOW)) == {}
    assert values(R.range_agg(m, "y", "rate", "1m", NOW)) == {"": 3 / 60}
    assert values(R.range_agg(m, "y", "last", "1m", NOW)) == {"": 4.0}


def test_nan_never_wins(points):
    m = points([("x", {}, NOW, math.nan), ("x", {}, NOW - 1, 3), ("x", {}, NOW - 2, 1), ("n", {}, NOW, math.nan)])
    assert values(R.range_agg(m, "x", "max", "1m", NOW)) == {"": 3.0}
    assert values(R.range_agg(m, "x", "min", "1m", NOW)) == {"": 1.0}
    assert values(R.range_agg(m, "n", "max", "1m", NOW)) == {"": -math.inf}


def test_grouping_is_a_mean_of_means(points):
    m = points([("c", {"h": "a", "i": "1"}, NOW, 1), ("c", {"h": "a", "i": "1"}, NOW, 3), ("c", {"h": "a", "i": "2"}, NOW, 10),
                ("c", {"i": "3"}, NOW, 7)])
    run = lambda f: values(R.group_agg(m, "c", f, ["h"], "1m", NOW))
    assert run("avg") == {"h=a\n": 6.0, "h=\n": 7.0}
    assert run("count") == {"h=a\n": 2.0, "h=\n": 1.0}
    assert run("last")["h=a\n"] == 10.0
    assert values(R.group_agg(m, "c", "sum", [], "1m", NOW)) == {"": 21.0}


def test_instant_has_no_lower_bound(cpu):
    assert values(R.instant(cpu, "mem")) == {"host=a\n": 5.0, "host=b\nzone=x\n": 4.0}
    got = R.latest(cpu, "cpu", 2).filter("labels_key = 'host=a\n'").orderBy("rank").collect()
    assert [r["value"] for r in got] == [10.0, 20.0]


def test_matchers(cpu):
    assert values(R.range_agg(cpu, SEL.metric("cpu", host="a"), "count", "5m", NOW)) == {"host=a\n": 5.0}
    assert values(R.range_agg(cpu, SEL.metric("cpu", zone=""), "count", "5m", NOW)) == {"host=a\n": 5.0}
    assert values(R.range_agg(cpu, SEL.metric("cpu", host="none"), "count", "5m", NOW)) == {}


def test_vector_arithmetic(cpu, points):
    cpu_v, mem, one = (R.range_agg(cpu, n, "avg", "5m", NOW) for n in ("cpu", "mem", "one"))
    assert values(V.arith("/", cpu_v, mem)) == {"host=a\n": 8.0, "host=b\nzone=x\n": 0.5}
    assert values(V.arith("+", cpu_v, one)) == {"host=a\n": 42.0, "host=b\nzone=x\n": 4.0}
    assert values(V.arith("+", one, cpu_v)) == {}
    assert values(V.arith("-", 100, cpu_v))["host=a\n"] == 60.0
    assert values(V.arith("*", cpu_v, R.scalar(one)))["host=a\n"] == 80.0


def test_division_by_zero(cpu, points):
    zero = R.range_agg(points([("z", {"z": "z"}, NOW, 0)]), "z", "avg", "5m", NOW)
    mem = R.range_agg(cpu, "mem", "avg", "5m", NOW)
    with pytest.raises(PySparkException):
        V.arith("/", mem, zero).collect()
    assert set(values(V.arith("/", mem, zero, on_zero="null")).values()) == {None}


def test_comparisons_with_nan(spark):
    row = spark.range(1).select(*[S.compare(op, F.lit(float("nan")), F.lit(1.0)).alias(op) for op in S.COMPARISONS],
                                S.compare("~", F.lit(1.0), F.lit(1.0)).alias("bad")).first()
    assert row.asDict() == {">": False, ">=": False, "<": False, "<=": False, "==": False, "!=": True, "bad": False}


def test_label_functions(spark):
    m = F.create_map(F.lit("b"), F.lit('x"y\n'), F.lit("a"), F.lit("1"))
    none = F.create_map().cast("map<string,string>")
    r = spark.range(1).select(
        L.labels_text(m).alias("t"), L.labels_key(none).alias("e"), L.series_id(F.lit("n"), none).alias("id"),
        L.prometheus_labels(m).alias("p"), L.prometheus_labels(none).alias("pe"), L.subset(m, ["a", "z"]).alias("s"),
        L.display_name(F.lit("n"), none).alias("d")).first()
    assert r["t"] == 'a=1,b=x"y\n' and r["e"] == "" and r["id"] == __import__("hashlib").md5(b"n{}").hexdigest()
    assert r["p"] == '{a="1",b="x\\"y\\n"}' and r["pe"] == "" and r["s"] == {"a": "1"} and r["d"] == "n"


def test_scalar_functions(spark):
    assert S.duration_ms("5m") == 300_000 and S.duration_ms("1h30m") == 5_400_000 and S.duration_ms("1d") == 86_400_000
    assert S.duration_ms("abc") == 0 and S.duration_ms("") == 0 and S.duration_ms("0") == 0
    r = spark.range(1).select(
        S.duration_ms_column(F.lit("1h30m")).alias("a"), S.duration_ms_column(F.lit("nope")).alias("b"),
        S.round_to(F.lit(2.5), 0).alias("c"), S.round_to(F.lit(-2.5), 0).alias("d"), S.time_bucket(F.lit(-61_000), 60_000).alias("e"),
        S.iso_millis(F.lit("1970-01-01T00:00:01.500Z")).alias("f"), S.iso_millis(F.lit("x")).alias("g"),
        S.alert_message(F.lit("avg(x)"), F.lit(1.0), F.lit(">"), F.lit(0.5)).alias("m")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"]) == (5_400_000, 0, 3.0, -3.0, -60_000, 1500, None)
    assert r["m"].startswith("avg(x) ") and "1.0000" in r["m"] and "0.5000" in r["m"]
