"""No fixed limits on results or configuration, and values at the edges of number and text formats."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from obsframe.functions import labels as L
from obsframe.functions.text import plain_number
from obsframe.operators import alerts as A, incidents as I, logs as LOG, retention as RET, rules as R, stats as ST
from obsframe.sources import sinks
from obsframe.streaming import pipelines as P


@pytest.fixture
def logs(spark):
    return spark.range(12_000).select(
        F.col("id").alias("ts_ms"), F.col("id").alias("seq"), F.lit("error").alias("level"), F.lit("s").alias("source"),
        F.lit("text").alias("message"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"))


def test_lists_are_whole_unless_limited(spark, logs):
    assert sinks.logs_export(logs, 20_000).count() == 12_000
    assert sinks.logs_export(logs, 20_000, limit=7).count() == 7
    assert LOG.search(logs, "text").count() == 12_000
    changes = spark.range(700).selectExpr("concat('m', id) AS metric", "id AS ts_ms")
    assert ST.distinct_changes(changes).count() == 700 and ST.distinct_changes(changes, 3).count() == 3


def test_a_failing_search_is_not_an_empty_one(spark, logs):
    assert LOG.search(logs, "/(unclosed/").count() == 0
    with pytest.raises(Exception):
        LOG.valid_pattern(None, "x")


def test_more_than_a_thousand_channels_and_slots(spark):
    rows = spark.createDataFrame([(1, "s5"), (2, "other")], "id int, severity string")
    channels = [A.Channel(f"c{i}", "web", (f"s{i % 100}", "x")) for i in range(2000)] + [A.Channel("all", "mail")]
    got = A.route(rows, channels)
    assert got.columns == ["id", "severity", "channel", "channel_type"]
    assert got.filter("id = 1").count() == 21 and [r["channel"] for r in got.filter("id = 2").collect()] == ["all"]
    slots = [I.Slot(f"u{i}", i % 24, i % 24 + 1, ("Mon", "tue")) for i in range(3000)]
    at = spark.createDataFrame([(1_700_000_000_000,), (1_700_100_000_000,)], "t bigint")  # Tuesday 22:13, Thursday
    first, second = I.assign_on_call(at, "t", slots).orderBy("t").collect()
    assert (first["on_call"], first["until_ms"], second["on_call"]) == ("u22", 1_700_002_800_000, "")


def test_many_policies(spark, points):
    policies = [RET.Policy(f"p{i}", f"^m{i}$", 10) for i in range(1100)]
    m = points([("m1099", {}, 1000, 1.0), ("m1099", {}, 90_000, 2.0), ("free", {}, 1000, 3.0)])
    assert sorted(r["value"] for r in RET.enforce(m, policies, 100_000).collect()) == [2.0, 3.0]


@pytest.mark.parametrize("value", [1.2345678901234568e-10, 3e-20, 1.5e21, 123456789.125, -0.5, 1e7, 1e-3, 0.1, 1.7976931348623157e308, 100.0, 0.0, -2.5e-7])
def test_numbers_in_text_are_exact(spark, value):
    text = spark.range(1).select(plain_number(F.lit(value))).first()[0]
    assert "e" not in text.lower() and float(text) == value and Decimal(text) == Decimal(repr(value))
    assert text == "0" or not text.endswith("."), text


def test_label_sets_do_not_share_keys(spark):
    sets = [{"a": "1\nb=2"}, {"a": "1", "b": "2"}, {"a=1\nb": "2"}, {"a": "1\\nb=2"}, {"a": "1\\", "b": "2"}, {}]
    keys = spark.createDataFrame([(s,) for s in sets], "labels map<string,string>").select(L.labels_key("labels")).collect()
    assert len({k[0] for k in keys}) == len(sets)


def test_nan_never_wins_a_rule(spark, points):
    m = points([("m", {}, 1000, float("nan")), ("m", {}, 2000, 3.0), ("m", {}, 3000, 1.0)])
    rules = [R.RecordingRule("m", "hi", "max"), R.RecordingRule("m", "lo", "min")]
    assert {r["name"]: r["value"] for r in R.record(m, rules, 4000).collect()} == {"hi": 3.0, "lo": 1.0}


def test_a_retried_batch_replaces_itself(spark, points, tmp_path):
    m = points([("m", {}, i * 1000, float(i % 5)) for i in range(50)])
    write = P.anomaly_batches(f"{tmp_path}/table", f"{tmp_path}/out", 20_000)
    for batch_id in (0, 0, 1):
        write(m, batch_id)
    assert sinks.read_metrics(spark, f"{tmp_path}/table").count() == 100


def test_anomalies_around_a_nan(spark, points):
    """One NaN silences the windows that hold it and no others."""
    clean = [("m", {}, 100 * i, 10.0 + i % 3) for i in range(400)]
    clean[150] = ("m", {}, 15_000, 900.0)
    clean[350] = ("m", {}, 35_000, 900.0)
    broken = list(clean)
    broken[145] = ("m", {}, 14_500, float("nan"))

    def events(rows):
        found = ST.anomalies_backfill(points(rows), 1000).filter("severity = 'high' OR score > 5").collect()
        return sorted(r["ts_ms"] for r in found)
    assert {15_000, 35_000} <= set(events(clean))
    got = events(broken)
    assert 35_000 in got and set(got) <= set(events(clean)) and not [t for t in got if 14_500 <= t <= 15_500]
