"""Statistics over series: comparison, regression, forecast, correlation, anomalies, change points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from obsframe.functions import labels as L, scalars as S
from obsframe.operators.ordered import running_totals
from obsframe.operators.ranges import arrival
from obsframe.operators.select import scan

# Windows, thresholds and limits of the statistics.
FORECAST_WINDOW_MS = 1_800_000
FORECAST_MIN_POINTS = 5
TREND_PER_HOUR = 0.02
EXHAUSTION_THRESHOLD = 90.0
CAPACITY_METRICS = {"cpu_usage_percent": "cpu", "memory_usage_percent": "memory", "disk_usage_percent": "disk"}
STABLE_PERCENT = 0.5
CORRELATION_BUCKET_MS = 60_000
CORRELATION_MIN_PAIRS = 3
CORRELATION_TOP = 5
BASELINE_MS = 1_800_000
ANOMALY_MIN_POINTS = 5
ANOMALY_Z = 3.0
CHANGE_LOOKBACK_MS = 1_800_000
CHANGE_MIN_POINTS = 12
CHANGE_SIGNIFICANCE = 1.5


# ---- window comparison -------------------------------------------------------------------------

def percent_change(previous: Column, current: Column) -> Column:
    return (F.when((F.abs(previous) < 1e-9) & (F.abs(current) < 1e-9), 0.0)
            .when(F.abs(previous) < 1e-9, 100.0)
            .otherwise((current - previous) / F.abs(previous) * 100.0))


def compare_windows(metrics: DataFrame, current_ms: int, previous_ms: int, as_of: int,
                    name: str | None = None, edge: str = "both") -> DataFrame:
    """Mean of the current window against the one before it, per metric.

    A point exactly on the shared edge counts in both windows (`edge="both"`) or only
    in the current one (`edge="left"`). Metrics without data in either window are left out.
    """
    start = as_of - current_ms
    ts = F.col("ts_ms")
    in_previous = ts <= start if edge == "both" else ts < start
    points = scan(metrics, name, start - previous_ms, as_of)
    out = points.groupBy("name").agg(
        F.avg(F.when(ts >= start, F.col("value"))).alias("_cur"),
        F.avg(F.when(in_previous, F.col("value"))).alias("_prev"))
    out = out.filter(F.col("_cur").isNotNull() & F.col("_prev").isNotNull())
    change = percent_change(F.col("_prev"), F.col("_cur"))
    return out.select(
        F.col("name").alias("metric"), S.round_to(F.col("_cur"), 4).alias("current_avg"),
        S.round_to(F.col("_prev"), 4).alias("previous_avg"), S.round_to(change, 4).alias("change_percent"),
        F.when(change > STABLE_PERCENT, "up").when(change < -STABLE_PERCENT, "down").otherwise("stable")
        .alias("direction"))


def compare_report(metrics: DataFrame, current_ms: int, previous_ms: int, as_of: int) -> DataFrame:
    return compare_windows(metrics, current_ms, previous_ms, as_of).orderBy("metric")


# ---- regression and forecast -------------------------------------------------------------------

def regressions(metrics: DataFrame, as_of: int, window_ms: int = FORECAST_WINDOW_MS,
                min_points: int = FORECAST_MIN_POINTS, names: list[str] | None = None) -> DataFrame:
    """Least squares of value on seconds since the first point, for every series in one pass."""
    start = as_of - window_ms
    points = scan(metrics, None, start, as_of)
    if names is not None:
        points = points.filter(F.col("name").isin(*names))
    x = (F.col("ts_ms") - F.lit(start)) / F.lit(1000.0)
    y = F.col("value")
    s = points.groupBy("name", "labels").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("last_ms"),
        F.max_by("value", arrival()).alias("current"), F.max(F.when(~F.isnan(y), y)).alias("peak"),
        F.avg(x).alias("_mx"), F.avg(y).alias("mean"), F.covar_pop(x, y).alias("_cov"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    s = s.filter(F.col("n") >= min_points)
    n = F.col("n")
    flat_x = n * n * F.col("_vx") < 1e-10
    slope = F.when(flat_x, 0.0).otherwise(F.try_divide(F.col("_cov"), F.col("_vx")))
    r2 = F.when(flat_x | (n * F.col("_vy") <= 1e-10), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("_cov") * F.col("_cov"),
                                                               F.col("_vx") * F.col("_vy")))))
    s = s.withColumn("slope", slope).withColumn("r2", r2)
    first_x = (F.col("t0") - F.lit(start)) / 1000.0
    intercept = F.when(flat_x, F.col("mean")).otherwise(F.col("mean") - F.col("slope") * (F.col("_mx") - first_x))
    return s.select("name", "labels", "n", "t0", "last_ms", "current", "mean", "peak", "slope",
                    intercept.alias("intercept"), "r2")


def _value_at(seconds_ahead: float) -> Column:
    last_x = (F.col("last_ms") - F.col("t0")) / 1000.0
    return F.col("slope") * (last_x + F.lit(float(seconds_ahead))) + F.col("intercept")


def _trend() -> Column:
    current = F.when(F.abs("current") < 1e-10, F.lit(None)).otherwise(F.col("current"))
    near_zero = F.abs("current") < 1e-10
    slope = F.col("slope")
    relative = F.try_divide(slope * 3600, F.abs(current))
    up = (near_zero & (slope > 1e-10)) | F.coalesce(relative > TREND_PER_HOUR, F.lit(False))
    down = (near_zero & (slope < -1e-10)) | F.coalesce(relative < -TREND_PER_HOUR, F.lit(False))
    return F.when(up, "increasing").when(down, "decreasing").otherwise("stable")


def forecast(metrics: DataFrame, as_of: int, window_ms: int = FORECAST_WINDOW_MS,
             names: list[str] | None = None) -> DataFrame:
    """Value in 1 hour, 24 hours and 7 days, trend and confidence, for every series with enough points."""
    r = regressions(metrics, as_of, window_ms, names=names)
    return r.select(
        "name", "labels", S.round_to(F.col("current"), 4).alias("current_value"),
        S.round_to(_value_at(3600), 4).alias("predicted_1h"), S.round_to(_value_at(86400), 4).alias("predicted_24h"),
        S.round_to(_value_at(7 * 86400), 4).alias("predicted_7d"), _trend().alias("trend"),
        S.round_to(F.col("r2"), 4).alias("confidence"))


def _exhaustion_columns(r: DataFrame, threshold: float) -> DataFrame:
    rising = F.col("slope") > 0
    cross_x = F.when(rising, F.try_divide(F.lit(float(threshold)) - F.col("intercept"), F.col("slope")))
    left = cross_x - (F.col("last_ms") - F.col("t0")) / 1000.0
    ahead = rising & (left > 0)
    return (r.withColumn("reachable", rising)
            .withColumn("hours_until_full", F.when(ahead, S.round_to(left / 3600, 2)).otherwise(0.0))
            .withColumn("days_until_full", F.when(ahead, S.round_to(left / 86400, 2)).otherwise(0.0))
            .withColumn("exhausted_at_ms", F.when(ahead, F.col("t0") + F.floor(cross_x * 1000).cast("long"))
                        .when(rising, F.col("last_ms")).otherwise(F.lit(0).cast("long"))))


def exhaustion(metrics: DataFrame, threshold: float, as_of: int, window_ms: int = FORECAST_WINDOW_MS,
               names: list[str] | None = None) -> DataFrame:
    """When a rising series meets the threshold; a flat or falling one is unreachable."""
    r = _exhaustion_columns(regressions(metrics, as_of, window_ms, names=names), threshold)
    return r.select("name", "labels", S.round_to(F.col("current"), 4).alias("current_value"),
                    F.lit(float(threshold)).alias("threshold"), "reachable", "hours_until_full",
                    "days_until_full", "exhausted_at_ms")


def capacity_report(metrics: DataFrame, as_of: int, window_ms: int = FORECAST_WINDOW_MS,
                    resources: Mapping[str, str] = CAPACITY_METRICS,
                    threshold: float = EXHAUSTION_THRESHOLD) -> DataFrame:
    """Mean, peak, trend, growth and health per resource series; a resource without data is healthy."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(list(resources.items()), "name string, resource string")
    r = _exhaustion_columns(regressions(metrics, as_of, window_ms, names=list(resources)), threshold)
    r = r.select(
        "name", "labels", S.round_to(F.col("mean"), 2).alias("current_avg"),
        S.round_to(F.greatest(F.lit(0.0), F.col("peak")), 2).alias("peak"), _trend().alias("trend"),
        S.round_to(_value_at(86400), 4).alias("predicted_24h"),
        S.round_to(F.col("slope") * 86400, 4).alias("growth_per_day"), "days_until_full", "reachable")
    out = wanted.join(r, "name", "left")
    by_prediction = F.when(F.col("predicted_24h") >= 90, "critical").when(F.col("predicted_24h") >= 80, "warning")
    by_days = F.when(F.col("days_until_full") <= 7, "critical").when(F.col("days_until_full") <= 30, "warning")
    health = F.when((F.col("resource") == "disk") & F.col("reachable"), by_days).otherwise(by_prediction)
    zero = F.lit(0.0)
    return out.select(
        "name", "resource", "labels", *[F.coalesce(F.col(c), zero).alias(c) for c in ("current_avg", "peak")],
        F.coalesce("trend", F.lit("")).alias("trend"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("predicted_24h", "growth_per_day", "days_until_full")],
        F.coalesce(health, F.lit("healthy")).alias("health"))


# ---- correlation -------------------------------------------------------------------------------

def bucket_means(metrics: DataFrame, start_ms: int, end_ms: int, bucket_ms: int = CORRELATION_BUCKET_MS) -> DataFrame:
    """Mean per metric and time bucket over all its series."""
    return (scan(metrics, None, start_ms, end_ms)
            .groupBy("name", S.time_bucket(F.col("ts_ms"), bucket_ms).alias("bucket"))
            .agg(F.avg("value").alias("value")))


def aligned_buckets(metrics: DataFrame, a: str, b: str, start_ms: int, end_ms: int,
                    bucket_ms: int = CORRELATION_BUCKET_MS) -> DataFrame:
    """Buckets where both metrics have data, as (bucket, x, y): one aggregate instead of a join."""
    points = scan(metrics, None, start_ms, end_ms).filter(F.col("name").isin(a, b))
    mean = lambda name: F.avg(F.when(F.col("name") == name, F.col("value")))
    out = (points.groupBy(S.time_bucket(F.col("ts_ms"), bucket_ms).alias("bucket"))
           .agg(mean(a).alias("x"), mean(b).alias("y")))
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def _pearson() -> list[Column]:
    n = F.count(F.lit(1))
    return [n.alias("sample_count"), F.covar_pop("x", "y").alias("_cov"), F.var_pop("x").alias("_vx"),
            F.var_pop("y").alias("_vy")]


def _coefficient() -> Column:
    n = F.col("sample_count")
    spread = F.sqrt(F.col("_vx") * F.col("_vy")) * n
    r = F.try_divide(F.col("_cov") * n, spread)
    return F.when((n < 2) | (spread < 1e-10), 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def interpretation(r: Column) -> Column:
    strength = F.when(F.abs(r) >= 0.7, "strong_").when(F.abs(r) >= 0.3, "weak_")
    return F.coalesce(F.concat(strength, F.when(r > 0, "positive").otherwise("negative")), F.lit("none"))


def correlate(metrics: DataFrame, a: str, b: str, window_ms: int, as_of: int,
              bucket_ms: int = CORRELATION_BUCKET_MS) -> DataFrame:
    """Pearson coefficient of two metrics over aligned buckets."""
    out = aligned_buckets(metrics, a, b, as_of - window_ms, as_of, bucket_ms).agg(*_pearson())
    out = out.withColumn("coefficient", _coefficient())
    return out.select(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), "coefficient",
                      interpretation(F.col("coefficient")).alias("interpretation"), "sample_count")


def correlation_points(metrics: DataFrame, a: str, b: str, window_ms: int, as_of: int,
                       bucket_ms: int = CORRELATION_BUCKET_MS) -> DataFrame:
    """The scatter behind a correlation, rounded to 4 decimals."""
    out = aligned_buckets(metrics, a, b, as_of - window_ms, as_of, bucket_ms)
    return out.select("bucket", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def auto_correlate(metrics: DataFrame, source: str, window_ms: int, as_of: int,
                   bucket_ms: int = CORRELATION_BUCKET_MS, top: int = CORRELATION_TOP) -> DataFrame:
    """The metrics most correlated with one source, strongest first.

    Both sides of the join are already bucket means, so a bucket holds at most one
    row per metric whatever the raw volume.
    """
    means = bucket_means(metrics, as_of - window_ms, as_of, bucket_ms)
    mine = means.filter(F.col("name") == source).select("bucket", F.col("value").alias("x"))
    others = means.filter(F.col("name") != source).select("bucket", F.col("name").alias("metric"),
                                                          F.col("value").alias("y"))
    out = others.join(mine, "bucket").groupBy("metric").agg(*_pearson())
    out = out.filter(F.col("sample_count") >= CORRELATION_MIN_PAIRS).withColumn("coefficient", _coefficient())
    return (out.select("metric", "coefficient", interpretation(F.col("coefficient")).alias("interpretation"),
                       "sample_count")
            .orderBy(F.desc(F.abs("coefficient")), "metric").limit(top))


# ---- anomalies ---------------------------------------------------------------------------------

def severity(z: Column) -> Column:
    return F.when(z >= 5, "high").when(z >= 3.5, "medium").otherwise("low")


def keyed(metrics: DataFrame) -> DataFrame:
    if "labels_key" in metrics.columns:
        return metrics
    return metrics.withColumn("labels_key", L.labels_key("labels"))


def anomalies_latest(metrics: DataFrame, as_of: int, window_ms: int = BASELINE_MS,
                     min_points: int = ANOMALY_MIN_POINTS, z_limit: float = ANOMALY_Z) -> DataFrame:
    """The newest point of each series against the mean and deviation of the others.

    The newest point is found first and taken out before the moments are computed:
    subtracting it afterwards would lose the exact zero deviation of a flat series.
    """
    points = keyed(scan(metrics, None, as_of - window_ms, as_of)).select(
        "name", "labels_key", "ts_ms", "seq", "value")
    newest = points.groupBy("name", "labels_key").agg(
        F.max(F.struct("ts_ms", "seq", "value")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    newest = newest.filter(F.col("_n") >= min_points).drop("_n")
    base = points.join(newest, ["name", "labels_key"]).filter(
        F.struct("ts_ms", "seq") < F.struct("_last.ts_ms", "_last.seq"))
    stats = base.groupBy("name", "labels_key").agg(
        F.any_value("_last").alias("_last"), F.avg("value").alias("expected"), F.stddev_pop("value").alias("_sd"))
    z = F.try_divide(F.abs(F.col("_last.value") - F.col("expected")), F.col("_sd"))
    out = stats.filter(F.col("_sd") >= 1e-10).withColumn("score", z).filter(F.col("score") >= z_limit)
    return out.select("name", "labels_key", F.col("_last.ts_ms").alias("ts_ms"), F.col("_last.value").alias("value"),
                      "expected", "score", severity(F.col("score")).alias("severity"))


def anomalies_backfill(metrics: DataFrame, window_ms: int = BASELINE_MS, min_points: int = ANOMALY_MIN_POINTS,
                       z_limit: float = ANOMALY_Z) -> DataFrame:
    """Every point of a table tested against the points of its series in `[ts - window, ts)`.

    One event per series and millisecond, for the last arrival. Points are first reduced to one row per
    millisecond. Each series is cut into time buckets one window long, so the trailing range of a point is the head
    of its own bucket, before the point, and the tail of the bucket before, from a marker at `ts - window` on. Both
    are running moments about the mean of their bucket, each with one sort of narrow rows and in a stage of its own;
    what a task holds is in proportion to its rows. A flat baseline is recognised by its extremes, which is exact.
    """
    W, series = window_ms, ["name", "labels_key"]
    # A running sum would never lose a NaN or infinity again, so these are counted beside it: a baseline that
    # holds one has no deviation and gives no event.
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    number = F.when(finite, F.col("value"))
    ms = keyed(metrics).filter("ts_ms IS NOT NULL").groupBy(*series, "ts_ms").agg(
        F.count(number).alias("n"), F.coalesce(F.avg(number), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(number), F.lit(0.0)).alias("vp"), F.count(F.when(~finite, 1)).alias("bad"),
        F.max_by("value", "seq").alias("value"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    moments = ["n", "mean", "vp", "bad", "lo", "hi"]
    heads = ms.select(*series, "ts_ms", "value", *moments, F.col("ts_ms").alias("pos"))
    marker = F.struct((F.col("ts_ms") - W).alias("pos"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"),
                      F.lit(0.0).alias("mean"), F.lit(0.0).alias("vp"), F.lit(0).cast("long").alias("bad"),
                      F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    point = F.struct(F.col("ts_ms").alias("pos"), F.lit(1).alias("kind"), *moments)
    tails = ms.select(*series, F.explode(F.array(point, marker)).alias("p")).select(*series, "p.*")
    head = _moments_before(heads, W, ["pos"]).select(*series, "ts_ms", "value", *moments)
    tail = _moments_before(tails, W, [F.desc("pos"), F.desc("kind")]).filter("kind = 0").select(
        *series, (F.col("pos") + W).alias("ts_ms"), F.lit(None).cast("double").alias("value"), *moments)
    n = F.col("n")
    at = head.unionByName(tail).groupBy(*series, "ts_ms").agg(
        F.max("value").alias("value"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.sum(n * F.col("mean")).alias("_sum"), F.sum(n * F.col("vp")).alias("_within"),
        (F.max("mean") - F.min("mean")).alias("_far"), F.sum(n * n).alias("_squares"))
    at = at.filter((F.col("bad") == 0) & ~F.isnan("value") & (n >= F.lit(max(1, min_points - 1))))
    # The moments of two parts: those within each, and n1 * n2 / n times the squared distance of the means.
    between = (n * n - F.col("_squares")) / 2 / n * F.col("_far") * F.col("_far")
    at = at.withColumn("expected", F.col("_sum") / n).withColumn(
        "_sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("_within") + between) / n)))
    at = at.filter((F.col("lo") != F.col("hi")) & (F.col("_sd") >= 1e-10))
    at = at.withColumn("score", F.abs(F.col("value") - F.col("expected")) / F.col("_sd"))
    return at.filter(F.col("score") >= z_limit).select(
        "name", "labels_key", "ts_ms", "value", "expected", "score", severity(F.col("score")).alias("severity"))


def _moments_before(rows: DataFrame, width: int, order: list) -> DataFrame:
    """`rows` with n, mean, vp, bad, lo and hi of the rows before each in its series and bucket of `pos`.

    The mean is null where there are none. One sort serves both windows.
    """
    part = Window.partitionBy("name", "labels_key", F.floor(F.col("pos") / F.lit(width))).orderBy(*order)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.greatest(F.sum("n").over(whole), F.lit(1))
    rows = rows.withColumn("_c", centre)
    d = F.col("mean") - F.col("_c")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({
        "_n": zero(F.sum("n").over(before)), "_bad": zero(F.sum("bad").over(before)),
        "_s": F.sum(F.col("n") * d).over(before), "_q": F.sum(F.col("n") * (F.col("vp") + d * d)).over(before),
        "_lo": F.min("lo").over(before), "_hi": F.max("hi").over(before)})
    shift = F.try_divide("_s", "_n")
    return rows.withColumns({
        "n": F.col("_n"), "bad": F.col("_bad"), "lo": F.col("_lo"), "hi": F.col("_hi"), "mean": F.col("_c") + shift,
        "vp": F.greatest(F.lit(0.0), F.try_divide("_q", "_n") - shift * shift)})


# ---- change points -----------------------------------------------------------------------------

def change_points(metrics: DataFrame, as_of: int, lookback_ms: int = CHANGE_LOOKBACK_MS,
                  min_points: int = CHANGE_MIN_POINTS, min_significance: float = CHANGE_SIGNIFICANCE,
                  slices: int | None = None) -> DataFrame:
    """One CUSUM change point per metric, all its series merged in time order.

    The cumulative sum runs over range slices (see `ordered`), so one busy metric is
    shared by many tasks.
    """
    points = keyed(scan(metrics, None, as_of - lookback_ms, as_of)).select(
        "name", "labels_key", "ts_ms", "seq", "value")
    stats = points.groupBy("name").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    stats = stats.filter((F.col("_n") >= min_points) & (F.col("_sd") >= 1e-9))
    rows = points.join(stats, "name")
    run = running_totals(rows, ["name"], ["ts_ms", "labels_key", "seq"],
                         {"cusum": F.col("value") - F.col("_mean"), "upto": F.lit(1), "total": F.col("value")},
                         slices)
    at = F.struct("upto", "total")
    ext = run.groupBy("name", "_n", "_mean", "_sd").agg(
        F.max("cusum").alias("_max"), F.max_by(at, F.struct("cusum", -F.col("upto"))).alias("_at_max"),
        F.min("cusum").alias("_min"), F.min_by(at, F.struct("cusum", "upto")).alias("_at_min"))
    low = F.abs(F.least("_min", F.lit(0.0))) > F.abs(F.greatest("_max", F.lit(0.0)))
    ext = ext.withColumn("_at", F.when(low, F.col("_at_min")).otherwise(F.col("_at_max")))
    k, n = F.col("_at.upto"), F.col("_n")
    ext = ext.filter((k >= 3) & (k - 1 < n - 3))
    before = F.col("_at.total") / k
    after = (F.col("_mean") * n - F.col("_at.total")) / (n - k)
    ext = (ext.withColumn("_before", before).withColumn("_after", after)
           .withColumn("_score", F.abs(after - before) / F.col("_sd"))
           .filter(F.col("_score") >= min_significance)
           .select("name", "_before", "_after", "_score", (k + 1).alias("upto")))
    out = run.select("name", "upto", "ts_ms").join(ext, ["name", "upto"])
    return out.select(F.col("name").alias("metric"), "ts_ms", S.round_to(F.col("_before"), 4).alias("before_mean"),
                      S.round_to(F.col("_after"), 4).alias("after_mean"),
                      S.round_to(F.col("_score"), 4).alias("significance"))


def distinct_changes(changes: DataFrame, keep: int | None = None) -> DataFrame:
    """Change points seen once per (metric, time); the newest `keep` of them when the caller says so."""
    once = changes.dropDuplicates(["metric", "ts_ms"])
    return once.orderBy(F.desc("ts_ms"), "metric").limit(keep) if keep else once
