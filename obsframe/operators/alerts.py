"""Alert rules over an evaluation grid: tick values, states, events, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from obsframe.functions import labels as L, scalars as S

TICK_MS = 15_000
RULE_FUNCTIONS = ("avg", "sum", "count", "max", "min", "rate", "last", "instant")


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    func: str = "avg"
    range: str | int = "5m"
    op: str = ">"
    threshold: float = 0.0
    hold: str | int = 0
    severity: str = "warning"
    matchers: Mapping[str, str] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    expression: str = ""


RULE_SCHEMA = ("rule string, metric string, func string, range_ms bigint, op string, threshold double, "
               "hold_ms bigint, severity string, matchers map<string,string>, by array<string>, expression string")


def rules_frame(spark: SparkSession, rules: Sequence[AlertRule]) -> DataFrame:
    """Rules as rows with typed columns."""
    rows = []
    for r in rules:
        if r.func not in RULE_FUNCTIONS:
            raise ValueError(f"unknown function {r.func!r}")
        rows.append((r.name, r.metric, r.func, S.duration_ms(r.range, 300_000), r.op, float(r.threshold),
                     S.duration_ms(r.hold), r.severity, dict(r.matchers), list(r.by),
                     r.expression or f"{r.func}({r.metric})"))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def tick_values(metrics: DataFrame, rules: DataFrame, start_ms: int, end_ms: int, step_ms: int = TICK_MS) -> DataFrame:
    """`(rule, tick_ms, value)` for every tick at which a rule has data.

    Instead of comparing points with ticks, each point knows the first and last tick whose
    trailing range holds it. Points sharing that pair are combined first (map-side), and
    only the combined rows are copied to their ticks, so the copies number ticks per range
    and series, not per point.
    """
    k_first, k_last = -(-start_ms // step_ms), end_ms // step_ms
    rule_side = rules.select("rule", F.col("metric").alias("name"), "func", "range_ms", "matchers", "by")
    instant = F.col("func") == "instant"
    points = metrics.filter(F.col("ts_ms") <= end_ms).select("name", "labels", "value", "ts_ms", "seq")
    rows = points.join(rule_side, "name").filter(L.matches_map("labels", "matchers"))
    k_lo = F.ceil(F.col("ts_ms") / F.lit(step_ms)).cast("long")
    k_hi = F.floor((F.col("ts_ms") + F.col("range_ms")) / F.lit(step_ms)).cast("long")
    rows = (rows.withColumn("k_lo", k_lo).withColumn("k_hi", F.when(instant, k_lo).otherwise(k_hi))
            .filter(instant | ((F.col("k_hi") >= k_first) & (F.col("k_lo") <= k_last) & (F.col("k_lo") <= F.col("k_hi")))))
    at = F.struct("ts_ms", "seq", "value")
    v = F.when(~F.isnan("value"), F.col("value"))
    part = rows.groupBy("rule", "labels", "k_lo", "k_hi").agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.max(v).alias("hi"), F.min(v).alias("lo"),
        F.min(at).alias("first"), F.max(at).alias("last"))
    about = rules.select("rule", "func", "range_ms", "by")
    part = part.join(about, "rule").withColumn("labels_key", L.labels_key("labels"))
    key = F.when(F.size("by") > 0, F.array_join(F.transform(
        "by", lambda x: F.coalesce(F.try_element_at("labels", x), F.lit(""))), "\n"))
    part = part.withColumn("key", F.coalesce(key, F.col("labels_key"))).drop("labels", "by", "range_ms")
    # An instant value holds until the series' next value.
    series = Window.partitionBy("rule", "labels_key").orderBy("k_lo")
    held = part.filter(instant).withColumn("k_hi", F.coalesce(F.lead("k_lo").over(series) - 1, F.lit(k_last)))
    part = part.filter(~instant).unionByName(held).filter((F.col("k_lo") <= k_last) & (F.col("k_hi") >= k_first))
    ticks = part.drop("func").withColumn("k", F.explode(F.sequence(
        F.greatest("k_lo", F.lit(k_first)), F.least("k_hi", F.lit(k_last)))))
    per = ticks.groupBy("rule", "k", "key", "labels_key").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    per = per.join(about.select("rule", "func", "range_ms"), "rule")
    func = F.col("func")
    value = (F.when(func == "avg", F.col("s") / F.col("n")).when(func == "sum", F.col("s"))
             .when(func == "count", F.col("n").cast("double"))
             .when(func == "max", F.coalesce("hi", F.lit(float("-inf"))))
             .when(func == "min", F.coalesce("lo", F.lit(float("inf"))))
             .when(func == "rate", F.when(F.col("n") >= 2, (F.col("last.value") - F.col("first.value"))
                                          / (F.col("range_ms") / 1000.0)))
             .otherwise(F.col("last.value")))
    per = per.select("rule", "k", "key", "labels_key", value.alias("value")).filter(F.col("value").isNotNull())
    grouped = per.groupBy("rule", "k", "key").agg(
        F.avg("value").alias("a"), F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"),
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", "labels_key").alias("last"))
    grouped = grouped.join(rules.select("rule", "func", F.size("by").alias("nby")), "rule")
    group_value = (F.when((F.col("nby") == 0) | func.isin("rate", "last", "instant"), F.col("last"))
                   .when(func == "avg", F.col("a")).when(func == "sum", F.col("s")).when(func == "count", F.col("n"))
                   .when(func == "max", F.col("hi")).otherwise(F.col("lo")))
    out = grouped.withColumn("v", group_value).groupBy("rule", "k").agg(F.avg("v").alias("value"))
    return out.select("rule", (F.col("k") * step_ms).alias("tick_ms"), "value")


def conditions(metrics: DataFrame, rules: DataFrame, start_ms: int, end_ms: int, step_ms: int = TICK_MS) -> DataFrame:
    """Every rule at every tick with its value and verdict; without data the value is 0 and the verdict false."""
    k_first, k_last = -(-start_ms // step_ms), end_ms // step_ms
    grid = rules.select("rule", "op", "threshold", "hold_ms", "severity", "expression",
                        F.explode(F.sequence(F.lit(k_first).cast("long"), F.lit(k_last).cast("long"))).alias("k"))
    grid = grid.withColumn("tick_ms", F.col("k") * step_ms).drop("k")
    values = tick_values(metrics, rules, start_ms, end_ms, step_ms)
    out = grid.join(values, ["rule", "tick_ms"], "left")
    verdict = F.coalesce(S.compare_by(F.col("op"), F.col("value"), F.col("threshold")), F.lit(False))
    return out.withColumn("condition", verdict).withColumn("value", F.coalesce("value", F.lit(0.0)))


def states(ticks: DataFrame) -> DataFrame:
    """State of each rule at each tick: inactive, pending, firing or resolved.

    A condition that becomes true is pending until it has held for `hold_ms`, then firing;
    when it ends a firing rule is resolved for one tick, and the tick after that is inactive
    even if the condition is true again. That lost tick shortens a run of true ticks that
    starts two ticks after a run that fired, and may keep it from firing, which in turn
    decides about the next run. Per run this is either a constant or the negation of the
    run before, so it is solved by counting negations since the last constant: no fold.
    All windows are per rule over its ticks, never over points.
    """
    by_rule = Window.partitionBy("rule").orderBy("tick_ms")
    c = F.col("condition")
    t = ticks.withColumn("_starts", c & ~F.coalesce(F.lag("condition").over(by_rule), F.lit(False)))
    t = (t.withColumn("_run", F.sum(F.col("_starts").cast("int")).over(by_rule))
         .withColumn("_i", F.row_number().over(by_rule))
         .withColumn("_next_ms", F.lead("tick_ms").over(by_rule)))
    runs = t.filter(c).groupBy("rule", "_run").agg(
        F.min("_i").alias("a"), F.max("_i").alias("b"), F.min("tick_ms").alias("ta"), F.max("tick_ms").alias("tb"),
        F.max(F.when(F.col("_starts"), F.col("_next_ms"))).alias("ta2"), F.max("hold_ms").alias("hold"))
    in_order = Window.partitionBy("rule").orderBy("_run")
    runs = runs.withColumn("close", F.coalesce(F.col("a") == F.lag("b").over(in_order) + 2, F.lit(False)))
    full = F.col("tb") - F.col("ta") >= F.col("hold")
    short = F.when(F.col("close"), (F.col("b") > F.col("a"))
                   & (F.coalesce(F.col("tb") - F.col("ta2"), F.lit(-1)) >= F.col("hold"))).otherwise(full)
    runs = runs.withColumn("fixed", F.when(full == short, full)).withColumn(
        "_g", F.sum(F.col("fixed").isNotNull().cast("int")).over(in_order))
    since = Window.partitionBy("rule", "_g").orderBy("_run")
    flips = F.sum(F.col("fixed").isNull().cast("int")).over(since)
    start = F.first("fixed").over(since)
    runs = runs.withColumn("fired", F.when(flips % 2 == 1, ~start).otherwise(start))
    late = F.col("close") & F.coalesce(F.lag("fired").over(in_order), F.lit(False))
    runs = (runs.withColumn("late", late)
            .select("rule", "_run", "fired", F.col("b").alias("_b"),
                    F.when(F.col("late"), F.coalesce("ta2", F.col("tb") + 1)).otherwise(F.col("ta")).alias("_from")))
    t = t.join(runs, ["rule", "_run"], "left")
    held = F.col("tick_ms") - F.col("_from")
    state = (F.when(c & (held < 0), "inactive").when(c & (held >= F.col("hold_ms")), "firing").when(c, "pending")
             .when(F.coalesce(F.col("fired") & (F.col("_i") == F.col("_b") + 1), F.lit(False)), "resolved")
             .otherwise("inactive"))
    return t.withColumn("state", state).drop("_starts", "_run", "_i", "_next_ms", "fired", "_b", "_from")


def events(state_rows: DataFrame) -> DataFrame:
    """One event per state change."""
    w = Window.partitionBy("rule").orderBy("tick_ms")
    changed = state_rows.withColumn("_before", F.coalesce(F.lag("state").over(w), F.lit("inactive")))
    message = S.alert_message(F.col("expression"), F.col("value"), F.col("op"), F.col("threshold"))
    return changed.filter(F.col("state") != F.col("_before")).select(
        "rule", F.col("tick_ms").alias("ts_ms"), "state", "value", "severity", message.alias("message"))


def run_rules(metrics: DataFrame, rules: DataFrame, start_ms: int, end_ms: int, step_ms: int = TICK_MS) -> DataFrame:
    """Alert events of a whole time span."""
    return events(states(conditions(metrics, rules, start_ms, end_ms, step_ms)))


def current(event_rows: DataFrame, as_of: int | None = None) -> DataFrame:
    """Latest state of each rule that ever changed state."""
    rows = event_rows if as_of is None else event_rows.filter(F.col("ts_ms") <= as_of)
    fields = ["ts_ms", "state", "value", "severity", "message"]
    last = rows.groupBy("rule").agg(F.max_by(F.struct(*fields), "ts_ms").alias("_l"))
    return last.select("rule", "_l.*")


def active(event_rows: DataFrame, as_of: int | None = None, include_pending: bool = False) -> DataFrame:
    """Firing rules; the dashboard variant shows everything that is not inactive."""
    now = current(event_rows, as_of)
    return now.filter(F.col("state") != "inactive") if include_pending else now.filter(F.col("state") == "firing")


def annotations(event_rows: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Alert events in a range as (title, time, tags, text)."""
    return event_rows.filter(F.col("ts_ms").between(start_ms, end_ms)).select(
        F.col("rule").alias("title"), F.col("ts_ms").alias("time"),
        F.array(F.lit("alert"), F.col("state")).alias("tags"), F.col("message").alias("text"))


def recent_outcomes(event_rows: DataFrame, n: int = 10) -> DataFrame:
    """Newest firing and resolved events."""
    hits = event_rows.filter(F.col("state").isin("firing", "resolved"))
    return hits.orderBy(F.desc("ts_ms"), "rule").limit(n)


@dataclass(frozen=True)
class Channel:
    name: str
    kind: str
    severities: tuple[str, ...] = ()


def route(notifications: DataFrame, channels: Sequence[Channel], severity: str | Column = "severity") -> DataFrame:
    """Each notification once per channel that takes its severity; a channel without severities takes all.

    Channels with severities are joined on them; each of the others gets a copy of every row.
    """
    wanted = F.col(severity) if isinstance(severity, str) else severity
    schema = "_severity string, channel string, channel_type string"
    spark = notifications.sparkSession
    named = spark.createDataFrame([(s, c.name, c.kind) for c in channels for s in dict.fromkeys(c.severities)], schema)
    out = notifications.withColumn("_wanted", wanted).join(named, F.col("_wanted") == F.col("_severity")).drop("_wanted", "_severity")
    every = [c for c in channels if not c.severities]
    if every:
        table = F.array(*[F.struct(F.lit(c.name).alias("channel"), F.lit(c.kind).alias("kind")) for c in every])
        rows = notifications.select("*", F.explode(table).alias("_c"))
        out = out.unionByName(rows.select("*", "_c.channel", F.col("_c.kind").alias("channel_type")).drop("_c"))
    return out


def notifications(event_rows: DataFrame) -> DataFrame:
    """Events that are sent out: firing and resolved."""
    return event_rows.filter(F.col("state").isin("firing", "resolved"))
