"""On-call assignment, automatic incidents, incident history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from obsframe.operators.ordered import previous_value, range_slices

# Texts and delays of automatic incidents.
OPEN_AFTER_MS = 300_000
TITLE = "告警触发：%s"
CREATED = "事故已创建：%s"
AUTO_ASSIGNED = "已自动分配给值班人员：%s"
ASSIGNED = "已分配给：%s"
RESOLVED = "事故已解决"
CHANGE_NAMES = {"status": "状态", "severity": "级别", "assigned_to": "负责人"}
CHANGE_FORMAT = "%s：%s → %s"
CHANGE_SEPARATOR = "；"
FIRST_STATUS = "investigating"


@dataclass(frozen=True)
class Slot:
    user: str
    start_hour: int
    end_hour: int
    days: tuple[str, ...]


def check_slot(slot: Slot) -> Slot:
    if not slot.user:
        raise ValueError("a slot needs a user")
    if not 0 <= slot.start_hour <= 23 or not 0 < slot.end_hour <= 24 or slot.start_hour >= slot.end_hour:
        raise ValueError("hours must satisfy 0 <= start < end <= 24")
    return slot


def on_call(ts_ms: Column, slots: Sequence[Slot], timezone: str = "UTC") -> Column:
    """Struct (user, until_ms) of the first slot that covers an instant; NULL if nobody is on call.

    However many slots there are, only the first for each hour of the week counts: a map of at most 168 entries.
    """
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), timezone or "UTC")
    midnight = F.date_trunc("day", local)
    week: dict[str, Slot] = {}
    for s in map(check_slot, slots):
        for day in {d.lower() for d in s.days}:
            for hour in range(s.start_hour, s.end_hour):
                week.setdefault(f"{day} {hour}", s)
    if not week:
        return F.lit(None).cast("struct<user:string,until_ms:bigint>")
    now = F.concat_ws(" ", F.lower(F.date_format(local, "E")), F.hour(local).cast("string"))
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x.user).alias("user"), F.lit(x.end_hour).alias("end"))
                           for pair in week.items() for x in pair])
    found = F.try_element_at(table, now)
    end = F.make_dt_interval(F.lit(0), found["end"])
    until = F.unix_millis(F.to_utc_timestamp(midnight + end, timezone or "UTC"))
    return F.when(found.isNotNull(), F.struct(found["user"].alias("user"), until.alias("until_ms")))


def assign_on_call(rows: DataFrame, ts_ms: str, slots: Sequence[Slot], timezone: str = "UTC") -> DataFrame:
    out = rows.withColumn("_o", on_call(F.col(ts_ms), slots, timezone))
    return out.select(*rows.columns, F.coalesce("_o.user", F.lit("")).alias("on_call"),
                      F.coalesce("_o.until_ms", F.lit(0)).cast("long").alias("until_ms"))


def incident_severity(alert_severity: Column) -> Column:
    return (F.when(alert_severity == "critical", "critical").when(alert_severity == "info", "minor")
            .otherwise("major"))


def auto_incidents(alert_events: DataFrame, as_of: int, slots: Sequence[Slot] = (), timezone: str = "UTC",
                   open_after_ms: int = OPEN_AFTER_MS) -> DataFrame:
    """One incident per firing spell that lasts at least `open_after_ms`, given to whoever is on call."""
    w = Window.partitionBy("rule").orderBy("ts_ms")
    spells = alert_events.withColumn("_end", F.lead("ts_ms").over(w)).filter(F.col("state") == "firing")
    opened = F.col("ts_ms") + open_after_ms
    spells = spells.withColumn("created_ms", opened).filter(
        (F.col("created_ms") <= as_of) & (F.col("_end").isNull() | (F.col("_end") > F.col("created_ms"))))
    out = spells.select("rule", F.col("ts_ms").alias("fired_ms"), "created_ms",
                        F.format_string(TITLE, F.col("rule")).alias("title"),
                        incident_severity(F.col("severity")).alias("severity"), F.lit(FIRST_STATUS).alias("status"))
    if not slots:
        return out.withColumn("assigned_to", F.lit(""))
    return assign_on_call(out, "created_ms", slots, timezone).withColumnRenamed("on_call", "assigned_to").drop("until_ms")


EVENT_COLUMNS = ["incident_id", "ts_ms", "seq", "type", "author", "title", "status", "severity", "assigned_to", "message"]


def _normal(events: DataFrame) -> DataFrame:
    """Creation sets the first status; a resolve event sets the last one."""
    status = (F.when(F.col("type") == "resolve", "resolved").when(F.col("type") == "create", FIRST_STATUS)
              .when(F.col("type") == "update", F.col("status")).otherwise(""))
    sets = F.col("type").isin("create", "update")
    return events.select("incident_id", "ts_ms", "seq", "type", "author", "title", status.alias("status"),
                         F.when(sets, F.col("severity")).otherwise("").alias("severity"),
                         F.when(sets, F.col("assigned_to")).otherwise("").alias("assigned_to"), "message")


def field_changes(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Fields that an update or resolve really changed: (incident_id, ts_ms, seq, type, author, field, before, after).

    An empty field means unchanged. The value before is looked up over range slices, so
    one incident with very many events does not end up in a single task.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("after")) for f in CHANGE_NAMES])
    rows = _normal(events).select("incident_id", "ts_ms", "seq", "type", "author",
                                  F.explode(F.filter(fields, lambda x: x["after"] != "")).alias("_f"))
    rows = rows.select("incident_id", "ts_ms", "seq", "type", "author", "_f.field", "_f.after")
    keys, order = ["incident_id", "field"], ["ts_ms", "seq"]
    rows = previous_value(range_slices(rows, keys + order, slices), keys, order, "after", "before").drop("_slice")
    rows = rows.withColumn("before", F.coalesce("before", F.lit("")))
    return rows.filter(F.col("after") != F.col("before"))


def timeline(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Timeline entries (incident_id, ts_ms, seq, part, author, type, message), one row each."""
    changes = field_changes(events, slices).filter(F.col("type") == "update")
    name = F.lit(None).cast("string")
    for f, text in CHANGE_NAMES.items():
        name = F.when(F.col("field") == f, text).otherwise(name)
    rank = F.array_position(F.array(*[F.lit(f) for f in CHANGE_NAMES]), F.col("field"))
    text = F.format_string(CHANGE_FORMAT, name, F.col("before"), F.col("after"))
    at = ["incident_id", "ts_ms", "seq", "author"]
    updated = changes.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))).alias("_c"))
    updated = updated.select(*at, F.lit(1).alias("part"), F.lit("updated").alias("type"), F.array_join(
        F.transform("_c", lambda x: x["t"]), CHANGE_SEPARATOR).alias("message"))
    assigned = changes.filter(F.col("field") == "assigned_to").select(
        *at, F.lit(0).alias("part"), F.lit("assigned").alias("type"),
        F.format_string(ASSIGNED, F.col("after")).alias("message"))
    created = events.filter(F.col("type") == "create")
    created = created.select(*at, F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("created").alias("type"),
                 F.format_string(CREATED, F.col("title")).alias("message")),
        F.struct(F.lit(1).alias("part"), F.lit("assigned").alias("type"),
                 F.when(F.col("assigned_to") != "", F.format_string(AUTO_ASSIGNED, F.col("assigned_to")))
                 .alias("message"))), lambda x: x["message"].isNotNull())).alias("_e")).select(*at, "_e.*")
    other = events.filter((F.col("type") == "resolve") | ((F.col("type") == "comment") & (F.col("message") != "")))
    other = other.select(*at, F.lit(0).alias("part"),
                         F.when(F.col("type") == "comment", "comment").otherwise("resolved").alias("type"),
                         F.when(F.col("type") == "comment", F.col("message")).otherwise(RESOLVED).alias("message"))
    return created.unionByName(assigned).unionByName(updated).unionByName(other)


def current_incidents(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Current row of every incident, folded from its events; an empty field leaves the value alone."""
    rows = _normal(events)
    at = F.struct("ts_ms", "seq")
    latest = lambda f: F.coalesce(F.max_by(F.when(F.col(f) != "", F.col(f)), F.when(F.col(f) != "", at)), F.lit(""))
    out = rows.groupBy("incident_id").agg(
        F.max(F.when(F.col("type") == "create", F.col("title"))).alias("title"),
        latest("status").alias("status"), latest("severity").alias("severity"),
        latest("assigned_to").alias("assigned_to"),
        F.min(F.when(F.col("type") == "create", F.col("ts_ms"))).alias("created_ms"),
        F.max(F.when(F.col("type") == "resolve", F.col("ts_ms"))).alias("resolved_ms"),
        F.max(F.when(F.col("type").isin("create", "resolve") | ((F.col("type") == "comment") & (F.col("message") != "")),
                     F.col("ts_ms"))).alias("_touched"))
    changed = field_changes(events, slices).groupBy("incident_id").agg(F.max("ts_ms").alias("_changed"))
    out = out.join(changed, "incident_id", "left")
    return out.withColumn("updated_ms", F.greatest("_touched", "_changed")).drop("_touched", "_changed")


def list_incidents(incidents: DataFrame, status: str = "", severity: str = "") -> DataFrame:
    out = incidents
    if status:
        out = out.filter(F.col("status") == status)
    if severity:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy(F.desc("created_ms"), "incident_id")
