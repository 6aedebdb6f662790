"""Access audit, roles, tenants, quotas, rate limits, tags, agents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from obsframe.operators.ordered import top_n_per_key

# Audit vocabulary, role rules, default quotas and rate limits.
RESOURCE_PATHS = {
    "/auth/keys": "api_key",
    "/alerts": "alert_rule",
    "/probes": "probe",
    "/incidents": "incident",
    "/admin": "config",
    "/tenants": "tenant",
}
PATH_VERBS = ("start", "stop", "resolve", "comment")
ADMIN_PATHS = ("/api/v1/auth/keys", "/api/v1/admin/", "/api/v1/tenants", "/api/v1/audit")
READ_METHODS = ("GET", "OPTIONS", "HEAD")
DEFAULT_QUOTAS = {
    "metrics_per_minute": 10_000,
    "logs_per_minute": 5_000,
    "api_requests_per_minute": 1_000,
    "series_count": 0,
    "storage_bytes": 0,
}
BUCKET_CAPACITY = 200
BUCKET_PER_SECOND = 100
ANONYMOUS = "anonymous"
STALE_AFTER_MS = 30_000
DEFAULT_TENANT = "default"


# ---- audit -------------------------------------------------------------------------------------

def audit_action(method: Column) -> Column:
    """NULL for methods that are not audited."""
    return (F.when(method == "POST", "create").when(method.isin("PUT", "PATCH"), "update")
            .when(method == "DELETE", "delete"))


def resource_type(path: Column) -> Column:
    expr = F.lit("generic")
    for part, kind in reversed(RESOURCE_PATHS.items()):
        expr = F.when(F.contains(path, F.lit(part)), kind).otherwise(expr)
    return expr


def resource_id(path: Column) -> Column:
    """Last path segment, or the one before it when the last is a verb."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.isin(*PATH_VERBS) & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    """First forwarded address, else the host part of `host:port`."""
    bracketed = F.regexp_extract(remote, r"^\[([^\]]*)\]:[^:\]]*$", 1)
    plain = F.regexp_extract(remote, r"^([^:\[\]]*):[^:]*$", 1)
    host = F.when(bracketed != "", bracketed).when(plain != "", plain).otherwise(remote)
    return F.when(F.coalesce(forwarded_for, F.lit("")) != "", F.trim(F.split(forwarded_for, ",")[0])).otherwise(host)


def audit(access: DataFrame) -> DataFrame:
    """Write requests of an access log as audit entries."""
    rows = access.withColumn("action", audit_action(F.col("method"))).filter(F.col("action").isNotNull())
    return rows.select(
        "ts_ms", "seq", F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit(ANONYMOUS)).alias("user"), "action",
        resource_type(F.col("path")).alias("resource_type"), resource_id(F.col("path")).alias("resource_id"),
        F.concat("method", F.lit(" "), "path").alias("details"),
        client_ip(F.col("forwarded_for"), F.col("remote")).alias("ip_address"),
        F.when(F.col("status_code").isin(401, 403), "denied").otherwise("success").alias("status"))


def audit_list(entries: DataFrame, user: str = "", action: str = "", kind: str = "",
               start_ms: int = 0, end_ms: int = 0, limit: int | None = None) -> DataFrame:
    """Matching audit entries, newest first; all of them unless the caller sets a limit."""
    out = entries
    for column, value in (("user", user), ("action", action), ("resource_type", kind)):
        if value:
            out = out.filter(F.col(column) == value)
    if start_ms > 0:
        out = out.filter(F.col("ts_ms") >= start_ms)
    if end_ms > 0:
        out = out.filter(F.col("ts_ms") <= end_ms)
    out = out.orderBy(F.desc("ts_ms"), F.desc("seq"))
    return out.limit(limit) if limit else out


def allowed(role: Column, method: Column, path: Column) -> Column:
    """Role rules: admin everything, viewer reads, everybody else all but the admin paths."""
    admin_only = F.lit(False)
    for p in ADMIN_PATHS:
        admin_only = admin_only | path.startswith(p)
    return (F.when(role == "admin", True).when(admin_only, False)
            .when(role == "viewer", method.isin(*READ_METHODS)).otherwise(True))


# ---- tenants -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Tenant:
    id: str
    metric_prefix: str = ""
    api_key_prefix: str = ""



def tenant_by_id(rows: DataFrame, tenants: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Add `tenant` and `metric_prefix` by id; unknown and empty ids fall to the default tenant.

    A plain left join: Spark broadcasts the tenants when their size allows.
    """
    t = tenants.select(F.col("id").alias("tenant"), "metric_prefix")
    default = t.filter(F.col("tenant") == DEFAULT_TENANT).select("metric_prefix").scalar()
    out = rows.join(t, rows[key] == t["tenant"], "left")
    return (out.withColumn("metric_prefix", F.coalesce("metric_prefix", F.when(F.col("tenant").isNull(), default), F.lit("")))
            .withColumn("tenant", F.coalesce("tenant", F.lit(DEFAULT_TENANT))))


def tenant_by_key(key_name: Column, tenants: Sequence[Tenant]) -> Column:
    """Tenant id with the longest matching key prefix, else the default tenant.

    One map lookup per distinct prefix length; the prefixes are configuration.
    """
    keyed: dict[int, dict[str, str]] = {}
    for t in sorted(tenants, key=lambda t: t.id, reverse=True):
        if t.id != DEFAULT_TENANT and t.api_key_prefix:
            keyed.setdefault(len(t.api_key_prefix), {})[t.api_key_prefix] = t.id
    hits = []
    for n in sorted(keyed, reverse=True):
        table = F.create_map(*[F.lit(x) for kv in keyed[n].items() for x in kv])
        hits.append(F.try_element_at(table, F.substring(key_name, 1, n)))
    return F.coalesce(*hits, F.lit(DEFAULT_TENANT))


def prefixed(name: Column, prefix: Column) -> Column:
    """Metric name with a tenant prefix, unless it is there already or the prefix is empty."""
    return F.when((prefix == "") | F.startswith(name, prefix), name).otherwise(F.concat(prefix, name))


# ---- quotas ------------------------------------------------------------------------------------

def quota_usage(batches: DataFrame, limits: Mapping[str, int] = DEFAULT_QUOTAS) -> DataFrame:
    """Demand per resource and calendar minute with its limit and the time of the next reset."""
    minute = F.col("ts_ms") - F.col("ts_ms") % 60_000
    out = batches.groupBy("resource", minute.alias("minute_ms")).agg(F.sum("delta").alias("demand"))
    return out.withColumn("limit", _limit_of(limits)).withColumn("reset_at_ms", F.col("minute_ms") + 60_000)


def _limit_of(limits: Mapping[str, int]) -> Column:
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.coalesce(F.try_element_at(table, F.col("resource")), F.lit(0).cast("long"))


def quota_admit(batches: DataFrame, limits: Mapping[str, int] = DEFAULT_QUOTAS, width_ms: int = 60_000) -> DataFrame:
    """Admit each batch iff used + delta stays within the limit of its minute; rejected ones use nothing.

    `seq` identifies a batch and `delta` is not negative. What remains of a limit only
    shrinks, so once one batch of size d is rejected every later batch of that size is too,
    and at most limit / d of them can be admitted. Only those earliest batches per size can
    matter - at most limit * ln(limit) rows of a minute, however busy it is - and the
    sequential fold runs on them alone. Everything else is rejected.
    """
    rows = (batches.withColumn("limit", _limit_of(limits))
            .withColumn("minute_ms", F.col("ts_ms") - F.col("ts_ms") % width_ms))
    limited = rows.filter((F.col("limit") > 0) & (F.col("delta") > 0) & (F.col("delta") <= F.col("limit")))
    limited = limited.select("resource", "minute_ms", "ts_ms", "seq", "delta", "limit",
                             F.floor(F.col("limit") / F.col("delta")).alias("_most"))
    can = top_n_per_key(limited, ["resource", "minute_ms", "delta"], [F.col("ts_ms"), F.col("seq")], F.col("_most"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "seq"])
        used, limit, keep = 0, int(pdf["limit"].iloc[0]), []
        for delta in pdf["delta"].to_numpy():
            fits = used + delta <= limit
            used += int(delta) if fits else 0
            keep.append(fits)
        return pdf.loc[np.array(keep), ["resource", "seq"]]

    taken = (can.select("resource", "minute_ms", "ts_ms", "seq", "delta", "limit")
             .groupBy("resource", "minute_ms").applyInPandas(fold, "resource string, seq bigint")
             .withColumn("_taken", F.lit(True)))
    free = (F.col("limit") == 0) | (F.col("delta") == 0)
    out = rows.join(taken, ["resource", "seq"], "left")
    return out.withColumn("admitted", free | F.coalesce("_taken", F.lit(False))).drop("_taken")


# ---- token bucket ------------------------------------------------------------------------------

MERGE_EVERY = 16


@dataclass(frozen=True)
class Bucket:
    """A token bucket in whole units: `token` units make one token, `refill` units arrive per tick."""
    capacity: int
    token: int
    refill: int
    tick_ms: int

    @staticmethod
    def of(capacity: int, per_second: float | Fraction, tick_ms: int = 1) -> "Bucket":
        # A float stands for its decimal text, so 0.1 is a tenth.
        per_tick = Fraction(str(per_second)) * tick_ms / 1000
        return Bucket(capacity, per_tick.denominator, per_tick.numerator, tick_ms)

    @property
    def full(self) -> int:
        return self.capacity * self.token


def _walk(ticks: np.ndarray, counts: np.ndarray, start_tick: int, end_tick: int, states: np.ndarray,
          b: Bucket, trace: bool = False):
    """Run a set of start states through one chunk; returns the end states and, for one state, what each tick saw."""
    values, back = np.unique(states, return_inverse=True)
    now, seen = start_tick, []
    for i, (tick, count) in enumerate(zip(ticks.tolist(), counts.tolist())):
        values = np.minimum(b.full, values + b.refill * (tick - now))
        if trace:
            seen.append(int(values[0]))
        values = values - np.minimum(count, values // b.token) * b.token
        now = tick
        if len(values) > 1 and i % MERGE_EVERY == 0:
            values, again = np.unique(values, return_inverse=True)
            back = again[back]
    values = np.minimum(b.full, values + b.refill * (end_tick - now))
    return values[back], seen


def _runs(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table from state to end state as runs: first state, its end state, growth by state."""
    if len(ends) == 1:
        return np.zeros(1, np.int64), ends.astype(np.int64), np.zeros(1, np.int64)
    growth = np.diff(ends)
    at = np.flatnonzero(np.concatenate([[True], growth[1:] != growth[:-1]]))
    return at.astype(np.int64), ends[at].astype(np.int64), growth[at].astype(np.int64)


def rate_limit(requests: DataFrame, capacity: int = BUCKET_CAPACITY, per_second: float | Fraction = BUCKET_PER_SECOND,
               tick_ms: int = 1, chunk_ticks: int = 600_000) -> DataFrame:
    """Token-bucket verdict for each request `(key, ts_ms, seq)`: adds `allowed` and `remaining`.

    A hot key is never walked in one task. Requests are counted per key and tick, and time is
    cut into chunks. In whole units a bucket has few possible states, so each chunk is turned,
    in parallel, into a table from start state to end state, kept as runs of states that shift
    alike (about as many as the capacity, whatever the unit); following those tables chunk by
    chunk gives every chunk its true start state, and the chunks are then replayed in
    parallel. Only the first `taken` requests of a tick are allowed.
    """
    b = Bucket.of(capacity, per_second, tick_ms)
    key = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.lit(ANONYMOUS))
    rows = requests.withColumn("key", key).withColumn("tick", F.floor(F.col("ts_ms") / tick_ms).cast("long"))
    counted = rows.groupBy("key", "tick").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("chunk", F.floor(F.col("tick") / chunk_ticks).cast("long"))

    def chunk_table(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        first = int(k[1]) * chunk_ticks
        ends, _ = _walk(pdf["tick"].to_numpy(), pdf["n"].to_numpy(), first, first + chunk_ticks,
                        np.arange(b.full + 1), b)
        first_state, end_state, growth = _runs(ends)
        return pd.DataFrame({"key": [k[0]], "chunk": [k[1]], "first": [first_state], "ends": [end_state], "growth": [growth]})

    tables = counted.groupBy("key", "chunk").applyInPandas(
        chunk_table, "key string, chunk bigint, first array<bigint>, ends array<bigint>, growth array<bigint>")

    def follow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, expected, starts = b.full, None, []
        for chunk, first, ends, growth in zip(pdf["chunk"].tolist(), pdf["first"], pdf["ends"], pdf["growth"]):
            if expected is not None:
                state = min(b.full, state + b.refill * chunk_ticks * (chunk - expected))
            starts.append(state)
            i = int(np.searchsorted(first, state, "right")) - 1
            state, expected = int(ends[i] + growth[i] * (state - first[i])), chunk + 1
        return pd.DataFrame({"key": k[0], "chunk": pdf["chunk"].to_numpy(), "start": starts})

    starts = tables.groupBy("key").applyInPandas(follow, "key string, chunk bigint, start bigint")

    def replay(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        first = int(k[1]) * chunk_ticks
        _, seen = _walk(pdf["tick"].to_numpy(), pdf["n"].to_numpy(), first, first + chunk_ticks,
                        pdf["start"].to_numpy()[:1], b, trace=True)
        have = np.array(seen, dtype="int64") // b.token
        return pd.DataFrame({"key": k[0], "tick": pdf["tick"].to_numpy(), "have": have,
                             "taken": np.minimum(pdf["n"].to_numpy(), have)})

    ticks = (counted.join(starts, ["key", "chunk"]).groupBy("key", "chunk")
             .applyInPandas(replay, "key string, tick bigint, have bigint, taken bigint"))
    offered = rows.select("key", "tick", "seq").join(ticks.filter(F.col("taken") > 0), ["key", "tick"])
    passed = top_n_per_key(offered, ["key", "tick"], [F.col("seq")], F.col("taken"))
    passed = passed.select("key", "seq", (F.col("have") - F.col("rank")).alias("_left"))
    out = rows.join(passed, ["key", "seq"], "left")
    return (out.withColumn("allowed", F.col("_left").isNotNull())
            .withColumn("remaining", F.coalesce("_left", F.lit(0)).cast("long")).drop("_left", "tick"))


# ---- tags --------------------------------------------------------------------------------------

def tags_of_resources(attachments: DataFrame, tags: DataFrame) -> DataFrame:
    """(resource_type, resource_id, key, value, tag_id), one row per tag of a resource."""
    return attachments.dropDuplicates(["resource_type", "resource_id", "tag_id"]).join(
        tags.select(F.col("id").alias("tag_id"), "key", "value"), "tag_id").select(
        "resource_type", "resource_id", "key", "value", "tag_id")


def tags_for_resource(attachments: DataFrame, tags: DataFrame, kind: str, rid: str) -> DataFrame:
    mine = attachments.filter((F.col("resource_type") == kind) & (F.col("resource_id") == rid))
    return tags_of_resources(mine, tags).orderBy("key", "value", "tag_id")


def search_by_tag(attachments: DataFrame, tags: DataFrame, query: str) -> DataFrame:
    """All tags of every resource that carries a tag equal to the query by key, value or `key:value`."""
    query = query.strip()
    hit = ((F.col("key") == query) | (F.col("value") == query)
           | (F.concat("key", F.lit(":"), "value") == query)) & F.lit(bool(query))
    hits = (attachments.join(tags.filter(hit).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
            .select("resource_type", "resource_id").distinct())
    found = attachments.join(hits, ["resource_type", "resource_id"], "left_semi")
    return tags_of_resources(found, tags).orderBy("resource_type", "resource_id", "key", "value", "tag_id")


# ---- agents ------------------------------------------------------------------------------------

def agents(heartbeats: DataFrame, as_of: int | None = None, stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    """Latest heartbeat per agent with its first registration; offline once silent for too long."""
    rest = [c for c in heartbeats.columns if c not in ("agent", "ts_ms", "seq")]
    rows = heartbeats if as_of is None else heartbeats.filter(F.col("ts_ms") <= as_of)
    out = rows.groupBy("agent").agg(
        F.max_by(F.struct(*rest), F.struct("ts_ms", "seq")).alias("_l"), F.min("ts_ms").alias("registered_ms"),
        F.max("ts_ms").alias("last_seen_ms"))
    out = out.select("agent", "_l.*", "registered_ms", "last_seen_ms")
    if as_of is None:
        return out
    return out.withColumn("status", F.when(F.lit(as_of) - F.col("last_seen_ms") > stale_after_ms, "offline")
                          .otherwise("online"))
