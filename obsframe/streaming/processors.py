"""Keyed state: alert states, rate limits, agent liveness.

Each processor keeps a few numbers per key. Rows of one key in one micro-batch are
handled together, so the batch size (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`) bounds
what a hot key brings at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from obsframe.functions import scalars as S
from obsframe.operators.governance import ANONYMOUS, BUCKET_CAPACITY, BUCKET_PER_SECOND, STALE_AFTER_MS, Bucket


def next_state(state: str, since: int, condition: bool, now: int, hold_ms: int) -> tuple[str, int]:
    """One evaluation of the alert state machine; `since` is when pending began."""
    if state == "inactive" and condition:
        return ("firing" if hold_ms == 0 else "pending"), now
    if state == "pending":
        if not condition:
            return "inactive", since
        return ("firing" if now - since >= hold_ms else "pending"), since
    if state == "firing" and not condition:
        return "resolved", since
    if state == "resolved":
        return "inactive", since
    return state, since


class AlertProcessor(StatefulProcessor):
    """Ticks of one rule to state-change events. Ticks that never arrived count as false."""

    def __init__(self, step_ms: int):
        self.step = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("alert", "state string, since bigint, tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("tick_ms")
        state, since, last = self.memory.get() if self.memory.exists() else ("inactive", 0, None)
        out = []
        for r in batch.itertuples(index=False):
            if last is not None and r.tick_ms <= last:
                continue
            for tick in () if last is None else range(last + self.step, r.tick_ms, self.step):
                new, since = next_state(state, since, False, tick, r.hold_ms)
                if new != state:
                    out.append((key[0], tick, new, 0.0, r.severity, r.expression, r.op, r.threshold))
                state = new
                if state == "inactive":
                    break
            new, since = next_state(state, since, r.condition, r.tick_ms, r.hold_ms)
            if new != state:
                out.append((key[0], r.tick_ms, new, r.value, r.severity, r.expression, r.op, r.threshold))
            state = new
            last = int(r.tick_ms)
        self.memory.update((state, int(since), last))
        if out:
            yield pd.DataFrame(out, columns=["rule", "ts_ms", "state", "value", "severity", "expression", "op", "threshold"])

    def close(self) -> None:
        pass


def alert_events(ticks: DataFrame, step_ms: int) -> DataFrame:
    """Stream of rule ticks (the columns of `alerts.conditions`) to alert events."""
    out = ticks.groupBy("rule").transformWithStateInPandas(
        AlertProcessor(step_ms), "rule string, ts_ms bigint, state string, value double, severity string, "
        "expression string, op string, threshold double", "Append", "None")
    message = S.alert_message(F.col("expression"), F.col("value"), F.col("op"), F.col("threshold"))
    return out.select("rule", "ts_ms", "state", "value", "severity", message.alias("message"))


class RateLimitProcessor(StatefulProcessor):
    """Requests of one key to verdicts, in the whole units of the batch form."""

    def __init__(self, bucket: Bucket):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("bucket", "units bigint, tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b = self.bucket
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        ticks = (batch["ts_ms"] // b.tick_ms).astype("int64").tolist()
        units, last = self.memory.get() if self.memory.exists() else (b.full, ticks[0])
        allowed, left = [], []
        for tick in ticks:
            units = min(b.full, units + b.refill * max(0, tick - last))
            last = max(last, tick)
            ok = units >= b.token
            units -= b.token if ok else 0
            allowed.append(ok)
            left.append(units // b.token)
        self.memory.update((int(units), int(last)))
        yield pd.DataFrame({"key": key[0], "seq": batch["seq"].to_numpy(), "ts_ms": batch["ts_ms"].to_numpy(),
                            "allowed": allowed, "remaining": left})

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, capacity: int = BUCKET_CAPACITY, per_second: float | Fraction = BUCKET_PER_SECOND,
               tick_ms: int = 1) -> DataFrame:
    rows = requests.withColumn("key", F.coalesce(F.nullif(F.col("key"), F.lit("")), F.lit(ANONYMOUS)))
    return rows.select("key", "ts_ms", "seq").groupBy("key").transformWithStateInPandas(
        RateLimitProcessor(Bucket.of(capacity, per_second, tick_ms)),
        "key string, seq bigint, ts_ms bigint, allowed boolean, remaining bigint", "Append", "None")


class AgentProcessor(StatefulProcessor):
    """Heartbeats of one agent to online/offline changes, using an event-time timer."""

    def __init__(self, stale_after_ms: int):
        self.stale = stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("agent", "registered bigint, seen bigint, online boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows))["ts_ms"]
        first, newest = int(times.min()), int(times.max())
        known = self.memory.exists()
        registered, seen, online = self.memory.get() if known else (first, first, False)
        seen = max(seen, newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + self.stale + 1)
        self.memory.update((min(registered, first), seen, True))
        if not online:
            yield self._row(key, newest, "online", min(registered, first), seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        registered, seen, _ = self.memory.get()
        self.memory.update((registered, seen, False))
        yield self._row(key, expiredTimerInfo.getExpiryTimeInMs(), "offline", registered, seen)

    @staticmethod
    def _row(key, at, status, registered, seen) -> pd.DataFrame:
        return pd.DataFrame({"agent": [key[0]], "ts_ms": [at], "status": [status], "registered_ms": [registered],
                             "last_seen_ms": [seen]})

    def close(self) -> None:
        pass


def agent_changes(heartbeats: DataFrame, stale_after_ms: int = STALE_AFTER_MS, lateness: str = "10 seconds") -> DataFrame:
    """Stream of `(agent, ts_ms)` heartbeats to status changes."""
    rows = heartbeats.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)
    return rows.select("agent", "ts_ms", "ts").groupBy("agent").transformWithStateInPandas(
        AgentProcessor(stale_after_ms),
        "agent string, ts_ms bigint, status string, registered_ms bigint, last_seen_ms bigint", "Append", "EventTime")
