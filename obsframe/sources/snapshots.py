"""Tables of collected readings as metrics: interfaces, processes, probes, test runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from obsframe.operators.ordered import top_n_per_key
from obsframe.sources.lines import points

# How many processes of a snapshot are kept, and the text of a failed run.
MAX_PROCESSES = 20
STEP_FAILED = '步骤 "%s" 失败: %s'


def interfaces(counters: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Five series per network interface; the optional allow-list ignores case."""
    rows = counters
    if only:
        rows = rows.filter(F.lower("interface").isin(*[n.lower() for n in only]))
    values = [(f"network_{c}", F.col(c)) for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")]
    values.append(("network_errors", F.col("errors_in") + F.col("errors_out")))
    return points(rows, F.create_map(F.lit("interface"), F.col("interface")), values, "ts_ms")


def top_processes(snapshots: DataFrame, sort_by: str = "cpu", n: int = MAX_PROCESSES) -> DataFrame:
    """The n busiest processes of each snapshot; `sort_by="memory"` reorders those that were kept."""
    top = top_n_per_key(snapshots, ["ts_ms"], [F.desc("cpu_percent"), F.col("pid")], n)
    return top.orderBy("ts_ms", F.desc("memory_mb"), "pid") if sort_by == "memory" else top.orderBy("ts_ms", "rank")


def processes(snapshots: DataFrame, n: int = MAX_PROCESSES) -> DataFrame:
    top = top_n_per_key(snapshots, ["ts_ms"], [F.desc("cpu_percent"), F.col("pid")], n)
    labels = F.create_map(F.lit("name"), F.col("name"), F.lit("pid"), F.col("pid").cast("string"))
    return points(top, labels, [("process_cpu", F.col("cpu_percent")), ("process_memory_mb", F.col("memory_mb"))], "ts_ms")


def probes(results: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("name"), F.col("name"), F.lit("url"), F.col("url"))
    return points(results, labels, [("probe_status", (F.col("status") == "up").cast("double")),
                                    ("probe_response_ms", F.col("response_ms"))], "ts_ms")


def runs(steps: DataFrame) -> DataFrame:
    """Steps `(test, run_id, step_no, step, passed, error, duration_ms, ts_ms)` folded to one row per run.

    A run ends with its first failed step; later steps do not count.
    """
    failed = steps.groupBy("test", "run_id").agg(F.min(F.when(~F.col("passed"), F.col("step_no"))).alias("_stop"))
    done = steps.join(failed, ["test", "run_id"]).filter(F.col("_stop").isNull() | (F.col("step_no") <= F.col("_stop")))
    out = done.groupBy("test", "run_id").agg(
        F.bool_and("passed").alias("passed"), F.sum("duration_ms").alias("duration_ms"), F.max("ts_ms").alias("ts_ms"),
        F.min_by(F.when(~F.col("passed"), F.struct("step", "error")), F.when(~F.col("passed"), F.col("step_no"))).alias("_e"))
    error = F.format_string(STEP_FAILED, F.col("_e.step"), F.col("_e.error"))
    return out.select("test", F.col("run_id").alias("seq"), "passed", "duration_ms", "ts_ms",
                      F.when(F.col("passed"), "").otherwise(error).alias("error"))


def run_metrics(steps: DataFrame) -> DataFrame:
    return points(runs(steps), F.create_map(F.lit("test"), F.col("test")),
                  [("synthetic_duration_ms", F.col("duration_ms")), ("synthetic_status", F.col("passed").cast("double"))], "ts_ms")
