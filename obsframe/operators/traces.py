"""Traces: roll-up, summaries, ordered spans, service map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.operators.ordered import running_totals

# Service type keywords, matched as substrings in this order.
SERVICE_KEYWORDS = {
    "database": ["postgres", "mysql", "mongo", "sqlite", "database", "-db", "_db"],
    "cache": ["redis", "memcache", "cache"],
    "queue": ["kafka", "rabbitmq", "sqs", "nats", "queue", "broker"],
    "external": ["external", "third-party", "partner", "vendor"],
}
DEFAULT_SERVICE_TYPE = "api"


def valid(spans: DataFrame) -> DataFrame:
    return spans.filter((F.col("trace_id") != "") & (F.col("span_id") != ""))


def service_type(name: Column) -> Column:
    lower = F.lower(name)
    expr = F.lit(DEFAULT_SERVICE_TYPE)
    for kind, words in reversed(SERVICE_KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        expr = F.when(hit, kind).otherwise(expr)
    return expr


def rollup(spans: DataFrame) -> DataFrame:
    """One row per trace: start, duration, services, error flag, root names, arrival order.

    Spans are not collected: the set of services is the only array, so a trace with very
    many spans costs no more than its partial aggregates. Spans themselves come from
    `ordered_spans`.
    """
    root = F.col("parent_span_id") == ""
    first = F.struct("start_ms", "seq")
    out = valid(spans).groupBy("trace_id").agg(
        F.min("start_ms").alias("start_ms"), F.max(F.col("start_ms") + F.col("duration_ms")).alias("_end"),
        F.count(F.lit(1)).alias("span_count"),
        F.sort_array(F.collect_set(F.when(F.col("service_name") != "", F.col("service_name")))).alias("service_names"),
        F.bool_or(F.col("status") == "error").alias("has_error"),
        F.min_by(F.when(root, F.struct("operation_name", "service_name")), F.when(root, first)).alias("_root"),
        F.min("seq").alias("first_seen"))
    return out.select(
        "trace_id", F.coalesce("_root.operation_name", F.lit("")).alias("root_operation"),
        F.coalesce("_root.service_name", F.lit("")).alias("root_service"), "start_ms",
        F.greatest(F.col("_end") - F.col("start_ms"), F.lit(0)).alias("duration_ms"), "span_count",
        "service_names", "has_error", "first_seen")


def list_traces(spans: DataFrame, service: str = "", min_duration_ms: int = 0, limit: int | None = None) -> DataFrame:
    """Summaries, newest arrival first; all of them unless the caller sets a limit."""
    out = rollup(spans)
    if min_duration_ms > 0:
        out = out.filter(F.col("duration_ms") >= min_duration_ms)
    if service:
        out = out.filter(F.array_contains("service_names", service))
    out = out.orderBy(F.desc("first_seen"), "trace_id")
    return out.limit(limit) if limit else out


def newest_traces(spans: DataFrame, cap: int) -> DataFrame:
    """Trace ids kept when only the `cap` newest by first arrival may stay."""
    first = valid(spans).groupBy("trace_id").agg(F.min("seq").alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc("trace_id")).limit(cap)


def ordered_spans(spans: DataFrame, slices: int | None = None) -> DataFrame:
    """Spans with `position` inside their trace: roots first, then by start, then by arrival."""
    rows = valid(spans).withColumn("_child", (F.col("parent_span_id") != "").cast("int"))
    order = ["_child", "start_ms", "seq", "span_id"]
    return running_totals(rows, ["trace_id"], order, {"position": F.lit(1)}, slices).drop("_child", "_slice")


def trace_parts(spans: DataFrame, part_size: int = 1000, slices: int | None = None) -> DataFrame:
    """Nested traces for export: `spans` arrays of at most `part_size`, numbered by `part`.

    All traces up to that size have the single part 0.
    """
    rows = ordered_spans(spans, slices).withColumn("part", F.floor((F.col("position") - 1) / part_size).cast("int"))
    fields = [c for c in spans.columns if c not in ("trace_id", "seq")]
    parts = rows.groupBy("trace_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("position", *fields))).alias("_spans"))
    return parts.select("trace_id", "part", F.transform(
        "_spans", lambda s: F.struct(*[s[c].alias(c) for c in fields])).alias("spans"))


def in_range(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """All spans of the traces whose start lies in the range."""
    starts = valid(spans).groupBy("trace_id").agg(F.min("start_ms").alias("_start"))
    wanted = starts.filter(F.col("_start").between(start_ms, end_ms)).select("trace_id")
    return valid(spans).join(wanted, "trace_id", "left_semi")


def _call_stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("duration_ms").alias("total_ms")]


def service_nodes(spans: DataFrame) -> DataFrame:
    """Requests, errors, mean latency and inferred type per service."""
    out = valid(spans).groupBy("service_name").agg(*_call_stats())
    return out.select(F.col("service_name").alias("name"), service_type(F.col("service_name")).alias("type"),
                      F.col("requests").alias("request_count"), F.col("errors").alias("error_count"),
                      (F.col("total_ms") / F.col("requests")).alias("avg_latency_ms")).orderBy("name")


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls between different services, from each span's parent to the span.

    Children are first counted per (trace, parent span, service); the join to the parent
    then sees one row per calling pair, also under a parent with a huge fan-out. When a
    span id occurs twice in a trace the later arrival is the parent.
    """
    spans = valid(spans)
    calls = (spans.filter(F.col("parent_span_id") != "")
             .groupBy("trace_id", "parent_span_id", F.col("service_name").alias("to_service")).agg(*_call_stats()))
    parents = (spans.groupBy("trace_id", F.col("span_id").alias("parent_span_id"))
               .agg(F.max_by("service_name", "seq").alias("from_service")))
    edges = (calls.join(parents, ["trace_id", "parent_span_id"])
             .filter(F.col("from_service") != F.col("to_service"))
             .groupBy("from_service", "to_service")
             .agg(F.sum("requests").alias("request_count"), F.sum("errors").alias("_errors"),
                  F.sum("total_ms").alias("_ms")))
    return edges.select("from_service", "to_service", "request_count",
                        (F.col("_errors") / F.col("request_count")).alias("error_rate"),
                        (F.col("_ms") / F.col("request_count")).alias("avg_latency_ms")
                        ).orderBy("from_service", "to_service")
