"""Tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from obsframe.functions import labels as L
from obsframe.functions.text import plain_number
from obsframe.operators import logs as LOG, traces as TR
from obsframe.operators.ranges import agg_column
from obsframe.operators.select import scan
from obsframe.schemas import stored_metrics

# Export defaults.
EXPORT_WINDOW_MS = 3_600_000
SCRAPE_WINDOW_MS = 300_000
SPAN_EXPORT_COLUMNS = ["trace_id", "span_id", "parent_span_id", "service_name", "operation_name", "start_ms",
                       "duration_ms", "status"]


def append_metrics(metrics: DataFrame, path: str, files: int | None = None, batch_id: int | None = None) -> None:
    """Append to the metrics table: a folder per day, rows clustered by series and time.

    A streaming batch goes to a folder of its own above the days, so that a retried one replaces itself. A table
    is written either with or without batches.

    Range partitioning keeps the files of a day even when one series is most of it, and
    makes the name and time statistics of each file narrow enough to skip by.
    """
    rows = stored_metrics(metrics)
    order = ["day", "name", "labels_key", "ts_ms"]
    rows = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    folder, mode = (path, "append") if batch_id is None else (f"{path}/batch={batch_id}", "overwrite")
    rows.sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(folder)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def replace_days(metrics: DataFrame, path: str) -> None:
    """Rewrite only the days present in `metrics`, after retention or a delete.

    The frame must not read from `path`: an overwrite reads a copy or a checkpoint.
    """
    (stored_metrics(metrics.select("name", "labels", "value", "ts_ms", "seq")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def metrics_export(metrics: DataFrame, as_of: int, name: str | None = None, start_ms: int | None = None,
                   end_ms: int | None = None, text: bool = True) -> DataFrame:
    """`metric, labels, timestamp, value`; labels and value as text for CSV, typed for JSON."""
    start = as_of - EXPORT_WINDOW_MS if start_ms is None else start_ms
    rows = scan(metrics, name, start, as_of if end_ms is None else end_ms)
    labels = L.labels_text("labels") if text else F.col("labels")
    value = plain_number(F.col("value")) if text else F.col("value")
    return rows.select(F.col("name").alias("metric"), labels.alias("labels"), F.col("ts_ms").alias("timestamp"),
                       value.alias("value"))


def logs_export(logs: DataFrame, as_of: int, level: str = "", source: str = "", start_ms: int | None = None,
                end_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Matching logs, all of them unless the caller asks for the newest `limit`."""
    start = as_of - EXPORT_WINDOW_MS if start_ms is None else start_ms
    end = as_of if end_ms is None else end_ms
    found = (LOG.search(logs, "", level, source, start, end, limit) if limit
             else LOG.matching(logs, "", level, source, start, end))
    return found.select(F.col("ts_ms").alias("timestamp"), "level", "source", "message",
                        L.labels_text("labels").alias("labels"))


def spans_export(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """One row per span of the traces that start in the range."""
    return TR.in_range(spans, start_ms, end_ms).select(*SPAN_EXPORT_COLUMNS)


def traces_export(spans: DataFrame, start_ms: int, end_ms: int, part_size: int) -> DataFrame:
    """Nested traces; a trace longer than `part_size` spans continues in further parts."""
    chosen = TR.in_range(spans, start_ms, end_ms)
    head = TR.rollup(chosen).drop("first_seen", "root_operation", "root_service", "span_count")
    return head.join(TR.trace_parts(chosen, part_size), "trace_id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def escaped_name(name: Column) -> Column:
    """Metric name with characters the text format does not allow replaced by underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_:]", "_"), r"^[0-9]", "_")


def exposition(metrics: DataFrame, as_of: int, window_ms: int = SCRAPE_WINDOW_MS) -> DataFrame:
    """Text lines `(name, part, labels_text, line)`: a type line per metric, then its recent series."""
    name = escaped_name(F.col("name"))
    heads = metrics.select("name").distinct().select(
        "name", F.lit(0).alias("part"), F.lit("").alias("labels_text"),
        F.concat(F.lit("# TYPE "), name, F.lit(" gauge")).alias("line"))
    recent = scan(metrics, None, as_of - window_ms, as_of).groupBy("name", "labels").agg(
        agg_column("last").alias("value"), F.max("ts_ms").alias("ts_ms"))
    labels = L.prometheus_labels("labels")
    lines = recent.select("name", F.lit(1).alias("part"), L.labels_text("labels").alias("labels_text"), F.concat(
        name, labels, F.lit(" "), plain_number(F.col("value")), F.lit(" "), F.col("ts_ms").cast("string")).alias("line"))
    return heads.unionByName(lines)


def write_exposition(metrics: DataFrame, path: str, as_of: int, window_ms: int = SCRAPE_WINDOW_MS) -> None:
    exposition(metrics, as_of, window_ms).orderBy("name", "part", "labels_text").select("line").write.mode("overwrite").text(path)


def recording_lines(metrics: DataFrame) -> DataFrame:
    """Points as the JSON objects a recording holds."""
    return metrics.select("name", "labels", "value", F.col("ts_ms").alias("timestamp"))


def record_stream(metrics: DataFrame, path: str, checkpoint: str):
    """Append every point of a metric stream to a recording."""
    return (recording_lines(metrics).writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))
