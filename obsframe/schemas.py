"""Canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from obsframe.functions import labels as L

LABELS = T.MapType(T.StringType(), T.StringType())

METRIC_JSON = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("value", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

LOG_JSON = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("level", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("labels", LABELS),
])

SPAN_JSON = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("operation_name", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("tags", LABELS),
    T.StructField("logs", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.LongType()),
        T.StructField("message", T.StringType()),
    ]))),
])

METRIC_COLUMNS = ["name", "labels", "value", "ts_ms", "seq"]
LOG_COLUMNS = ["ts_ms", "level", "source", "message", "labels", "seq"]
SPAN_COLUMNS = ["trace_id", "span_id", "parent_span_id", "operation_name", "service_name",
                "start_ms", "duration_ms", "status", "seq"]


def stored_metrics(metrics: DataFrame) -> DataFrame:
    """Columns a metrics table keeps on disk: series keys and the partition day are derived once."""
    return (metrics
            .withColumn("labels_key", L.labels_key("labels"))
            .withColumn("series_id", L.series_id("name", "labels"))
            .withColumn("ts", F.timestamp_millis("ts_ms"))
            .withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))))
