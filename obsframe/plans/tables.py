"""The test tables seen as metrics, logs, spans and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from obsframe.session import apply_settings

AS_OF = 1_706_659_200_000  # 2024-01-31T00:00:00Z, just after the last event
DAY = 86_400_000
HOUR = 3_600_000
LOG_START = 1_704_067_200_000  # 2024-01-01T00:00:00Z
EVENT_PREFIX = "event_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(ms: int) -> Column:
    return F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")


def events_in(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None,
              names: Sequence[str] | None = None) -> DataFrame:
    """Events with `ts_ms`; time and name limits are stated on the stored columns so the scan can skip."""
    ev = table(spark, sf_dir, "events")
    if start_ms is not None:
        ev = ev.filter(F.col("ts") >= _ntz(start_ms))
    if end_ms is not None:
        ev = ev.filter(F.col("ts") < _ntz(end_ms + 1))
    if names is not None:
        ev = ev.filter(F.col("event_type").isin(*[n.removeprefix(EVENT_PREFIX) for n in names]))
    return ev.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def metrics_of(ev: DataFrame) -> DataFrame:
    """One series per event type, host and region; values are whole cents, so sums are exact."""
    return ev.select(
        F.concat(F.lit(EVENT_PREFIX), "event_type").alias("name"),
        F.create_map(F.lit("host"), F.concat(F.lit("h"), F.col("user_id") % 10),
                     F.lit("region"), F.concat(F.lit("r"), F.col("user_id") % 3)).alias("labels"),
        F.round(F.col("value") * 100, 0).alias("value"),
        "ts_ms", F.col("event_id").alias("seq"))


def metrics(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None,
            names: Sequence[str] | None = None) -> DataFrame:
    return metrics_of(events_in(spark, sf_dir, start_ms, end_ms, names))


METRICS_SQL = """m AS (
  SELECT 'event_' || event_type AS name, 'h' || (user_id % 10) AS host, 'r' || (user_id % 3) AS region,
         'host=h' || (user_id % 10) || chr(10) || 'region=r' || (user_id % 3) || chr(10) AS labels_key,
         round(value * 100) AS value, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq
  FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log lines, one a minute; whole texts are the messages."""
    level = (F.when(F.col("doc_id") % 4 == 0, "info").when(F.col("doc_id") % 4 == 1, "warn")
             .when(F.col("doc_id") % 4 == 2, "error").otherwise("debug"))
    return table(spark, sf_dir, "documents").select(
        (F.lit(LOG_START) + F.col("doc_id") * 60_000).alias("ts_ms"), level.alias("level"), "source",
        F.col("text").alias("message"), F.create_map(F.lit("lang"), F.col("lang")).alias("labels"),
        F.col("doc_id").alias("seq"))


LOGS_SQL = f"""l AS (
  SELECT {LOG_START} + doc_id * 60000 AS ts_ms,
         CASE doc_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE 'debug' END AS level,
         source, text AS message, lang, doc_id AS seq
  FROM documents)"""

SERVICES = ["web-frontend", "checkout-api", "orders-db", "redis-cache", "kafka-broker", "partner-gateway"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans: an order is a trace, a line calls the next line."""
    li = table(spark, sf_dir, "lineitem")
    services = F.array(*[F.lit(s) for s in SERVICES])
    return li.select(
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.col("l_linenumber").cast("string").alias("span_id"),
        F.when(F.col("l_linenumber") == 1, "").otherwise((F.col("l_linenumber") - 1).cast("string"))
        .alias("parent_span_id"),
        F.concat(F.lit("op-"), F.col("l_partkey") % 50).alias("operation_name"),
        F.element_at(services, (F.col("l_suppkey") % 6 + 1).cast("int")).alias("service_name"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1000).alias("start_ms"),
        F.col("l_quantity").cast("long").alias("duration_ms"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq"))


SPANS_SQL = f"""s AS (
  SELECT l_orderkey::VARCHAR AS trace_id, l_linenumber::VARCHAR AS span_id,
         CASE WHEN l_linenumber = 1 THEN '' ELSE (l_linenumber - 1)::VARCHAR END AS parent_span_id,
         'op-' || (l_partkey % 50) AS operation_name,
         ([{", ".join(f"'{s}'" for s in SERVICES)}])[l_suppkey % 6 + 1] AS service_name,
         epoch_us(l_shipdate) // 1000 + l_linenumber * 1000 AS start_ms, l_quantity::BIGINT AS duration_ms,
         CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status,
         l_partkey * 100000 + l_suppkey AS seq
  FROM lineitem)"""
