"""JSON request bodies as metrics, logs and spans.

Input rows are `(body, ingest_ms, seq)`: one body per row, as a file of lines or a stream
of messages delivers them. Each reader returns `(good, rejected)`; a body is accepted or
rejected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from obsframe.functions.text import parse_once
from obsframe.schemas import LOG_JSON, METRIC_JSON, SPAN_JSON

UNKNOWN_SOURCE = "unknown"


def read_bodies(spark: SparkSession, path: str, ingest_ms: int, stream: bool = False) -> DataFrame:
    """Bodies from text files, one per line; `seq` follows the order within each input split."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(
        F.col("value").alias("body"), F.lit(ingest_ms).cast("long").alias("ingest_ms"),
        (F.lit(0) if stream else F.monotonically_increasing_id()).cast("long").alias("seq"))


def _items(bodies: DataFrame, schema: T.StructType, single: bool) -> DataFrame:
    """Parsed body, raw body and the reason for rejecting it (NULL when fine)."""
    text = F.trim("body")
    if single:
        text = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    out = parse_once(bodies, _raw=F.from_json(text, "array<map<string,string>>"),
                     _items=F.from_json(text, T.ArrayType(schema)))
    unreadable = F.col("_raw").isNull() | F.col("_items").isNull() | F.exists("_raw", lambda r: r.isNull())
    unknown = F.exists("_raw", lambda r: F.size(F.array_except(F.map_keys(r), known)) > 0)
    numeric = [f.name for f in schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]

    def mistyped(z):
        cond = F.lit(False)
        for n in numeric:
            cond = cond | (F.try_element_at(z["_raw"], F.lit(n)).isNotNull() & z["_items"][n].isNull())
        return cond

    wrong_type = F.exists(F.arrays_zip("_raw", "_items"), mistyped)
    return out.withColumn("reason", F.when(unreadable, "bad_json").when(wrong_type, "wrong_type")
                          .when(unknown, "unknown_field"))


def _ts(item: Column) -> Column:
    return F.when(F.coalesce(item, F.lit(0)) == 0, F.col("ingest_ms")).otherwise(item)


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    df = df.withColumn("reason", F.coalesce("reason", reason))
    bad = df.filter(F.col("reason").isNotNull()).select("body", "ingest_ms", "seq", "reason")
    return df.filter(F.col("reason").isNull()), bad


def _labels(labels: Column) -> Column:
    return F.coalesce(labels, F.create_map().cast("map<string,string>"))


def metrics(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrays of `{name, labels, value, timestamp}`; one empty name or unknown field rejects the body."""
    df = _items(bodies, METRIC_JSON, single=False)
    empty = F.exists("_items", lambda x: F.coalesce(x["name"], F.lit("")) == "")
    good, bad = _split(df, F.when(empty, "empty_name"))
    rows = good.select("ingest_ms", "seq", F.posexplode("_items").alias("item", "x"))
    return rows.select(F.col("x.name").alias("name"), _labels(F.col("x.labels")).alias("labels"),
                       F.coalesce("x.value", F.lit(0.0)).alias("value"), _ts(F.col("x.timestamp")).alias("ts_ms"),
                       "seq", "item"), bad


def logs(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One log object or an array of them; the level is taken as it is."""
    good, bad = _split(_items(bodies, LOG_JSON, single=True), F.lit(None).cast("string"))
    rows = good.select("ingest_ms", "seq", F.posexplode("_items").alias("item", "x"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(_ts(F.col("x.timestamp")).alias("ts_ms"), text("x.level").alias("level"),
                       F.coalesce(F.nullif(F.col("x.source"), F.lit("")), F.lit(UNKNOWN_SOURCE)).alias("source"),
                       text("x.message").alias("message"), _labels(F.col("x.labels")).alias("labels"), "seq", "item"), bad


def spans(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrays of spans; an empty array is an error, spans without ids are dropped silently."""
    df = _items(bodies, SPAN_JSON, single=False)
    good, bad = _split(df, F.when(F.size("_items") == 0, "empty"))
    rows = good.select("seq", F.posexplode("_items").alias("item", "x"))
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c)
    num = lambda c, name: F.coalesce(F.col(f"x.{c}"), F.lit(0).cast("long")).alias(name)
    out = rows.select(text("trace_id"), text("span_id"), text("parent_span_id"), text("operation_name"),
                      text("service_name"), num("start_time", "start_ms"), num("duration_ms", "duration_ms"),
                      text("status"), _labels(F.col("x.tags")).alias("tags"),
                      F.coalesce("x.logs", F.array().cast(SPAN_JSON["logs"].dataType)).alias("logs"), "seq", "item")
    return out.filter((F.col("trace_id") != "") & (F.col("span_id") != "")), bad


def recording(spark: SparkSession, path: str) -> DataFrame:
    """A recorded metric file set, one JSON point per line; a bad line fails the read."""
    return (spark.read.schema(METRIC_JSON).option("mode", "FAILFAST").json(path)
            .select("name", _labels(F.col("labels")).alias("labels"), "value", F.col("timestamp").alias("ts_ms"),
                    F.monotonically_increasing_id().alias("seq"),
                    F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("recording")))
