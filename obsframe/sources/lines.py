"""Line formats: exposition text, container and accelerator statistics.

Input rows are `(line, ingest_ms, seq)`; lines that do not parse are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from obsframe.functions.text import number, parse_once

# Exposition line and label patterns, memory units in MiB.
STRING = r'"(?:[^"\\]|\\.)*"'
LINE = rf'^([^{{ \t]++)(?:\s*\{{((?:[^"}}]|{STRING})*)\}}\s*|\s+)(\S+)(?:\s+(\S+))?'
LABEL_BODY = rf'^[\s,]*(?:[^="]+={STRING}[,\s]*)*[^=]*$'
LABEL_KEY = rf'([^=",\s][^="]*)={STRING}'
LABEL_VALUE = r'[^="]+="((?:[^"\\]|\\.)*)"'
MEMORY_UNITS = {
    "GiB": 1024.0,
    "MiB": 1.0,
    "KiB": 1.0 / 1024,
    "GB": 1000.0,
    "MB": 1.0,
    "KB": 0.001,
    "B": 1.0 / (1024 * 1024),
}
CONTAINER_METRICS = ("container_cpu_percent", "container_memory_mb", "container_status")
GPU_METRICS = ("gpu_usage_percent", "gpu_memory_used_mb", "gpu_temperature_celsius")


def read_lines(spark: SparkSession, path: str, ingest_ms: int, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(
        F.col("value").alias("line"), F.lit(ingest_ms).cast("long").alias("ingest_ms"),
        (F.lit(0) if stream else F.monotonically_increasing_id()).cast("long").alias("seq"))


def _unescaped(text: Column) -> Column:
    mark = F.lit("\u0000")
    text = F.replace(text, F.lit("\\\\"), mark)
    text = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(text, mark, F.lit("\\"))


def _label_map(body: Column) -> Column:
    """Label text to a map; the last value of a repeated key wins."""
    keys = F.transform(F.regexp_extract_all(body, F.lit(LABEL_KEY), F.lit(1)), F.trim)
    values = F.transform(F.regexp_extract_all(body, F.lit(LABEL_VALUE), F.lit(1)), _unescaped)
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return F.map_from_entries(last)


def exposition(lines: DataFrame) -> DataFrame:
    """`name{k="v",..} value [ts_ms]` lines as metrics; every type is kept as plain points."""
    text = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = lines.withColumn("line", text).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    part = lambda i: F.regexp_extract("line", LINE, i)
    rows = parse_once(rows, name=part(1), body=part(2), _value=part(3), _ts=part(4))
    rows = rows.select("ingest_ms", "seq", "name", "body", number(F.col("_value")).alias("value"),
                       number(F.col("_ts")).alias("ts"))
    rows = rows.filter((F.col("name") != "") & F.col("value").isNotNull() & F.col("body").rlike(LABEL_BODY))
    ts = F.coalesce(F.col("ts").try_cast("bigint"), F.col("ingest_ms"))
    return rows.select("name", _label_map(F.col("body")).alias("labels"), "value", ts.alias("ts_ms"), "seq")


def points(rows: DataFrame, labels: Column, values: list[tuple[str, Column]], ts: str = "ingest_ms") -> DataFrame:
    """One metric row per named value; values that are NULL give no point."""
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values]),
                    lambda x: x["value"].isNotNull())
    out = rows.select(labels.alias("labels"), F.col(ts).alias("ts_ms"), "seq", F.explode(each).alias("_p"))
    return out.select("_p.name", "labels", "_p.value", "ts_ms", "seq")


def memory_mb(text: Column) -> Column:
    """`128MiB`, `1.5GiB`, `512MB` in MiB."""
    text = F.trim(text)
    out = F.lit(None).cast("double")
    for unit, factor in reversed(MEMORY_UNITS.items()):
        amount = number(F.trim(F.regexp_extract(text, rf"^(.*){unit}$", 1)))
        out = F.coalesce(F.when(text.endswith(unit), amount * F.lit(factor)), out)
    return out


def containers(lines: DataFrame) -> DataFrame:
    """`name,cpu%,used / limit,status` lines as three metrics per container."""
    rows = parse_once(lines, p=F.split(F.trim("line"), ",", 4)).filter(F.size("p") == 4)
    p = F.col("p")
    name = F.regexp_replace(F.trim(p[0]), "^/", "")
    cpu = number(F.trim(F.regexp_replace(p[1], "%$", "")))
    up = F.startswith(F.lower(F.trim(p[3])), F.lit("up")).cast("double")
    values = list(zip(CONTAINER_METRICS, [cpu, memory_mb(F.split(p[2], "/")[0]), up]))
    return points(rows, F.create_map(F.lit("container"), name), values)


def gpus(lines: DataFrame) -> DataFrame:
    """`index,utilisation,memory,temperature` lines as three metrics per device."""
    rows = parse_once(lines, p=F.split(F.trim("line"), ",")).filter(F.size("p") >= 4)
    values = [(n, number(F.trim(F.col("p")[i]))) for i, n in enumerate(GPU_METRICS, start=1)]
    return points(rows, F.create_map(F.lit("gpu"), F.trim(F.col("p")[0])), values)
