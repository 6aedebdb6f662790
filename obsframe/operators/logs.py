"""Log search and newest-first lists."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine accepts a regular expression (tried on one constant). Other errors are raised."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
        return True
    except PySparkException as error:
        if (error.getCondition() or "").startswith("INVALID_PARAMETER_VALUE.PATTERN"):
            return False
        raise


def matching(logs: DataFrame, query: str = "", level: str = "", source: str = "",
             start_ms: int = 0, end_ms: int = 0) -> DataFrame:
    """Logs by level, source, time (0 = open) and text.

    Plain text matches without case; `/pattern/` is a regular expression, and one that
    does not compile matches nothing.
    """
    out = logs
    if level:
        out = out.filter(F.col("level") == level)
    if source:
        out = out.filter(F.col("source") == source)
    if start_ms:
        out = out.filter(F.col("ts_ms") >= start_ms)
    if end_ms:
        out = out.filter(F.col("ts_ms") <= end_ms)
    if len(query) >= 2 and query[0] == "/" and query[-1] == "/":
        pattern = query[1:-1]
        ok = valid_pattern(logs.sparkSession, pattern)
        out = out.filter(F.col("message").rlike(pattern)) if ok else out.filter(F.lit(False))
    elif query:
        out = out.filter(F.contains(F.lower("message"), F.lit(query.lower())))
    return out


def search(logs: DataFrame, query: str = "", level: str = "", source: str = "",
           start_ms: int = 0, end_ms: int = 0, limit: int | None = None) -> DataFrame:
    """Matching logs, newest first; all of them unless the caller sets a limit."""
    found = matching(logs, query, level, source, start_ms, end_ms)
    found = found.orderBy(F.desc("ts_ms"), F.desc("seq"))
    return found.limit(limit) if limit else found


def recent(logs: DataFrame, n: int) -> DataFrame:
    return logs.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(n)
