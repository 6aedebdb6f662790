"""Scalar helpers: arithmetic, comparison, rounding, time buckets, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ARITHMETIC = ("+", "-", "*", "/")
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")


def arith(op: str, a: Column, b: Column, on_zero: str = "error") -> Column:
    """Double arithmetic. Division by zero fails the query, or gives NULL with `on_zero="null"`."""
    a, b = a.cast("double"), b.cast("double")
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        if on_zero == "null":
            return F.try_divide(a, b)
        return F.when(b == 0, F.raise_error("division by zero")).otherwise(F.try_divide(a, b))
    raise ValueError(f"unknown operator {op!r}")


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: NaN is unequal to everything (Spark alone would rank it highest)."""
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    if op not in COMPARISONS:
        return F.lit(False)
    plain = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b}[op]
    return ~nan & plain


def compare_by(op: Column, a: Column, b: Column) -> Column:
    """Comparison whose operator is itself a column; an unknown operator is false."""
    expr = F.lit(False)
    for name in COMPARISONS:
        expr = F.when(op == name, compare(name, a, b)).otherwise(expr)
    return expr


def round_to(v: Column, decimals: int) -> Column:
    """Half away from zero on `v * 10^n`."""
    factor = F.lit(float(10 ** decimals))
    return F.round(v * factor, 0) / factor


def time_bucket(ts_ms: Column, width_ms: int) -> Column:
    """Start of the bucket, truncating toward zero."""
    return ts_ms - ts_ms % F.lit(width_ms)


# Milliseconds per duration unit.
UNIT_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str | int | None, default: int = 0) -> int:
    """`5m`, `1h30m`, `90s`, `1d` to milliseconds; bad or empty text gives the default."""
    if isinstance(text, int):
        return text
    if not text or text == "0":
        return default
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text)
    if "".join(n + u for n, u in parts) != text:
        return default
    return int(sum(float(n) * UNIT_MS[u] for n, u in parts))


def duration_ms_column(text: Column) -> Column:
    """The same for a duration stored in a rule row: one or more `<number><unit>` parts."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h|d))"), F.lit(1))
    whole = text.rlike(r"^(\d+(\.\d+)?(ns|us|µs|ms|s|m|h|d))+$")

    def part_ms(p):
        unit = F.regexp_extract(p, r"([a-zµ]+)$", 1)
        factor = F.lit(None).cast("double")
        for name, ms in UNIT_MS.items():
            factor = F.when(unit == name, F.lit(float(ms))).otherwise(factor)
        return F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * factor

    total = F.aggregate(F.transform(parts, part_ms), F.lit(0.0), lambda a, x: a + x)
    return F.when(whole, total.cast("long")).otherwise(F.lit(0).cast("long"))


# ALERT_FORMAT is the text of an alert message.
ALERT_FORMAT = "%s 当前值 %.4f（阈值：%s %.4f）"


def alert_message(expression: Column, value: Column, op: Column, threshold: Column) -> Column:
    return F.format_string(ALERT_FORMAT, expression, value, op, threshold)


def iso_millis(text: Column) -> Column:
    """ISO-8601 text, with or without fractional seconds, to epoch milliseconds; NULL when unreadable."""
    return F.unix_millis(F.try_to_timestamp(text))
