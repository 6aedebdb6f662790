"""Text helpers: parsing once, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The number syntax accepted in text formats.
NUMBER = r"^(?i:[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(inf|infinity)|nan)$"


def parse_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are costly to compute and used several times.

    Filters and projections would copy a parse expression into every place that uses it;
    they are not moved through a generator, so a one-element explode computes it once.
    """
    parsed = F.struct(*[c.alias(n) for n, c in columns.items()])
    rows = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(parsed)).alias("_once"))
    return rows.select("*", *[F.col(f"_once.{n}").alias(n) for n in columns]).drop("_once")


def number(text: Column) -> Column:
    """Text to double; NULL unless it is a plain number, an infinity or NaN (no `1d`, `1f`)."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, r"^\+", "").try_cast("double"))


def plain_number(value: Column) -> Column:
    """Double to the shortest exact decimal text, without exponent or trailing zeros.

    The digits are those of the double's own text; its exponent only moves the point.
    """
    text = F.abs(value).cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.coalesce(F.try_element_at(F.split(text, "E"), F.lit(2)).try_cast("int"), F.lit(0))
    digits = F.concat(F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1))
    point = F.length(F.substring_index(mantissa, ".", 1)) + exponent  # digits before the point
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(1 - point, F.lit(0))), digits, F.repeat(F.lit("0"), F.greatest(point - F.length(digits), F.lit(0))))
    whole = F.greatest(point, F.lit(1))
    plain = F.concat(F.left(padded, whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)))
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    sign = F.when(value < 0, "-").otherwise("")
    return (F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf")
            .otherwise(F.concat(sign, trimmed)))
