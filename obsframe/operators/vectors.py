"""Arithmetic between vectors and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.functions import scalars as S

Operand = DataFrame | Column | int | float


def arith(op: str, left: Operand, right: Operand, on_zero: str = "error") -> DataFrame:
    """`left op right` where each side is a vector DataFrame, a scalar Column or a number."""
    if isinstance(left, DataFrame) and isinstance(right, DataFrame):
        return vector_vector(op, left, right, on_zero)
    if isinstance(left, DataFrame):
        return _elementwise(left, S.arith(op, F.col("value"), _scalar(right), on_zero))
    if isinstance(right, DataFrame):
        return _elementwise(right, S.arith(op, _scalar(left), F.col("value"), on_zero))
    raise TypeError("one side must be a vector; combine two scalars as plain columns")


def _scalar(x: Operand) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _elementwise(vector: DataFrame, value: Column) -> DataFrame:
    return vector.withColumn("value", value).select("labels", "labels_key", "value")


def vector_vector(op: str, left: DataFrame, right: DataFrame, on_zero: str = "error") -> DataFrame:
    """Inner join on the full label set; a right side of exactly one sample applies to every left row.

    Of right samples that repeat a label set the largest counts.

    The one-sample case is decided inside the plan by scalar subqueries over the
    right side, so there is neither a driver action nor a cross join.
    """
    one = right.agg(F.count(F.lit(1)).alias("n"), F.any_value("value").alias("v"))
    count, only = one.select("n").scalar(), one.select("v").scalar()
    r = right.groupBy("labels_key").agg(F.max("value").alias("_right"))
    matched = (left.join(r, "labels_key").filter(count != 1)
               .select("labels", "labels_key", F.col("value").alias("_left"), "_right"))
    spread = (left.filter(count == 1)
              .select("labels", "labels_key", F.col("value").alias("_left"), only.alias("_right")))
    both = matched.unionByName(spread)
    return both.select("labels", "labels_key", S.arith(op, F.col("_left"), F.col("_right"), on_zero).alias("value"))
