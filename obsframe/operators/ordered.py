"""Ordered work that never puts one whole group into one task.

A plain window over `partitionBy(key)` sends every row of a hot key to one task.
Here rows are range-partitioned on (key, order), so a hot key is cut into many
slices; per-slice totals (one row per slice and key) are summed across slices and
added back as offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from obsframe.session import cut_lineage, shuffle_width

SLICE = "_slice"


def range_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add `_slice`: slices hold consecutive runs of rows in `order` and grow in number, not size.

    The rows are checkpointed, so every later use sees the same cut points.
    """
    n = slices or shuffle_width(df.sparkSession)
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(SLICE, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: Mapping[str, Column], slices: int | None = None) -> DataFrame:
    """Add inclusive running sums per key. Key columns must not be NULL; (keys, order) must be unique."""
    keys, order = list(keys), list(order)
    return slice_totals(range_slices(df, keys + order, slices), keys, order, sums)


def slice_totals(sliced: DataFrame, keys: Sequence[str], order: Sequence[str],
                 sums: Mapping[str, Column]) -> DataFrame:
    """Running sums over rows that already carry `_slice` in (keys, order) range order."""
    keys = list(keys)
    per_slice = sliced.groupBy(SLICE, *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = _whole(keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        SLICE, *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums])
    here = (Window.partitionBy(SLICE, *keys).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = sliced.join(offsets, [SLICE, *keys])
    for name, col in sums.items():
        out = out.withColumn(name, F.sum(col).over(here) + F.col(f"_off_{name}"))
    return out.drop(*[f"_off_{n}" for n in sums])


def _whole(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def previous_value(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], column: str,
                   alias: str) -> DataFrame:
    """`lag(column)` per key over sliced rows; the first row of a slice reads the slices before it."""
    keys = list(keys)
    ord_ = F.struct(*order)
    last = sliced.groupBy(SLICE, *keys).agg(F.max_by(column, ord_).alias("_last"))
    before = _whole(keys).orderBy(SLICE)
    carry = last.select(SLICE, *keys, F.lag("_last").over(before).alias("_carry"))
    here = Window.partitionBy(SLICE, *keys).orderBy(*order)
    return (sliced.join(carry, [SLICE, *keys])
            .withColumn(alias, F.coalesce(F.lag(column).over(here), F.col("_carry")))
            .drop("_carry"))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                  rank_as: str = "rank", salts: int = 32) -> DataFrame:
    """First n rows per key in `order`, exact.

    `n` may be a column that is constant within a key. Each key is first cut into `salts` parts, so the final ranking of a key sees at
    most salts * n rows however many rows the key has.
    """
    keys = list(keys)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = _whole(keys).orderBy(*order)
    local = (df.withColumn("_salt", salt)
             .withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n)
             .drop("_rn", "_salt"))
    return local.withColumn(rank_as, F.row_number().over(whole)).filter(F.col(rank_as) <= n)


def _hashable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, float],
                      slices: int | None = None) -> DataFrame:
    """Linear-interpolation percentiles (0-100) per key.

    Equal values are counted before the shuffle; running counts over the distinct
    values then say which value holds each wanted rank, so no task ever holds a
    whole group.
    """
    keys = list(keys)
    if not keys:
        one = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, percents, slices)
        return one.drop("_all")
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_totals(counted, keys, [value], {"_upto": F.col("_n")}, slices)
    run = run.join(counted.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    picked = []
    for name, pct in percents.items():
        at = F.lit(min(max(pct, 0.0), 100.0) / 100.0) * (F.col("_total") - 1)
        lo = F.floor(at)
        hi = F.least(lo + 1, F.col("_total") - 1)
        holds = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n"))
        frac = at - lo
        picked += [
            F.max(F.when(holds(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(frac).alias(f"_f_{name}"),
        ]
    out = run.groupBy(*keys).agg(*picked)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") * (1 - F.col(f"_f_{n}")) + F.col(f"_hi_{n}") * F.col(f"_f_{n}")).alias(n)
        for n in percents])
